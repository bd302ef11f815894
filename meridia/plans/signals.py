"""Queries of the whole-signal transforms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.catalog import query
from meridia.operators import signal as G
from meridia.operators.connectivity import band_of, edges_gram, mean_z
from meridia.plans.adapters import SAMPLES, samples, table


def per_signal(df: DataFrame, kernel, ids: str = "channel") -> DataFrame:
    """(channel, v array) of a kernel over (n, time) rows; df: channel, x (array). Arrow batches, equal lengths together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            lengths = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                at = pa.array(np.flatnonzero(lengths == n))
                own = x.take(at)
                if n:
                    v = kernel(own.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n)).reshape(len(at), -1)
                    own = pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], np.int32), np.ascontiguousarray(v, float).ravel())
                else:  # null or empty signals
                    own = pa.nulls(len(at), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(ids).take(at), own], names=[ids, "v"])

    return df.select(ids, "x").mapInArrow(run, f"{ids} long, v array<double>")


def scalogram(df: DataFrame, normalised: bool = False) -> DataFrame:
    """channel, scale, power (array over time, rounded) at all scales of the grid; df: channel, x (array).

    A block of bounded size at a time, whatever the batch; null and empty signals have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = G.cwt_grid()
        for batch in batches:
            x = batch.column("x")
            lengths = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == n)
                own = x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n)
                for rows, scales, power in G.cwt_blocks(own, grid, normalised):
                    r, k, _ = power.shape
                    flat = pa.array(G.round_half_up(power, 5).ravel())
                    values = pa.ListArray.from_arrays(np.arange(0, r * k * n + 1, n, np.int32), flat)
                    scale = np.tile(np.arange(scales.start, scales.stop, dtype=np.int32), r)
                    yield pa.RecordBatch.from_arrays([batch.column("channel").take(pa.array(np.repeat(at[rows], k))), pa.array(scale), values], names=["channel", "scale", "power"])

    return df.select("channel", "x").mapInArrow(run, "channel long, scale int, power array<double>")


def _embeddings(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("channel"), F.col("embedding").alias("x"))


def _long(df: DataFrame, name: str, value: str = "v", digits: int = 5) -> DataFrame:
    return df.select("channel", F.posexplode("v").alias(name, value)).withColumn(value, F.round(value, digits) + 0.0)


@query("cwt_freq_grid", "SELECT k AS scale, round(0.25 * power(0.01 / 0.25, k / 223.0::double), 8) AS freq_hz, round(6 / (2 * pi() * 0.25 * power(0.01 / 0.25, k / 223.0::double) * 0.8), 8) AS width FROM (SELECT unnest(range(224)) AS k)")
def cwt_freq_grid(spark, d):
    f = F.expr("0.25D * power(0.01D / 0.25D, id / 223D)")
    return spark.range(224).select(F.col("id").alias("scale"), F.round(f, 8).alias("freq_hz"), F.round(6 / (2 * np.pi * f * 0.8), 8).alias("width"))


_DFT = SAMPLES + """, bins AS (SELECT unnest(range(33))::int AS k), dft AS (SELECT channel, k, sum(x * cos(2 * pi() * k * t / 64)) AS re, -sum(x * sin(2 * pi() * k * t / 64)) AS im FROM samples CROSS JOIN bins GROUP BY ALL)
"""


@query("psd", _DFT + "SELECT channel, k, round((re * re + im * im) / 64, 5) + 0.0 AS power FROM dft")
def psd(spark, d):
    return _long(per_signal(_embeddings(spark, d), G.psd), "k", "power")


@query("psd_mean_db", _DFT + ", p AS (SELECT k, (re * re + im * im) / 64 AS p FROM dft) SELECT k, round(10 * log10(avg(p)), 5) AS mean_db, round(10 / ln(10) * stddev_samp(p) / avg(p), 5) AS std_db FROM p GROUP BY k")
def psd_mean_db(spark, d):
    p = per_signal(_embeddings(spark, d), G.psd).select(F.posexplode("v").alias("k", "p"))
    return p.groupBy("k").agg(F.round(10 * F.log10(F.avg("p")), 5).alias("mean_db"), F.round(10 / np.log(10) * F.stddev_samp("p") / F.avg("p"), 5).alias("std_db"))


@query("cwt_power")
def cwt_power(spark, d):
    """Power at all scales of the grid, a row a channel and scale with its time course."""
    return scalogram(_embeddings(spark, d))


_ANALYTIC = _DFT + """, w AS (SELECT channel, k, re, im, CASE WHEN k = 0 OR k = 32 THEN 1 ELSE 2 END AS h FROM dft),
z AS (SELECT channel, t, sum(h * (re * cos(2 * pi() * k * t / 64) - im * sin(2 * pi() * k * t / 64))) / 64 AS a, sum(h * (re * sin(2 * pi() * k * t / 64) + im * cos(2 * pi() * k * t / 64))) / 64 AS b FROM w CROSS JOIN (SELECT unnest(range(64))::int AS t) GROUP BY ALL),
env AS (SELECT channel, t, sqrt(a * a + b * b) AS e FROM z),
steps AS (SELECT channel, t, a, b, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM z WINDOW w AS (PARTITION BY channel ORDER BY t)),
freq0 AS (SELECT channel, t, atan2(b * pa - a * pb, a * pa + b * pb) * 1.25 / (2 * pi()) AS f FROM steps),
freq AS (SELECT channel, t, coalesce(f, lead(f) OVER (PARTITION BY channel ORDER BY t)) AS f FROM freq0)
"""


@query("hilbert_envelope", _ANALYTIC + "SELECT channel, t, round(e, 5) AS envelope FROM env")
def hilbert_envelope(spark, d):
    return _long(per_signal(_embeddings(spark, d), G.envelope), "t", "envelope")


@query("inst_freq", _ANALYTIC + "SELECT channel, t, round(f, 4) + 0.0 AS freq_hz FROM freq")
def inst_freq(spark, d):
    return _long(per_signal(_embeddings(spark, d), G.inst_freq), "t", "freq_hz", 4)


@query("envelope_normalize", _ANALYTIC + "SELECT channel, t, round(ln(1 + e) / (max(ln(1 + e)) OVER (PARTITION BY channel) + 1e-12), 5) AS envelope FROM env")
def envelope_normalize(spark, d):
    return _long(per_signal(_embeddings(spark, d), lambda x: (lambda e: e / (e.max(-1, keepdims=True) + 1e-12))(np.log1p(G.envelope(x)))), "t", "envelope")


def _decompose(noise: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("channel")
        _, freqs, n = G.mvmd(np.stack(pdf["x"].to_numpy()).astype(float), noise=noise)
        return pd.DataFrame({"run": pdf["run"].iloc[0], "mode": np.arange(len(freqs)), "center_freq_hz": np.round(freqs, 6), "iterations": n})

    return run


def _runs(spark, d):
    """Runs of about eight channels: a label's embeddings whose ids divided by 80 agree."""
    # a run is little data and much work: a number of partitions of our own is not merged for its size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    e = table(spark, d, "embeddings").select(F.expr("concat(label, ':', vec_id div 80)").alias("run"), F.col("vec_id").alias("channel"), F.col("embedding").alias("x"))
    return e.repartition(parts, "run")


@query("mvmd_center_freq")
def mvmd_center_freq(spark, d):
    return _runs(spark, d).groupBy("run").applyInPandas(_decompose(0), "run string, mode int, center_freq_hz double, iterations int")


@query("na_mvmd_center_freq")
def na_mvmd_center_freq(spark, d):
    return _runs(spark, d).groupBy("run").applyInPandas(_decompose(1), "run string, mode int, center_freq_hz double, iterations int")


def run_modes(spark, d) -> DataFrame:
    """run, mode, freq_hz, channel, x: each run decomposed once; what follows reads its modes."""
    return _runs(spark, d).groupBy("run").applyInPandas(G.run_modes, "run string, mode int, freq_hz double, channel long, x array<double>")


@query("fc_per_mode")
def fc_per_mode(spark, d):
    """Connectivity of each mode of each run, and its slow band."""
    z = edges_gram(run_modes(spark, d), ["run", "mode", "freq_hz"], "run string, mode int, freq_hz double, i long, j long, pearson double, fisher_z double")
    return z.select("run", "mode", band_of(F.col("freq_hz")).alias("band"), "i", "j", F.round("pearson", 6).alias("pearson"), F.round("fisher_z", 6).alias("fisher_z"))


@query("fc_mode_bands")
def fc_mode_bands(spark, d):
    """Mean of Fisher's z over the modes of a run that lie in each slow band, and its correlation."""
    z = edges_gram(run_modes(spark, d), ["run", "mode", "freq_hz"], "run string, mode int, freq_hz double, i long, j long, pearson double, fisher_z double")
    means = mean_z(z.withColumn("band", band_of(F.col("freq_hz"))).where("band is not null"), ["run", "band"])
    return means.select("run", "band", "i", "j", F.round("fisher_z_mean", 6).alias("fisher_z_mean"), F.round("pearson", 6).alias("pearson"))


def mode_spectrum(modes: DataFrame) -> DataFrame:
    """run, channel, t, bin, h: the modes' Hilbert spectrum, the largest envelope in each log-frequency bin."""
    analytic = modes.withColumn("row", F.xxhash64("run", "channel", "mode"))
    both = per_signal(analytic.select("row", "x"), lambda x: np.concatenate([G.envelope(x), G.inst_freq(x)], 1), "row")
    rows = analytic.select("row", "run", "channel", F.size("x").alias("t_max")).join(both, "row")
    flat = rows.select("run", "channel", F.posexplode(F.arrays_zip(F.expr("slice(v, 1, t_max)").alias("e"), F.expr("slice(v, t_max + 1, t_max)").alias("f"))).alias("t", "p"))
    inside = flat.select("run", "channel", "t", F.col("p.e").alias("e"), F.col("p.f").alias("f")).where("f >= 0.01D and f < 0.25D")
    at = F.bround(F.expr("223 * (ln(f) - ln(0.25D)) / ln(0.01D / 0.25D)"), 0)
    return inside.groupBy("run", "channel", "t", F.greatest(F.least(at, F.lit(223)), F.lit(0)).cast("int").alias("bin")).agg(F.max("e").alias("h"))


@query("mode_spectrum_energy")
def mode_spectrum_energy(spark, d):
    """Modes to Hilbert spectrum to energy by channel and scale: the image that feature extraction reads, averaged over time."""
    s = mode_spectrum(run_modes(spark, d))
    return s.groupBy("run", "channel", "bin").agg(F.round(F.sum(F.col("h") * F.col("h")), 5).alias("energy"), F.count("*").alias("samples"))


@query(
    "log_bin_map",
    """WITH f AS (SELECT vec_id, 0.01 + 0.24 * (vec_id % 97) / 97.0::double AS f FROM embeddings), bins AS (SELECT k, 0.01 * power(25, k / 15.0::double) AS b FROM (SELECT unnest(range(16)) AS k))
    SELECT vec_id, arg_min(k, (round(abs(f - b), 10), k)) AS bin FROM f CROSS JOIN bins GROUP BY ALL""",
)
def log_bin_map(spark, d):
    f = table(spark, d, "embeddings").select("vec_id", F.expr("0.01D + 0.24D * (vec_id % 97) / 97D").alias("f"))
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")), lambda k: F.struct(F.round(F.abs(F.col("f") - 0.01 * F.pow(F.lit(25.0), k / 15)), 10).alias("gap"), k.alias("k")))
    return f.select("vec_id", F.array_min(each)["k"].alias("bin"))


_SPECTRUM = _ANALYTIC + """, band AS (SELECT (channel // 2) AS signal, e.t, e, round(f, 9) AS f FROM env e JOIN freq USING (channel, t) WHERE round(f, 9) >= greatest(0.01, 1.25 / 64) AND round(f, 9) < 0.25),
spec AS (SELECT signal, t, greatest(least(round_even(223 * (ln(f) - ln(0.25)) / ln(0.01 / 0.25), 0), 223), 0)::int AS bin, max(e) AS h FROM band GROUP BY ALL)
"""


def _spectrum(spark, d):
    """signal, t, bin, h: the largest envelope of a signal's two modes in each log-frequency bin."""
    both = per_signal(_embeddings(spark, d), lambda x: np.stack([G.envelope(x), G.inst_freq(x)], 1))
    flat = both.select("channel", F.posexplode(F.arrays_zip(F.slice("v", 1, 64).alias("e"), F.slice("v", 65, 64).alias("f"))).alias("t", "p"))
    rows = flat.select(F.expr("channel div 2").alias("signal"), "t", F.col("p.e").alias("e"), F.round("p.f", 9).alias("f")).where("f >= greatest(0.01D, 1.25D / 64) and f < 0.25D")
    at = F.bround(F.expr("223 * (ln(f) - ln(0.25D)) / ln(0.01D / 0.25D)"), 0)
    return rows.groupBy("signal", "t", F.greatest(F.least(at, F.lit(223)), F.lit(0)).cast("int").alias("bin")).agg(F.max("e").alias("h"))


@query("hht_spectrum", _SPECTRUM + "SELECT signal, t, bin, round(h, 5) AS h FROM spec")
def hht_spectrum(spark, d):
    return _spectrum(spark, d).select("signal", "t", "bin", F.round("h", 5).alias("h"))


@query("instantaneous_energy", _SPECTRUM + "SELECT signal, t, round(sum(h * h), 4) AS energy FROM spec GROUP BY ALL")
def instantaneous_energy(spark, d):
    return _spectrum(spark, d).groupBy("signal", "t").agg(F.round(F.sum(F.col("h") * F.col("h")), 4).alias("energy"))


@query("freq_smooth", SAMPLES + "SELECT channel, t, round(sum(x) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) + 0.0 AS v FROM samples")
def freq_smooth(spark, d):
    """Moving average of width 5 with zero padding: the divisor is always the width."""
    w = Window.partitionBy("channel").orderBy("t").rowsBetween(-2, 2)
    return samples(spark, d).select("channel", "t", (F.round(F.sum("x").over(w) / 5, 6) + 0.0).alias("v"))


@query("band_scales", "WITH g AS (SELECT k, 0.25 * power(0.01 / 0.25, k / 223.0::double) AS f FROM (SELECT unnest(range(224)) AS k)) SELECT CASE WHEN f >= 0.01 AND f < 0.027 THEN 'slow_5' WHEN f >= 0.027 AND f < 0.073 THEN 'slow_4' WHEN f >= 0.073 AND f < 0.198 THEN 'slow_3' WHEN f >= 0.198 AND f < 0.25 THEN 'slow_2_trunc' END AS band, min(k) AS first, max(k) AS last FROM g WHERE f >= 0.01 AND f < 0.25 GROUP BY 1")
def band_scales(spark, d):
    """First and last scale of each slow band on the wavelet grid."""
    g = spark.range(224).withColumn("f", F.expr("0.25D * power(0.01D / 0.25D, id / 223D)")).withColumn("band", band_of(F.col("f")))
    return g.where("band is not null").groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last"))


@query("cwt_normalised")
def cwt_normalised(spark, d):
    """Power at all scales, divided by the largest of its channel (0 stays 0)."""
    return scalogram(_embeddings(spark, d), normalised=True)


@query(
    "log_bin_sum",
    """WITH f AS (SELECT vec_id, 0.01 + 0.24 * (vec_id % 97) / 97.0::double AS f FROM embeddings), bins AS (SELECT k, 0.01 * power(25, k / 15.0::double) AS b FROM (SELECT unnest(range(16)) AS k)),
    m AS (SELECT vec_id, arg_min(k, (round(abs(f - b), 10), k)) AS bin FROM f CROSS JOIN bins GROUP BY ALL), s AS (SELECT vec_id, label AS run, unnest(range(len(embedding)))::int AS t, unnest(embedding)::double AS x FROM embeddings)
    SELECT run, bin, t, round(sum(x), 4) + 0.0 AS x FROM s JOIN m USING (vec_id) GROUP BY ALL""",
)
def log_bin_sum(spark, d):
    """Modes (embeddings, with the frequencies of log_bin_map) of a run (label) summed in each log-frequency bin."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("run"), F.posexplode("embedding").alias("t", "x"))
    return e.join(log_bin_map(spark, d), "vec_id").groupBy("run", "bin", "t").agg((F.round(F.sum(F.col("x").cast("double")), 4) + 0.0).alias("x"))
