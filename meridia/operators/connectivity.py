"""Functional connectivity as edge lists, its averages, and group inference on edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.series import fisher_z, pearson
from meridia.operators.ranges import cut_points, running

#: Bytes that the shuffled labels of a study may take.
LABELS = 256 << 20
#: The slow frequency bands, [low, high) in Hz.
BANDS = (("slow_5", 0.010, 0.027), ("slow_4", 0.027, 0.073), ("slow_3", 0.073, 0.198), ("slow_2_trunc", 0.198, 0.250))


def edges(series: DataFrame, keys: list[str], diagonal: bool = True) -> DataFrame:
    """keys, i, j, pearson, fisher_z of all channel pairs i <= j; series: keys, channel, t, x.

    A run's channels at one time are gathered in an array (a few hundred values) and paired inside
    it, so the pairing costs no join; sums are combined before the shuffle.
    """
    at = series.groupBy(*keys, "t").agg(F.array_sort(F.collect_list(F.struct("channel", "x"))).alias("c"))
    left = at.select(*keys, "c", F.explode("c").alias("l"))
    above = F.filter("c", lambda s: s["channel"] >= F.col("l.channel") if diagonal else s["channel"] > F.col("l.channel"))
    pairs = left.select(*keys, "l", F.explode(above).alias("r"))
    a, b = F.col("l.x"), F.col("r.x")
    sums = pairs.groupBy(*keys, F.col("l.channel").alias("i"), F.col("r.channel").alias("j")).agg(
        F.count("*").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * b).alias("sab"), F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb")
    )
    r = pearson(*[F.col(c) for c in ("n", "sa", "sb", "sab", "saa", "sbb")])
    return sums.select(*keys, "i", "j", r.alias("pearson"), fisher_z(r).alias("fisher_z"))


def edges_gram(runs: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """edges() by one Gram matrix a run, for runs of many channels: rows keys, channel, x (array).

    A run's channels are gathered in one row; Arrow batches then hold many runs, so a small run costs
    no call of its own.
    """
    packed = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("channel", "x"))).alias("c"))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for c in batch.column("c"):
                channel = c.values.field("channel").to_numpy(zero_copy_only=False)
                x = c.values.field("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(channel), -1)
                x -= x.mean(1, keepdims=True)
                sd = np.sqrt((x * x).mean(1))
                i, j = np.triu_indices(len(x))
                both = sd[i] * sd[j]
                r = np.divide((x @ x.T)[i, j] / x.shape[1], both, out=np.full(len(i), np.nan), where=both > 0)
                parts.append((channel[i], channel[j], r))
            if parts:
                i, j, r = map(np.concatenate, zip(*parts))
                of = pa.array(np.repeat(np.arange(batch.num_rows), [len(p[0]) for p in parts]))
                cols = [batch.column(k).take(of) for k in keys] + [pa.array(i), pa.array(j), pa.array(r), pa.array(np.arctanh(np.clip(r, -0.9999, 0.9999)))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "i", "j", "pearson", "fisher_z"])

    return packed.mapInArrow(gram, schema)


def band_of(freq: Column) -> Column:
    """Name of the slow band that holds a frequency; null outside."""
    out = F.lit(None).cast("string")
    for name, low, high in BANDS:
        out = F.when((freq >= low) & (freq < high), name).otherwise(out)
    return out


def mean_z(z: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, j, mean of fisher_z (empty cells skipped) and its correlation."""
    mean = F.avg(F.when(~F.isnan("fisher_z"), F.col("fisher_z")))
    return z.groupBy(*keys, "i", "j").agg(mean.alias("fisher_z_mean")).withColumn("pearson", F.tanh("fisher_z_mean"))


def contrast(means: DataFrame, condition: str, a: str, b: str, keys: list[str]) -> DataFrame:
    """Mean of condition a less that of b; keys that lack a side go."""
    side = lambda v: F.avg(F.when(F.col(condition) == v, F.col("fisher_z_mean")))
    return means.groupBy(*keys, "i", "j").agg((side(a) - side(b)).alias("contrast")).where("contrast is not null")


def welch(z: DataFrame, keys: list[str], case: Column, value: str = "z") -> DataFrame:
    """Welch's t by keys; 0 with fewer than two values in a group or no variance."""
    out = z.groupBy(*keys).agg(*[f(F.when(c, F.col(value))).alias(n) for c, s in ((case, "1"), (~case, "0")) for f, n in ((F.count, f"n{s}"), (F.avg, f"m{s}"), (F.var_samp, f"v{s}"))])
    se = F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
    few = (F.col("n1") < 2) | (F.col("n0") < 2)
    return out.select(*keys, F.when(few, 0.0).otherwise(F.coalesce(F.try_divide(F.col("m1") - F.col("m0"), se), F.lit(0.0))).alias("t"))


def shuffled_labels(spark, subjects: list, cases: int, permutations: int, seed: int = 42) -> np.ndarray:
    """(permutations, subjects) of who is a case: in each permutation the first by md5.

    Their size is set by parameters: permutations and the subjects of one study, a bit each; LABELS bytes at most.
    """
    if permutations * len(subjects) > 8 * LABELS:
        raise ValueError(f"{permutations} permutations of {len(subjects)} subjects need over {LABELS} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b in batch.column("id").to_pylist():
                order = sorted(range(len(subjects)), key=lambda k: hashlib.md5(f"{seed}:{b}:{subjects[k]}".encode()).digest())
                case = np.zeros(len(subjects), bool)
                case[order[:cases]] = True
                rows.append(np.packbits(case).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.binary())], names=["perm", "bits"])

    got = spark.range(permutations).mapInArrow(run, "perm long, bits binary").toArrow().sort_by("perm")
    return np.unpackbits(np.frombuffer(b"".join(got["bits"].to_pylist()), np.uint8).reshape(permutations, -1), axis=1, count=len(subjects)).astype(bool)


def welch_matrix(x: np.ndarray, cases: np.ndarray) -> np.ndarray:
    """Welch's t of edges x (edges, subjects; NaN: missing) for each row of cases (labellings, subjects)."""
    there = ~np.isnan(x)
    n = there.sum(1, keepdims=True)
    x = np.where(there, x, 0)
    x = np.where(there, x - x.sum(1, keepdims=True) / np.maximum(n, 1), 0)
    label = cases.T.astype(float)
    n1, s1, q1 = there @ label, x @ label, (x * x) @ label
    n0, s0, q0 = n - n1, x.sum(1, keepdims=True) - s1, (x * x).sum(1, keepdims=True) - q1
    with np.errstate(divide="ignore", invalid="ignore"):
        square = sum(np.maximum(0, (q - s * s / m) / (m - 1)) / m for m, s, q in ((n1, s1, q1), (n0, s0, q0)))
        t = (s1 / n1 - s0 / n0) / np.sqrt(square)
    floor = 1e-24 * (x * x).sum(1, keepdims=True)
    return np.where((n1 < 2) | (n0 < 2) | ~(square > floor), 0, t)


def permuted(z: DataFrame, subjects: DataFrame, permutations: int, seed: int = 42, primary: float | None = None, blocks: int = 256) -> DataFrame:
    """Group statistics of edges z (subject, i, j, z) under shuffled labels of subjects (subject, is_case), as rows by kind:

    edge: i, j, t, hits (permutations whose |t| reaches the edge's); top: perm and the largest |t| of a block of edges;
    over: perm (-1: as observed), i, j of edges with |t| >= primary.

    Edges are shuffled once, by block, whatever the number of permutations; a task meets the label matrix with its
    block's edges in matrix products.
    """
    people = subjects.orderBy("subject").toArrow()
    names, case = people["subject"].to_pylist(), np.array(people["is_case"].to_pylist(), bool)
    spark = z.sparkSession
    sent = spark.sparkContext.broadcast((names, case, shuffled_labels(spark, names, int(case.sum()), permutations, seed)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, case, labels = sent.value
        place = pd.Series(range(len(names)), index=names)
        code, pairs = pd.factorize(pd.MultiIndex.from_frame(pdf[["i", "j"]]))
        x = np.full((len(pairs), len(names)), np.nan)
        x[code, place.reindex(pdf["subject"]).to_numpy()] = pdf["z"].to_numpy(float)
        i, j = (pairs.get_level_values(c).to_numpy() for c in (0, 1))
        observed = welch_matrix(x, case[None])[:, 0]
        hits, parts = np.zeros(len(i), np.int64), []

        def over(t: np.ndarray, first: int) -> None:
            at, perm = np.nonzero(np.abs(t) >= primary)
            parts.append(pd.DataFrame({"kind": "over", "perm": perm + first, "i": i[at], "j": j[at], "t": t[at, perm], "hits": 0}))

        if primary is not None:
            over(observed[:, None], -1)
        for first in range(0, permutations, 256):
            t = welch_matrix(x, labels[first : first + 256])
            size = np.abs(t)
            hits += (size >= np.abs(observed)[:, None] * (1 - 1e-12)).sum(1)
            parts.append(pd.DataFrame({"kind": "top", "perm": np.arange(first, first + t.shape[1]), "i": 0, "j": 0, "t": size.max(0), "hits": 0}))
            if primary is not None:
                over(t, first)
        parts.append(pd.DataFrame({"kind": "edge", "perm": -1, "i": i, "j": j, "t": observed, "hits": hits}))
        return pd.concat(parts, ignore_index=True)

    kinds = dict(z.dtypes)
    schema = f"kind string, perm long, i {kinds['i']}, j {kinds['j']}, t double, hits long"
    block = F.pmod(F.xxhash64("i", "j"), F.lit(blocks)).alias("block")
    return z.select("subject", "i", "j", F.col("z").cast("double").alias("z"), block).groupBy("block").applyInPandas(run, schema)


def permutation_p(stats: DataFrame, permutations: int) -> DataFrame:
    """i, j, t, uncorrected p (1 + hits) / (B + 1), and family-wise p against the largest |t|, from permuted()."""
    largest = stats.where("kind = 'top'").groupBy("perm").agg(F.max("t").alias("top")).agg(F.sort_array(F.collect_list("top")).alias("tops"))
    out = stats.where("kind = 'edge'").withColumn("tops", largest.scalar())  # permutations values: a parameter
    top = F.size(F.filter("tops", lambda v: v >= F.abs(F.col("t")) * (1 - 1e-12)))
    return out.select("i", "j", "t", ((1 + F.col("hits")) / (permutations + 1)).alias("p_uncorr"), ((1 + top) / (permutations + 1)).alias("p_fwer"))


def bh_fdr(p: DataFrame, column: str, tie: list[str], by: list[str] | None = None) -> DataFrame:
    """q: min(1, p * n / rank), made monotone from the largest p down; in each group of by, or over the whole table by ranges of p."""
    if by:
        part = Window.partitionBy(*by)
        ranked = p.withColumn("_rank", F.row_number().over(part.orderBy(column, *tie))).withColumn("_n", F.count("*").over(part))
        down = part.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return ranked.withColumn("q", F.min(F.least(F.lit(1.0), F.col(column) * F.col("_n") / F.col("_rank"))).over(down)).drop("_rank", "_n")
    ranked = running(p.withColumn("_one", F.lit(1)), column, ["_one"], cut_points(p, column), tie, down=False)
    ranked = ranked.withColumn("_raw", F.least(F.lit(1.0), F.col(column) * F.col("_one_all") / F.col("_one_to")))
    beyond = Window.orderBy("range_").rowsBetween(1, Window.unboundedFollowing)  # a row a range
    later = ranked.groupBy("range_").agg(F.min("_raw").alias("_least")).select("range_", F.min("_least").over(beyond).alias("_later"))
    down = Window.partitionBy("range_").orderBy(F.col("_one_to").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranked.join(F.broadcast(later), "range_").withColumn("q", F.least(F.min("_raw").over(down), F.col("_later")))
    return out.select(*p.columns, "q")


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, j, component: the least node that an edge's nodes reach.

    A graph's edges (at most channels squared) are gathered in one row and joined there, so a
    thousand permutations are a thousand independent rows and no iteration over the table.
    """

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        up: dict = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for i, j in zip(pdf["i"], pdf["j"]):
            low, high = sorted((find(i), find(j)))
            up[high] = low
        return pdf.assign(component=[find(i) for i in pdf["i"]])

    kinds = dict(edges.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "i", "j"]) + f", component {kinds['i']}"
    return edges.select(*keys, "i", "j").groupBy(*keys).applyInPandas(joined, schema)


def group_statistics(z: DataFrame, subjects: DataFrame, permutations: int, primary: float, seed: int = 42, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Whole group inference from one set of shuffled labels: a table of edges and one of components.

    edges: i, j, t, p_uncorr, p_fwer, q, component (null under the primary threshold), p_component, mask (p_component < alpha).
    components: component, size (edges), p. The permuted statistics are kept in memory and on disk for both, as
    they cost far more than what follows.
    """
    stats = permuted(z, subjects, permutations, seed, primary).persist()
    sizes = components(stats.where("kind = 'over'").select("perm", "i", "j"), ["perm"])
    own = sizes.where("perm = -1").select("i", "j", "component")
    sizes = sizes.groupBy("perm", "component").agg(F.count("*").alias("size"))
    tops = sizes.where("perm >= 0").groupBy("perm").agg(F.max("size").alias("size")).agg(F.collect_list("size").alias("s")).scalar()
    table = sizes.where("perm = -1").withColumn("tops", tops)  # permutations values: a parameter
    table = table.select("component", "size", ((1 + F.size(F.filter("tops", lambda s: s >= F.col("size")))) / (permutations + 1)).alias("p"))
    q = bh_fdr(permutation_p(stats, permutations), "p_uncorr", ["i", "j"])
    member = own.join(table.select("component", F.col("p").alias("p_component")), "component")
    edges = q.join(member, ["i", "j"], "left").withColumn("mask", F.coalesce(F.col("p_component") < alpha, F.lit(False)))
    return edges.select("i", "j", "t", "p_uncorr", "p_fwer", "q", "component", "p_component", "mask"), table
