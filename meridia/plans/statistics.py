"""Queries of the per-series statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.catalog import query
from meridia.functions import series as S
from meridia.plans.adapters import SAMPLES, SERIES, samples, series, table

BY = ["subject", "channel"]
_W = "OVER (PARTITION BY subject, channel)"


def _with(column):
    """A query of the column that column() makes; columns can only be made while a session is up."""
    return lambda spark, d: series(spark, d).select("subject", "channel", "t", F.round(column(), 6).alias("v"))


query("zscore_sample", SERIES + f"SELECT subject, channel, t, round(CASE WHEN stddev_samp(x) {_W} < 1e-15 THEN x - avg(x) {_W} ELSE (x - avg(x) {_W}) / stddev_samp(x) {_W} END, 6) AS v FROM series")(_with(lambda: S.zscore("x", BY)))
query("zscore_voxel", SERIES + f"SELECT subject, channel, t, round(CASE WHEN stddev_samp(x) {_W} < 1e-15 THEN x ELSE (x - avg(x) {_W}) / stddev_samp(x) {_W} END, 6) AS v FROM series")(_with(lambda: S.zscore("x", BY, keep_constant=True)))
query("psc", SERIES + f"SELECT subject, channel, t, round(CASE WHEN abs(avg(x) {_W}) < 1e-15 THEN 0 ELSE (x - avg(x) {_W}) / abs(avg(x) {_W}) * 100 END, 6) AS v FROM series")(_with(lambda: S.percent_change("x", BY)))
query("detrend", SERIES + f"SELECT subject, channel, t, round(x - (regr_intercept(x, t) {_W} + regr_slope(x, t) {_W} * t), 6) + 0.0 AS v FROM series")(lambda spark, d: series(spark, d).select("subject", "channel", "t", (F.round(S.detrended("x", "t", BY), 6) + 0.0).alias("v")))
query("minmax", SERIES + f"SELECT subject, channel, t, round((x - min(x) {_W}) / (max(x) {_W} - min(x) {_W} + 1e-8), 6) AS v FROM series")(_with(lambda: S.minmax("x", BY)))


@query("preprocess", SERIES + f", d AS (SELECT *, x - (regr_intercept(x, t) {_W} + regr_slope(x, t) {_W} * t) AS y FROM series) SELECT subject, channel, t, round(CASE WHEN stddev_samp(y) {_W} < 1e-9 THEN 0 ELSE (y - avg(y) {_W}) / stddev_samp(y) {_W} END, 5) + 0.0 AS v FROM d")
def preprocess(spark, d):
    flat = series(spark, d).withColumn("y", S.detrended("x", "t", BY)).withColumn("y", F.when(F.abs("y") < 1e-9, 0.0).otherwise(F.col("y")))
    return flat.select("subject", "channel", "t", (F.round(S.zscore("y", BY), 5) + 0.0).alias("v"))


@query("zscore_population", SAMPLES + "SELECT channel, t, round(CASE WHEN stddev_pop(x) OVER w = 0 THEN 0 ELSE (x - avg(x) OVER w) / stddev_pop(x) OVER w END, 6) + 0.0 AS v FROM samples WINDOW w AS (PARTITION BY t)")
def zscore_population(spark, d):
    return samples(spark, d).select("channel", "t", (F.round(S.zscore("x", ["t"], sample=False), 6) + 0.0).alias("v"))


@query(
    "scrub_nonfinite",
    """WITH v AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'nan'::double WHEN event_id % 11 = 0 THEN 'infinity'::double WHEN event_id % 13 = 0 THEN '-infinity'::double ELSE value END AS v FROM events)
    SELECT event_id, CASE WHEN isfinite(v) THEN v ELSE 0 END AS v, (NOT isfinite(v))::int AS scrubbed FROM v""",
)
def scrub_nonfinite(spark, d):
    v = F.expr("case when event_id % 7 = 0 then double('NaN') when event_id % 11 = 0 then double('Infinity') when event_id % 13 = 0 then double('-Infinity') else value end")
    rows = table(spark, d, "events").select("event_id", v.alias("v"))
    return rows.select("event_id", S.scrub(F.col("v")).alias("v"), (F.isnan("v") | (F.abs("v") == float("inf"))).cast("int").alias("scrubbed"))


@query("vector_mean", "WITH e AS (SELECT label, unnest(range(64))::int AS dim, unnest(embedding)::double AS x FROM embeddings) SELECT label, dim, round(avg(x), 6) AS mean FROM e GROUP BY ALL")
def vector_mean(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
