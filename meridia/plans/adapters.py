"""Study entities on the driver's tables: events as runs, embeddings as signals, customers as a phenotype."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Channels of the daily series, in order, and its days.
CHANNELS = ("click", "error", "purchase", "signup", "view")
DAYS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, channel, t, x: the daily sum of values by user and event type; missing days are 0."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "value")
    first = events.agg(F.min("day").alias("d")).scalar()
    daily = events.groupBy("user_id", "event_type", F.datediff("day", first).alias("t")).agg(F.sum("value").alias("v"))
    types = F.explode(F.array(*[F.struct(F.lit(c).alias("event_type"), F.lit(i).alias("channel")) for i, c in enumerate(CHANNELS)]))
    grid = events.select("user_id").distinct().select("user_id", types.alias("c")).select("user_id", "c.*", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))).alias("t"))
    return grid.join(daily, ["user_id", "event_type", "t"], "left").select(F.col("user_id").alias("subject"), "channel", "t", F.coalesce("v", F.lit(0.0)).alias("x"))


SERIES = """WITH d0 AS (SELECT min(ts)::date AS d FROM events),
daily AS (SELECT user_id, event_type, (ts::date - (SELECT d FROM d0))::int AS t, sum(value) AS v FROM events GROUP BY ALL),
types AS (SELECT * FROM (VALUES ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4)) AS v(event_type, channel)),
grid AS (SELECT user_id, event_type, channel, t FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN types CROSS JOIN (SELECT unnest(range(30))::int AS t)),
series AS (SELECT g.user_id AS subject, g.channel::int AS channel, g.t, coalesce(v, 0)::double AS x FROM grid g LEFT JOIN daily d ON d.user_id = g.user_id AND d.event_type = g.event_type AND d.t = g.t)
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, t, x: each embedding as a signal of 64 samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("channel"), F.posexplode("embedding").alias("t", "x")).withColumn("x", F.col("x").cast("double"))


SAMPLES = """WITH samples AS (SELECT vec_id AS channel, unnest(range(len(embedding)))::int AS t, unnest(embedding)::double AS x FROM embeddings)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, p: labelled documents with a score that leans to their quality."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.expr("0.1D + 0.3D * quality + 0.5D * ((doc_id * 7919) % 100) / 100D").alias("p"))


SCORED = """WITH scored AS (SELECT doc_id AS id, quality AS y, 0.1::double + 0.3::double * quality + 0.5::double * ((doc_id * 7919) % 100) / 100::double AS p FROM labels)
"""
