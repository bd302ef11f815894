"""Queries of image preparation, block strategies and network features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from meridia.catalog import query
from meridia.operators import signal as G
from meridia.plans.adapters import SAMPLES, SERIES, samples, series, table
from meridia.plans.signals import per_signal


def chunk(t: str, length: int, parts: int = 3):
    """Number of the equal chunk that a sample lies in; null in the tail that is dropped."""
    width = length // parts
    return F.when(F.col(t) < parts * width, F.floor(F.col(t) / width).cast("int"))


@query("chunk_time", SAMPLES + "SELECT channel, (t // 21)::int AS chunk, count(*) AS n, round(avg(x), 6) + 0.0 AS mean FROM samples WHERE t < 63 GROUP BY ALL")
def chunk_time(spark, d):
    s = samples(spark, d).withColumn("chunk", chunk("t", 64)).where("chunk is not null")
    return s.groupBy("channel", "chunk").agg(F.count("*").alias("n"), (F.round(F.avg("x"), 6) + 0.0).alias("mean"))


@query(
    "trim_mean_blocks",
    SERIES + ", b AS (SELECT subject, channel, t // 7 AS block, t % 7 AS pos, x, count(*) OVER (PARTITION BY subject, channel, t // 7) AS len FROM series) SELECT channel, pos::int AS pos, round(avg(x), 5) AS mean, count(*) AS blocks FROM b WHERE len >= 6 AND pos < 6 GROUP BY ALL",
)
def trim_mean_blocks(spark, d):
    """Blocks of six samples or more, cut to six, averaged by channel and position."""
    b = series(spark, d).withColumn("block", F.expr("t div 7")).withColumn("pos", F.expr("int(t % 7)"))
    b = b.withColumn("len", F.count("*").over(Window.partitionBy("subject", "channel", "block"))).where("len >= 6 and pos < 6")
    return b.groupBy("channel", "pos").agg(F.round(F.avg("x"), 5).alias("mean"), F.count("*").alias("blocks"))


@query(
    "shuffled_concat",
    SERIES
    + """, o AS (SELECT *, md5(concat('42:', t // 5)) AS k FROM series), r AS (SELECT subject, channel, x, row_number() OVER (PARTITION BY subject, channel ORDER BY k, t) - 1 AS pos FROM o)
    SELECT subject, channel, pos::int AS pos, round(x, 6) AS x FROM r""",
)
def shuffled_concat(spark, d):
    """Blocks of five days in md5 order, one after the other."""
    blocks = series(spark, d).groupBy("subject", "channel", F.expr("t div 5").alias("block")).agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("b"))
    order = F.struct(F.md5(F.concat(F.lit("42:"), F.col("block").cast("string"))).alias("k"), F.transform("b", lambda s: s["x"]).alias("x"))
    joined = blocks.groupBy("subject", "channel").agg(F.array_sort(F.collect_list(order)).alias("o"))
    return joined.select("subject", "channel", F.posexplode(F.flatten(F.transform("o", lambda s: s["x"]))).alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(
    "quantize_onehot",
    SAMPLES + "SELECT channel, t, greatest(least(floor((x - min(x) OVER w) / CASE WHEN max(x) OVER w = min(x) OVER w THEN 1 ELSE max(x) OVER w - min(x) OVER w END * 223), 223), 0)::int AS level FROM samples WINDOW w AS (PARTITION BY channel)",
)
def quantize_onehot(spark, d):
    """The one of 224 levels that each sample takes within its channel's range."""
    w = Window.partitionBy("channel")
    low, high = F.min("x").over(w), F.max("x").over(w)
    span = F.when(high == low, 1.0).otherwise(high - low)
    return samples(spark, d).select("channel", "t", F.greatest(F.least(F.floor((F.col("x") - low) / span * 223), F.lit(223)), F.lit(0)).cast("int").alias("level"))


@query(
    "image_pad_norm",
    SAMPLES
    + """, g AS (SELECT channel, t, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w + 1e-8) AS v FROM samples WINDOW w AS (PARTITION BY channel)), p AS (SELECT c.channel, t.t, coalesce(v, 0) AS v FROM (SELECT DISTINCT channel FROM g) c CROSS JOIN (SELECT unnest(range(224))::int AS t) t LEFT JOIN g ON g.channel = c.channel AND g.t = t.t)
    SELECT channel, t, round((v - 0.485) / 0.229, 5) + 0.0 AS r, round((v - 0.456) / 0.224, 5) + 0.0 AS g, round((v - 0.406) / 0.225, 5) + 0.0 AS b FROM p""",
)
def image_pad_norm(spark, d):
    """Rows scaled to 0..1, zero-padded to 224 and normalised by colour channel."""
    w = Window.partitionBy("channel")
    s = samples(spark, d).withColumn("v", (F.col("x") - F.min("x").over(w)) / (F.max("x").over(w) - F.min("x").over(w) + 1e-8))
    packed = s.groupBy("channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda e: e["v"]).alias("v"))
    padded = packed.select("channel", F.posexplode(F.concat("v", F.array_repeat(F.lit(0.0), 224 - 64))).alias("t", "v"))
    return padded.select("channel", "t", *[(F.round((F.col("v") - m) / s, 5) + 0.0).alias(n) for n, m, s in zip("rgb", G.MEAN.tolist(), G.STD.tolist())])


@query("image_resize")
def image_resize(spark, d):
    """Each embedding as an 8 x 8 image, resized to 16 x 16 bicubically."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("channel"), F.col("embedding").alias("x"))
    out = per_signal(e, lambda x: G.resize(x.reshape(-1, 8, 8), 16, 16).reshape(len(x), -1))
    return out.select("channel", F.transform("v", lambda v: F.round(v, 6)).alias("image"))


@query("cnn_features")
def cnn_features(spark, d):
    """Features of the mean image of each label from a small dense network with seeded weights."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("t", "x")).groupBy("label", "t").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("x")).select(F.col("label").cast("long").alias("channel"), "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = G.DenseNet(G.random_weights(7), blocks=(2, 2), growth=8, start=16)
        for batch in batches:
            out = []
            for x in batch.column("x").to_pylist():
                image = np.array(x).reshape(8, 8)
                image = (image - image.min()) / (image.max() - image.min() + 1e-8)
                out.append(np.round(net.features(G.to_rgb(G.resize(image, 32, 32))), 6).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("channel"), pa.array(out, pa.list_(pa.float64()))], names=["channel", "v"])

    return rows.mapInArrow(run, "channel long, v array<double>").select(F.col("channel").alias("label"), F.col("v").alias("features"))


@query("quantize_global", SAMPLES + "SELECT channel, t, greatest(least(floor((x - (SELECT min(x) FROM samples)) / (SELECT CASE WHEN max(x) = min(x) THEN 1 ELSE max(x) - min(x) END FROM samples) * 223), 223), 0)::int AS level FROM samples")
def quantize_global(spark, d):
    """The one of 224 levels that each sample takes within the range of all channels."""
    s = samples(spark, d)
    low, high = s.agg(F.min("x").alias("v")).scalar(), s.agg(F.max("x").alias("v")).scalar()
    ranged = s.withColumn("low", low).withColumn("high", high)
    span = F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low"))
    return ranged.select("channel", "t", F.greatest(F.least(F.floor((F.col("x") - F.col("low")) / span * 223), F.lit(223)), F.lit(0)).cast("int").alias("level"))


@query("resized_mean")
def resized_mean(spark, d):
    """Mean over a label's embeddings of their 8 x 8 images, each resized to 16 x 16 before."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("channel"), "label", F.col("embedding").alias("x"))
    big = per_signal(e, lambda x: G.resize(x.reshape(-1, 8, 8), 16, 16).reshape(len(x), -1))
    cells = big.join(e.select("channel", "label"), "channel").select("label", F.posexplode("v").alias("cell", "x"))
    return cells.groupBy("label", "cell").agg(F.round(F.avg("x"), 6).alias("mean"))
