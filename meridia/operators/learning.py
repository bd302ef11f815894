"""Splits, nearest neighbours, PCA, forests and calibrators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAIN, HOLDOUT, SEED = 0.70, 0.15, 42


def stratified(df: DataFrame, key: str, label: str, seed: int = SEED) -> DataFrame:
    """split of each row: in md5 order within its class, 70 % train, 15 % holdout, the rest calibration."""
    w = Window.partitionBy(label)
    rank = F.row_number().over(w.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key))
    n = F.count("*").over(w)
    a, b = F.round(n * TRAIN), F.round(n * HOLDOUT)
    return df.withColumn("split", F.when(rank <= a, "train").when(rank <= a + b, "holdout").otherwise("calibration"))


def by_subject(df: DataFrame, subject: str, label: str, seed: int = SEED) -> DataFrame:
    """split of each row by its subject, so no subject is on two sides."""
    subjects = stratified(df.select(subject, label).distinct(), subject, label, seed)
    return df.join(subjects.select(subject, "split"), subject)


def balanced(df: DataFrame, key: str, label: str, seed: int = SEED) -> DataFrame:
    """Training rows cut to the smallest class, in md5 order; other splits stay whole."""
    train = df.where("split = 'train'")
    least = train.groupBy(label).count().agg(F.min("count")).scalar()
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key))
    return train.withColumn("_rank", rank).where(F.col("_rank") <= least).drop("_rank").unionByName(df.where("split <> 'train'"))


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows) distances."""
    dots = q @ x.T
    if metric == "cosine":
        return 1 - dots / np.maximum(np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)), 1e-8)
    return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * dots, 0))


def _best(d: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least distances of each row with their ids and labels, in order; ties go to the least id."""
    if d.shape[1] > 4 * k:
        edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        most = int((d <= edge).sum(1).max())  # k, or more where distances tie
        near = np.argpartition(d, most - 1, axis=1)[:, :most]
        d, ids, y = (np.take_along_axis(x, near, 1) for x in (d, ids, y))
    order = np.lexsort((ids, d), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (d, ids, y))


def vectors(col: pa.Array) -> np.ndarray:
    """(rows, dimensions) of a column of equally long arrays, from its flat values."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def nearest(train: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = 4096) -> DataFrame:
    """query, rank, id, y, distance: the k nearest rows of train (id, y, v) for each of queries (id, v); never itself.

    Queries are sent out in blocks of bounded size; each task keeps its own k best a query, so what is
    shuffled is k rows a query and task, whatever the size of train.
    """
    spark = train.sparkSession
    out = None
    blocks = max(1, -(-queries.count() // block))
    for part in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == part).toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((got["id"].to_numpy(), vectors(got["v"].combine_chunks()) if got.num_rows else np.zeros((0, 0))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            d, own, y = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows if len(ids) else 0, 4096):
                    rows = batch.slice(at, 4096)
                    new = rows.column("id").to_numpy(zero_copy_only=False)
                    far = distances(q, vectors(rows.column("v")), metric)
                    far[ids[:, None] == new] = np.inf
                    label = rows.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
                    wide = [np.concatenate([x, np.broadcast_to(z, far.shape)], axis=1) for x, z in ((d, far), (own, new), (y, label))]
                    d, own, y = _best(*wide, k)
            keep = np.isfinite(d)
            cols = np.repeat(ids, keep.sum(1)), own[keep], y[keep], d[keep]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["query", "id", "y", "distance"])

        found = train.select("id", "y", "v").mapInArrow(run, "query long, id long, y int, distance double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def vote(neighbours: DataFrame) -> DataFrame:
    """query, p, predicted: weights 1 / (distance + 1e-8), ties to the smaller label."""
    w = 1 / (F.col("distance") + 1e-8)
    p = F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)) / F.sum(w)
    return neighbours.groupBy("query").agg(p.alias("p")).withColumn("predicted", (F.col("p") > 0.5).cast("int"))


def vote_classes(neighbours: DataFrame) -> DataFrame:
    """query, predicted, share: the label of the most weight among any number of them, ties to the smaller."""
    votes = neighbours.groupBy("query", "y").agg(F.sum(1 / (F.col("distance") + 1e-8)).alias("w"))
    best = F.max_by("y", F.struct("w", -F.col("y")))
    return votes.groupBy("query").agg(best.alias("predicted"), (F.max("w") / F.sum("w")).alias("share"))


def whiten_diagonal(df: DataFrame, shrink: float) -> DataFrame:
    """v divided by the root of each dimension's sample variance, shrunk toward 1."""
    lam = max(shrink, 1e-6)
    long = df.select(F.posexplode("v").alias("i", "x"))
    var = long.groupBy("i").agg((F.lit(1 - lam) * F.var_samp(F.col("x").cast("double")) + lam).alias("s"))
    scale = var.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: F.sqrt(e["s"])).alias("s")).scalar()
    return df.withColumn("_s", scale).withColumn("v", F.zip_with("v", "_s", lambda a, b: a.cast("double") / b)).drop("_s")


def whiten_full(x: np.ndarray, shrink: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse Cholesky factor of the covariance, shrunk toward its diagonal."""
    lam = max(shrink, 1e-6)
    s = np.cov(x, rowvar=False)
    s = (1 - lam) * s + lam * np.diag(np.diag(s))
    return x.mean(0), np.linalg.inv(np.linalg.cholesky(s))


def pca(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the first min(k, n - 1, d) principal axes (unit rows)."""
    mean = x.mean(0)
    k = min(k, len(x) - 1, x.shape[1])
    return mean, np.linalg.svd(x - mean, full_matrices=False)[2][:k]


def platt(df: DataFrame, rounds: int = 30) -> tuple[float, float]:
    """a, b of sigmoid(a p + b) for rows (y, p) with smoothed targets; (1, 0) where nothing can be fitted.

    Iteratively reweighted least squares: a round is one aggregation of five sums, so the driver holds no rows.
    A step that makes the loss worse is halved.
    """
    by = df.where(~F.isnan("p") & (F.abs("p") < float("inf"))).groupBy("p").agg(F.sum((F.col("y") == 1).cast("double")).alias("one"), F.count("*").cast("double").alias("n"))
    by = by.persist()  # a row a distinct score
    try:
        r = by.agg(F.sum("one").alias("one"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("s"), F.sum(F.col("n") * F.col("p") * F.col("p")).alias("q")).first()
        if not r.n or r.n < 4 or r.one in (0, r.n) or r.q / r.n - (r.s / r.n) ** 2 < 1e-12:
            return 1.0, 0.0
        high, low = (r.one + 1) / (r.one + 2), 1 / (r.n - r.one + 2)
        target = F.col("one") * high + (F.col("n") - F.col("one")) * low  # expected positives at the score

        def sums(a: float, b: float):
            z = F.lit(a) * F.col("p") + b
            q = 1 / (1 + F.exp(-z))
            weight, miss = F.col("n") * q * (1 - q), target - F.col("n") * q
            loss = F.col("n") * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - target * z
            cols = loss, miss, miss * F.col("p"), weight, weight * F.col("p"), weight * F.col("p") * F.col("p")
            return by.agg(*[F.sum(c) for c in cols]).first()

        a, b = 0.0, float(np.log(r.one / (r.n - r.one)))
        now = sums(a, b)
        for _ in range(rounds):
            _, m0, m1, w0, w1, w2 = now
            step = np.linalg.lstsq(np.array([[w2, w1], [w1, w0]]), np.array([m1, m0]), rcond=None)[0]
            new, size = None, 1.0
            while size > 1e-4 and (new is None or new[0] > now[0]):
                new, to = sums(a + size * step[0], b + size * step[1]), (a + size * step[0], b + size * step[1])
                size /= 2
            if new[0] > now[0]:
                break
            done = now[0] - new[0] <= 1e-12 * abs(now[0])
            (a, b), now = to, new
            if done:
                break
        return float(a), float(b)
    finally:
        by.unpersist()
