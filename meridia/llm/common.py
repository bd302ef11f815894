"""What the operators share: input tables, the shared folder, lineage cuts and batch slicing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at once; a longer text is handled alone.
SLICE_BYTES = 2 << 20
#: The C library's call that gives freed memory back; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session that names none gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = f"file://{tempfile.mkdtemp(prefix='meridia-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it: its lineage ends there.

    The table goes with forget(), or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meridia-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, target = _folder(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._meridia_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that cut() wrote and nothing needs any more."""
    for df in tables:
        path = getattr(df, "_meridia_path", None)
        if path:
            files, target = _folder(df.sparkSession, path)
            files.delete(target, True)
            files.cancelDeleteOnExit(target)


def release() -> None:
    """Give memory that a worker has freed back to the machine: workers outlive their tasks and stand beside the JVM."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs whose texts together have about limit bytes; then freed memory goes back."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)
    release()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): columns node, label (the smallest node reachable).

    Min-label propagation with pointer jumping: each round takes the least label among the
    neighbours and then the label of that label, so stars and chains end in a few rounds.
    Labels are written to the shared folder after each round. Hubs are safe: labels are
    unique per node, so a hot key is one side of a join that can be split, and minima are
    combined before the shuffle.
    """
    pairs = edges.where("a != b")
    both = cut(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        new = cut(step.join(jump, "low", "left").select("node", F.least("low", "lower").alias("label"), F.expr("least(low, lower) < label").alias("moved")))
        moved = bool(new.where("moved").take(1))
        forget(labels)
        labels = new.select("node", "label")
        labels._meridia_path = new._meridia_path
        if not moved:
            forget(both)
            return labels
