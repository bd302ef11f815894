"""The study's tables as a Parquet lake: atomic partition writes, a run manifest, and delimited exports."""

from __future__ import annotations

import json
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(parameters: dict) -> str:
    """A short stable name of a parameter set; part of a partition's key, so a change never meets stale rows."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write(df: DataFrame, root: str, name: str, by: list[str]) -> None:
    """Overwrite only the partitions that df has rows for; the commit is atomic."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def missing(wanted: DataFrame, spark: SparkSession, root: str, name: str, keys: list[str]) -> DataFrame:
    """Rows of wanted whose keys the table does not have yet: what a restarted stage still has to do."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return wanted
    return wanted.join(read(spark, root, name).select(*keys).distinct(), keys, "left_anti")


def write_tsv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One tab-separated file with a header, sorted, nulls first."""
    out = df.orderBy(*[F.col(c).asc_nulls_first() for c in order]) if order else df
    out.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_report(report: DataFrame, samples: DataFrame, path: str, run: str) -> None:
    """A nested JSON report and the per-sample rows of one run, side by side under its name."""
    report.write.mode("overwrite").json(f"{path}/run={run}/report")
    write_tsv(samples, f"{path}/run={run}/samples")


#: Stage tables and the columns that partition them: few values each, whatever the number of subjects.
STAGES = {"series": ["task"], "blocks": ["task"], "scalograms": ["task"], "modes": ["task"], "connectivity": ["task", "level"], "features": ["task", "source"], "group_edges": ["task"], "group_components": ["task"]}


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Names of what a pattern meets, by Spark's own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().getName() for f in found or []]


def write_stage(df: DataFrame, root: str, stage: str, parameters: dict, overwrite: bool = False, key: str | None = None) -> None:
    """Write a stage's rows with the fingerprint of their parameters, which is the outermost partition.

    Without overwrite, rows whose key is there for the same parameters stay as they are and only new ones are added, so a
    stage that was stopped goes on. The parameters go to the table `attributes`, once a fingerprint.
    """
    spark, name = df.sparkSession, fingerprint(parameters)
    here = f"{root}/{stage}/fingerprint={name}"
    if not _paths(spark, f"{root}/attributes/stage={stage}/fingerprint={name}"):
        facts = [(stage, name, k, json.dumps(v, default=str)) for k, v in sorted(parameters.items())] or [(stage, name, "", "null")]
        spark.createDataFrame(facts, "stage string, fingerprint string, name string, value string").write.mode("append").partitionBy("stage", "fingerprint").parquet(f"{root}/attributes")
    if overwrite:
        df.write.mode("overwrite").partitionBy(*STAGES[stage]).parquet(here)
        return
    if key and _paths(spark, here):
        df = df.join(spark.read.parquet(here).select(key).distinct(), key, "left_anti")
    df.write.mode("append").partitionBy(*STAGES[stage]).parquet(here)


def read_stage(spark: SparkSession, root: str, stage: str, parameters: dict) -> DataFrame:
    """Rows of a stage for these parameters; fails where they were never written."""
    return spark.read.parquet(f"{root}/{stage}/fingerprint={fingerprint(parameters)}")


def stale(spark: SparkSession, root: str, stage: str, parameters: dict) -> bool:
    """Whether a stage has rows, but none for these parameters."""
    there = _paths(spark, f"{root}/{stage}/fingerprint=*")
    return bool(there) and f"fingerprint={fingerprint(parameters)}" not in there


def next_run(spark: SparkSession, path: str) -> str:
    """Name of a run that comes after all under path, so that no report is overwritten."""
    numbers = [int(n[4:]) for n in _paths(spark, f"{path}/run=*") if n[4:].isdigit()]
    return f"{max(numbers, default=0) + 1:04d}"


def write_splits(rows: DataFrame, path: str, key: str = "subjectkey") -> None:
    """One sorted table of keys a split."""
    for name in ("train", "calibration", "holdout"):
        write_tsv(rows.where(F.col("split") == name).select(key).distinct(), f"{path}/{name}", [key])


def dump(df: DataFrame, path: str, enabled: bool) -> DataFrame:
    """df itself, written out as a table for diagnosis where that is enabled."""
    if enabled:
        write_tsv(df, path)
    return df
