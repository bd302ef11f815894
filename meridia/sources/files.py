"""Readers: delimited tables with declared types, lookup tables, directory listings, NIfTI volumes, safetensors."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", skip: int = 0, null: str = "n/a") -> DataFrame:
    """A table with a header; bad cells are null, and so is the null literal. skip drops lines before the header.

    With skip, the file is read as lines in one task, as such files are small by nature.
    """
    read = spark.read.schema(schema).option("sep", sep).option("nullValue", null).option("mode", "PERMISSIVE")
    if not skip:
        return read.option("header", True).option("enforceSchema", False).csv(path)
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.slice(F.split("value", "\r?\n"), skip + 2, 2**31 - 1 - skip - 2)).alias("value")).where("value <> ''")
    names = spark.createDataFrame([], schema).schema
    parsed = F.from_csv("value", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names), {"sep": sep, "nullValue": null, "mode": "PERMISSIVE"})
    return lines.select(parsed.alias("r")).select("r.*")


def cortical_table(spark: SparkSession, path: str) -> DataFrame:
    """row_index, id from a lookup table of line pairs: an id that starts with 17networks, then a line that starts with its number."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    pairs = lines.withColumn("next", F.lead("line").over(Window.orderBy("n"))).where("line like '17networks%'")
    return pairs.select((F.regexp_extract("next", r"^\s*(\d+)", 1).try_cast("int") - 1).alias("row_index"), F.trim("line").alias("id"))


def subcortical_table(spark: SparkSession, path: str) -> DataFrame:
    """row_index, id from a file with one id a line."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("row_index", "id")).where("trim(id) <> ''").select("row_index", F.trim("id").alias("id"))


def subject_folders(spark: SparkSession, root: str, tasks: list[str]) -> DataFrame:
    """subjectkey and a flag a task, of subjects with both anat and func files; a file counts by its name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = files.select(F.regexp_extract("path", r"/(sub-[^/]+)/", 1).alias("subjectkey"), F.regexp_extract("path", r"/sub-[^/]+/(anat|func)/", 1).alias("kind"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).where("subjectkey <> ''")
    flags = [F.bool_or((F.col("kind") == "func") & F.contains("name", F.lit(f"task-{t}"))).alias(t) for t in tasks]
    return parts.groupBy("subjectkey").agg(F.bool_or(F.col("kind") == "anat").alias("anat"), F.bool_or(F.col("kind") == "func").alias("func"), *flags).where("anat and func").drop("anat", "func")


#: Fixed values of the NIfTI-1 format: numpy types by datatype code.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def read_nifti(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Array (Fortran order, scaled) and 4 x 4 affine of a NIfTI-1 file, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if struct.unpack_from(f"{order}i", data)[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(f"{order}8h", data, 40)
    shape = dim[1 : 1 + dim[0]]
    kind = struct.unpack_from(f"{order}h", data, 70)[0]
    if kind not in NIFTI_TYPES:
        raise ValueError(f"datatype {kind}")
    pix = struct.unpack_from(f"{order}8f", data, 76)
    offset, slope, inter = struct.unpack_from(f"{order}3f", data, 108)
    x = np.frombuffer(data, f"{order}{NIFTI_TYPES[kind]}", int(np.prod(shape)), int(offset)).reshape(shape, order="F")
    if slope not in (0.0, 1.0) or inter:
        x = x * (slope or 1.0) + inter
    qform, sform = struct.unpack_from(f"{order}2h", data, 252)
    affine = np.eye(4)
    if sform > 0:
        affine[:3] = np.array(struct.unpack_from(f"{order}12f", data, 280)).reshape(3, 4)
    elif qform > 0:
        b, c, d, *shift = struct.unpack_from(f"{order}6f", data, 256)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine[:3, :3] = turn * np.array([pix[1], pix[2], pix[3] * (-1 if pix[0] < 0 else 1)])
        affine[:3, 3] = shift
    else:
        affine[:3, :3] = np.diag(pix[1:4])
    return x, affine


def label_volume(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 3-D integer volume; a fourth axis of length 1 goes, any other fails."""
    x, affine = read_nifti(data)
    if x.ndim == 4 and x.shape[3] == 1:
        x = x[..., 0]
    if x.ndim != 3:
        raise ValueError(f"labels have {x.ndim} axes")
    return np.rint(x).astype(np.int64), affine


def resample_labels(labels: np.ndarray, affine: np.ndarray, shape: tuple[int, ...], target: np.ndarray) -> np.ndarray:
    """Labels of the nearest voxel on another grid; 0 outside. Equal shapes are taken to be equal grids."""
    if labels.shape == tuple(shape[:3]):
        return labels
    grid = np.stack(np.meshgrid(*map(np.arange, shape[:3]), indexing="ij"), -1).reshape(-1, 3)
    m = np.linalg.inv(affine) @ target
    at = grid @ m[:3, :3].T + m[:3, 3]
    at = (np.sign(at) * np.floor(np.abs(at) + 0.5)).astype(int)
    inside = ((at >= 0) & (at < labels.shape)).all(1)
    out = np.zeros(len(at), np.int64)
    out[inside] = labels[tuple(at[inside].T)]
    return out.reshape(shape[:3])


def parcellate(bold: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted labels but 0, and the (label, time) means of their voxels."""
    ids = np.unique(labels[labels != 0])
    place = np.searchsorted(ids, labels.ravel())
    use = labels.ravel() != 0
    flat = bold.reshape(-1, bold.shape[3])[use].astype(float)
    order = np.argsort(place[use], kind="stable")
    counts = np.bincount(place[use], minlength=len(ids))
    sums = np.add.reduceat(flat[order], np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0) if len(flat) else np.zeros((len(ids), bold.shape[3]))
    return ids, sums / counts[:, None]


def parcel_series(spark: SparkSession, bold_glob: str, atlas: bytes, rows_offset: int = 0) -> DataFrame:
    """path, channel, x of each 4-D volume: one task a file, the atlas sent to all (one volume)."""
    sent = spark.sparkContext.broadcast(label_volume(atlas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, affine = sent.value
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                bold, grid = read_nifti(data)
                ids, x = parcellate(bold, resample_labels(labels, affine, bold.shape, grid))
                cols = [pa.array([path] * len(ids)), pa.array(np.arange(len(ids)) + rows_offset, pa.int32()), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["path", "channel", "x"])

    return spark.read.format("binaryFile").load(bold_glob).select("path", "content").mapInArrow(run, "path string, channel int, x array<float>")


#: Fixed values of the safetensors format: numpy types by name.
TENSOR_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "U8": "u1"}


def read_tensors(data: bytes) -> dict[str, np.ndarray]:
    """Tensors of a safetensors file: 8 bytes of length, a JSON header, raw data."""
    size = struct.unpack_from("<Q", data)[0]
    head = json.loads(data[8 : 8 + size])
    out = {}
    for name, t in head.items():
        if name != "__metadata__" and t["dtype"] in TENSOR_TYPES:
            a, b = t["data_offsets"]
            out[name] = np.frombuffer(data[8 + size + a : 8 + size + b], TENSOR_TYPES[t["dtype"]]).reshape(t["shape"])
    return out


def weights_or_random(tensors: dict[str, np.ndarray], fallback):
    """Weights by name where the shape agrees, else those of fallback."""
    return lambda name, shape: tensors[name].astype(float) if name in tensors and tensors[name].shape == tuple(shape) else fallback(name, shape)
