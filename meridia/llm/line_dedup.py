"""Line dedup by winnowing: repeated runs of lines keep their first occurrence.

Lines are compared stripped; blank lines are skipped and never counted. A gram is the shortest run
of lines from a given line that has GRAM words. In each window, the shortest run of lines with
WINDOW words, the gram with the least hash is a fingerprint, so two texts that share a run of
WINDOW words share a fingerprint in it; a line that alone has WINDOW words always is one.

Fingerprints are joined by their hash. A fingerprint that repeats carries the lines of WINDOW words on both sides, and a match
is extended both ways, each way as far as any earlier occurrence of it agrees: hashes of the gram with 1, 2, 3... lines before (or
after) it are joined with their first occurrence by (id, text hash, line). The matched lines are deleted; order and text of other lines stay.

Guarantee: every line in a run of WINDOW words or more that occurs earlier, in whatever context, is deleted. Proof: a window of the
run holds a fingerprint of both occurrences, less than WINDOW words away from the line, and all between the two is
in the run, so its hash has an earlier occurrence. Conversely, a deleted line always lies in a run of GRAM words or more that occurs
earlier. Repeats of fewer than GRAM words stay, those of GRAM to WINDOW words go where they are a window's minimum.

A text that consists of repeated runs becomes empty; its row stays. Null texts stay null, and so do texts of null ids. Rows that
repeat an id and a text are one document and treated alike; two texts under one id are two documents. Extra
columns are passed through, whatever their names; only a column named like removed_col is replaced.
First occurrences are unique per hash and written, so a line in a third of all texts is a hot key on one
side only, which the engine can split; a text's spans are gathered per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text
from .common import cut, forget, slices

GRAM, WINDOW = 5, 8
_PRINTS = "key long, doc long, of long, pos int, len int, before array<long>, after array<long>"


def lines(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and word counts of the non-blank lines of a column of texts, and n + 1 bounds by text."""
    data, offsets = text.buffer(col)
    starts, ends = text.spans(data, offsets)  # words
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    line += np.searchsorted(offsets, starts, "right")  # a text's end is a break too, but not a byte
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    last = np.append(first[1:], len(line)) - 1
    hashes = text.hash_spans(data, starts[first], ends[last])
    return hashes, last - first + 1, np.searchsorted(starts[first], offsets)


def fingerprints(hashes: np.ndarray, mass: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Key, first line and number of lines of each fingerprint of one text."""
    n = len(hashes)
    total = np.concatenate([[0], np.cumsum(mass)])
    if not n or total[-1] < window:
        return []
    gram_end = np.searchsorted(total, total[:-1] + gram)  # of the gram from each line; n + 1: none
    window_end = np.searchsorted(total, total[:-1] + window)
    keys = np.zeros(n, np.uint64)
    full = gram_end <= n
    with np.errstate(over="ignore"):
        long = int((gram_end - np.arange(n))[full].max())
        run = np.zeros(n, np.uint64)
        for k in range(long):  # grams grow a line a round; those that are complete stand still
            grows = np.flatnonzero(full & (gram_end - np.arange(n) > k))
            run[grows] = run[grows] * np.uint64(0xD6E8FEB86659FD93) + hashes[grows + k]
        keys[full] = text.mix(run[full] + (gram_end - np.arange(n))[full].astype(np.uint64))
    chosen = set()
    for i in np.flatnonzero(window_end <= n):
        inside = np.searchsorted(gram_end, window_end[i], "right")  # grams from i that end in the window
        chosen.add(int(i + np.argmin(keys[i:inside])))
    return [(int(keys[i].view(np.int64)), i, int(gram_end[i] - i)) for i in sorted(chosen)]


def _prints(gram: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, mass, bounds = lines(part.column("text"))
                signed = hashes.view(np.int64)
                cols: list[list] = [[] for _ in range(7)]
                for i, (doc, of) in enumerate(zip(part.column("id").to_pylist(), part.column("of").to_pylist())):
                    a, b = bounds[i], bounds[i + 1]
                    total = np.concatenate([[0], np.cumsum(mass[a:b])])
                    for key, pos, n in fingerprints(hashes[a:b], mass[a:b], gram, window):
                        low = max(0, int(np.searchsorted(total, total[pos] - window, "right")) - 1)
                        high = min(b - a, int(np.searchsorted(total, total[pos + n] + window)))
                        for col, x in zip(cols, (key, doc, of, pos, n, signed[a + low : a + pos][::-1], signed[a + pos + n : a + high])):
                            col.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "doc", "of", "pos", "len", "before", "after"])

    return run


def repeated_spans(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """docs (id, of, text) to spans (doc, of, first, stop) of non-blank lines that repeat earlier ones."""
    prints = cut(docs.where("text is not null and id is not null").mapInArrow(_prints(gram, window), _PRINTS))
    many = cut(prints.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"))
    own = prints.join(many, "key")
    # the gram with j lines on one side: j = 0 is the gram alone
    grown = "transform(sequence(0, size({0})), j -> struct({1} as side, j, xxhash64(key, {1}, slice({0}, 1, j)) as h))"
    each = own.select("doc", "of", "pos", "len", F.explode(F.expr(f"concat({grown.format('before', 0)}, {grown.format('after', 1)})")).alias("e"))
    each = cut(each.select("doc", "of", "pos", "len", "e.side", "e.j", "e.h"))
    first = cut(each.groupBy("h").agg(F.min(F.struct("doc", "of", "pos")).alias("f"), F.count("*").alias("rows")).where("rows > 1").select("h", "f"))
    later = each.join(first, "h").where("struct(doc, of, pos) > f")
    far = later.groupBy("doc", "of", "pos", "len").agg(F.max(F.when(F.col("side") == 0, F.col("j"))).alias("back"), F.max(F.when(F.col("side") == 1, F.col("j"))).alias("on"))
    spans = cut(far.select("doc", "of", (F.col("pos") - F.col("back")).alias("first"), (F.col("pos") + F.col("len") + F.col("on")).alias("stop")))
    forget(prints, many, each, first)
    return spans


def drop_lines(value: str, spans: list) -> str:
    """value without the non-blank lines whose numbers lie in spans."""
    gone = np.zeros(value.count("\n") + 2, bool)
    for span in spans:
        gone[span["first"] : span["stop"]] = True
    kept, number, left = [], 0, 0
    for line in value.split("\n"):
        blank = not line.strip(" \t\n\v\f\r")
        if blank or not gone[number]:
            kept.append(line)
            left += not blank
        number += not blank
    return "\n".join(kept) if left else ""


@F.pandas_udf(StringType())
def _dropped(values: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([v if s is None or v is None else drop_lines(v, s) for v, s in zip(values, spans)], dtype=object)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, removed_col: str | None = "n_removed") -> DataFrame:
    """docs with repeated runs of lines deleted from text_col; removed_col counts deleted lines."""
    key = [F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("of")]
    spans = repeated_spans(docs.select(*key, F.col(text_col).alias("text")), gram, window)
    gone = spans.distinct().groupBy("doc", F.col("of").alias("hash")).agg(F.collect_list(F.struct("first", "stop")).alias("spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != removed_col]).alias("row"), *key)
    rows = rows.join(gone, (F.col("id") == F.col("doc")) & (F.col("of") == F.col("hash")), "left")
    text = F.col(f"row.`{text_col}`")
    # only texts that lose lines go to the worker
    rows = rows.select("row", text.alias("old"), F.when(F.col("spans").isNotNull(), text).alias("text"), "spans").select("row", "old", _dropped("text", "spans").alias("new"))
    lines_of = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, "\n")))
    removed = F.when(F.col("new").isNull(), 0).otherwise(lines_of(F.col("old")) - lines_of(F.col("new")))
    cols = [F.coalesce("new", "old").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != removed_col]
    return rows.select(*cols, *([removed.alias(removed_col)] if removed_col else []))
