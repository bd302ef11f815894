"""Benchmark decontamination: n-gram seeds, then Smith-Waterman word alignment.

Words are runs of letters and digits, A-Z lowered. All n-grams of an item are its seeds, frequent
ones too: an edited copy may have no others left. One pass finds the seeds in each text and opens
a window around each diagonal that they lie on. A hit needs THRESHOLD of the item's words as matches,
so windows with fewer of its words go; the others are aligned with the item (match 2, mismatch -1,
gap -1). The score is the alignment's value over that of the whole item; hits reach THRESHOLD.

The test items are the stated query set. They are taken in blocks of at most BLOCK_WORDS words, and
each block is sent to every task: what is broadcast has that bound whatever the benchmark's
size. Texts are never shuffled or collected, so frequent passages make no hot key, and every window
of every text that can reach THRESHOLD is aligned.

Null and empty texts have no hits. Items without words match nothing; those with fewer than N words
have their whole sequence as the only seed. Repeated rows give repeated hits; a text and an item give
at most one hit, the best (ties: the first window). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .common import slices
from .toxicity import GAP

N, THRESHOLD, BLOCK_WORDS = 3, 0.5, 2_000_000
#: Words of windows that are aligned together.
CELLS = 1 << 18
MATCH, MISMATCH, SPACE = 2, -1, 1


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text.buffer(col)
    starts, ends = text.spans(data, offsets, GAP)
    return text.hash_spans(data, starts, ends, text.FOLDED), np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that start at each word of a whole column."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
        for i in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + len(out)]
        return text.mix(out + np.uint64(n))


class Items:
    """Benchmark items: word hashes and, by length n, their n-grams with owners and positions."""

    def __init__(self, ids: list[int], texts: pa.Array, n: int = N) -> None:
        self.ids = np.array(ids, np.int64)
        hashes, bounds = word_hashes(texts)
        self.words = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        found = [(min(n, len(w)), g, i, q) for i, w in enumerate(self.words) if len(w) for q, g in enumerate(grams(w, min(n, len(w))).tolist())]
        found.sort(key=lambda x: x[1])
        self.size = np.array([x[0] for x in found], np.int64)
        self.gram = np.array([x[1] for x in found], np.uint64)
        self.item = np.array([x[2] for x in found], np.int64)
        self.at = np.array([x[3] for x in found], np.int64)

    def occurrences(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and gram hashes in a column of texts that are an item's gram, by gram length."""
        for n in np.unique(self.size):
            known = np.unique(self.gram[self.size == n])
            g = grams(hashes, int(n))
            pos = np.flatnonzero(known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g)
            doc = np.searchsorted(bounds, pos, "right") - 1
            pos = pos[pos + n <= bounds[doc + 1]]
            yield pos, g[pos]


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman scores of an item against each row of windows, and the end columns (exclusive)."""
    c, width = windows.shape
    ramp = np.arange(width, dtype=np.int32) * SPACE
    row, best, end = np.zeros((c, width + 1), np.int32), np.zeros(c, np.int32), np.zeros(c, np.int64)
    for w in item:
        t = np.maximum(row[:, :-1] + np.where(windows == w, MATCH, MISMATCH).astype(np.int32), row[:, 1:] - SPACE)
        t = np.maximum(np.maximum.accumulate(t + ramp, axis=1) - ramp, 0)
        row = np.concatenate([np.zeros((c, 1), np.int32), t], axis=1)
        top = t.argmax(1)
        value = t[np.arange(c), top]
        better = value > best
        best[better], end[better] = value[better], top[better] + 1
    return best, end


def _find(send, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = send.value
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds = word_hashes(part.column("text"))
                ids = part.column("id").to_pylist()
                hits = list(_windows(items, hashes, bounds))
                rows = []
                for item, doc, start in hits:
                    words = items.words[item]
                    pad, own = _pad(len(words)), np.unique(words)
                    width = len(words) + 3 * pad
                    step = max(1, CELLS // width)  # a bounded matrix at a time, or one window of a very long item
                    for x in range(0, len(doc), step):
                        d, s = doc[x : x + step], start[x : x + step]
                        at = s[:, None] + np.arange(width)
                        inside = (at >= bounds[d][:, None]) & (at < bounds[d + 1][:, None])
                        window = np.where(inside, hashes[np.clip(at, 0, len(hashes) - 1)], np.uint64(0))
                        matches = (own[np.minimum(np.searchsorted(own, window), len(own) - 1)] == window).sum(1)
                        able = matches >= threshold * len(words) - 1e-9
                        d, s, window = d[able], s[able], window[able]
                        if not len(d):
                            continue
                        score, end = align(words, window)
                        share = score / (MATCH * len(words))
                        rows += [(int(i), int(items.ids[item]), float(v), int(e)) for i, v, e in zip(d[share >= threshold], share[share >= threshold], (s + end - bounds[d])[share >= threshold])]
                best: dict[tuple[int, int], tuple[float, int]] = {}
                for doc, item, v, e in rows:
                    if v > best.get((doc, item), (0.0, 0))[0]:
                        best[doc, item] = v, e
                cols = [[ids[k[0]] for k in best], [k[1] for k in best], [v[0] for v in best.values()], [v[1] for v in best.values()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["id", "item_id", "score", "end_word"])

    return run


def _pad(n: int) -> int:
    return max(2, n // 3)


def _windows(items: Items, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By item: texts and first words of the windows around all diagonals with seeds."""
    docs, owners, starts = [], [], []
    for pos, g in items.occurrences(hashes, bounds):
        low, high = np.searchsorted(items.gram, g, "left"), np.searchsorted(items.gram, g, "right")
        many = high - low
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        p = np.repeat(pos, many)
        docs.append(np.searchsorted(bounds, p, "right") - 1)
        owners.append(items.item[entry])
        starts.append(p - items.at[entry])
    if not docs or not sum(map(len, docs)):
        return
    doc, owner, start = map(np.concatenate, (docs, owners, starts))
    pad = np.array([_pad(len(w)) for w in items.words])[owner]
    start = (start - bounds[doc]) // pad * pad + bounds[doc] - pad
    rows = np.unique(np.stack([owner, doc, start]), axis=1)
    for item in np.unique(rows[0]):
        mine = rows[:, rows[0] == item]
        yield int(item), mine[1], mine[2]


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = N, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per text and item that it contains: id, item_id, score, end_word (the alignment's end in the text's words)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    tests = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col("text").alias("text")).where("text is not null").distinct()
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 2
    blocks = 1 + size // block_words
    out = None
    for block in range(blocks):
        got = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).toArrow().sort_by([("item", "ascending"), ("text", "ascending")])
        items = Items(got["item"].to_pylist(), got["text"].combine_chunks() if got.num_rows else pa.array([], pa.string()), n)
        if not len(items.gram):
            continue
        found = rows.mapInArrow(_find(spark.sparkContext.broadcast(items), threshold), "id long, item_id long, score double, end_word long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "id long, item_id long, score double, end_word long")
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the texts that contain a test item."""
    found = hits(docs, benchmark, id_col, text_col, **options).select(id_col).distinct()
    return docs.join(found, id_col, "left_anti")
