"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or.

A text is a bag of sentences. A sentence's score is logistic in the weights of its hashed words
and of their openings (abuse is inflected and compounded); the text's score is 1 - prod(1 - sentence score). The weights are learned from text labels
alone: the gradient of the noisy-or likelihood gives a positive text's credit to the sentences
that explain it. Afterwards sentence scores say where a toxic text offends.

Training reads at most `most` labelled texts of each label, chosen by a hash of their id (a
bounded sample, whole texts), on the driver as word hashes by sentence of SAMPLE_BYTES together at most: in the order of the hash,
a text that no longer fits is passed over. The two labels are weighed by their counts among all labels. Scoring reads every row in place, without a shuffle. Only
features that MIN_DOCS training texts share get a weight, so unseen words are neutral.

Null, empty and wordless texts are empty bags and score 0.0. Repeated rows are scored alike. With no labels of one kind nothing can be
learned and every text gets the share of positives. Among equally bad sentences the first is the worst. Labels that contradict each other for an id count as toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .common import cut, forget, slices

BITS, TRAIN, MIN_DOCS, EPOCHS, DECAY = 18, 2000, 10, 100, 2e-4
#: Bytes of a longer word's openings that are features.
OPENINGS = (5, 6, 7)
THRESHOLD, OFFENDING = 0.7, 0.5
#: Bytes of training bags on the driver.
SAMPLE_BYTES = 32 << 20
#: Bytes that end a sentence, and bytes between words: ASCII but letters and digits.
END = np.zeros(256, bool)
END[[ord(c) for c in ".!?\n"]] = True
GAP = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def bags(col: pa.Array) -> tuple[np.ndarray, ...]:
    """Of all words in a column of texts: text number, sentence number (over the column), feature; and the byte bounds of sentences."""
    data, offsets = text.buffer(col)
    starts, ends = text.spans(data, offsets, GAP)
    hashes, froms = [text.hash_spans(data, starts, ends, text.FOLDED)], [starts]
    for k in OPENINGS:
        longer = starts[ends - starts > k]
        hashes.append(text.hash_spans(data, longer, longer + k, text.FOLDED) + np.uint64(k << 58))
        froms.append(longer)
    starts = np.concatenate(froms)
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    feature = (np.concatenate(hashes)[order] >> np.uint64(64 - BITS)).astype(np.int32)
    doc = np.searchsorted(offsets, starts, "right") - 1
    stops = np.flatnonzero(END[data]) + 1
    bounds = text.distinct(np.concatenate([offsets, stops]))
    sentence = np.searchsorted(bounds, starts, "right") - 1
    return doc, sentence, feature, bounds, data, offsets


def _noisy_or(z: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p, np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)


class Model:
    """Word weights and bias of a sentence's logistic score; prior: the score where nothing can be learned."""

    def __init__(self, weights: np.ndarray, bias: float, prior: float | None = None) -> None:
        self.weights, self.bias, self.prior = weights, bias, prior

    def sentences(self, sentence: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sentences that have words, and their logits."""
        pairs = np.sort(sentence.astype(np.int64) << BITS | feature)
        number = pairs >> BITS
        new = np.append(True, number[1:] != number[:-1])[: len(pairs)]
        own = number[new]
        return own, np.bincount(np.cumsum(new) - 1, weights=self.weights[pairs & (1 << BITS) - 1], minlength=len(own)) + self.bias


def fit(owner: np.ndarray, row: np.ndarray, feature: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Maximise the weighted noisy-or likelihood of bag labels y by Adam with weight decay, full batches.

    owner: the text of each sentence; row, feature: sentence and feature of each occurrence.
    """
    n, size = len(y), 1 << BITS
    if not len(owner) or y.min() == y.max():
        return Model(np.zeros(size, np.float32), 0.0, float((y * weight).sum()) if n else 0.0)
    seen = np.zeros(size, np.int32)
    cuts = np.searchsorted(owner[row], np.arange(n + 1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        seen[text.distinct(feature[a:b])] += 1
    used = seen[feature] >= MIN_DOCS
    row, feature = row[used], feature[used]
    ids = np.flatnonzero(seen >= MIN_DOCS)
    place = np.zeros(size, np.int32)
    place[ids] = np.arange(len(ids))
    col = place[feature]
    share = (y * weight).sum()
    w, bias = np.zeros(len(ids)), float(np.log(max(share, 1e-3) / (len(owner) / n)))
    m, v, mb, vb = np.zeros(len(ids)), np.zeros(len(ids)), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        z = np.bincount(row, weights=w[col], minlength=len(owner)) + bias
        p, log_not = _noisy_or(z, owner, n)
        none = np.exp(log_not)
        credit = np.where(y > 0, none / np.maximum(1 - none, 1e-9), -1.0) * weight  # of a text's sentences
        pull = p * credit[owner]
        g, gb = -np.bincount(col, weights=pull[row], minlength=len(ids)) + DECAY * w, -pull.sum()
        rate = 0.3 if step <= EPOCHS // 2 else 0.1
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-6)
        bias -= rate / 3 * (mb / a) / (np.sqrt(vb / b) + 1e-6)
    weights = np.zeros(size, np.float32)
    weights[ids] = w
    return Model(weights, bias)


def _bag_rows(part: pa.RecordBatch) -> tuple[list[bytes], list[bytes]]:
    """Of each text: (sentence, feature) pairs in order, sentences numbered from 0 among those with words."""
    doc, sentence, feature, *_ = bags(part.column("text"))
    rows, features = [], []
    cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        pairs = np.sort(sentence[a:b].astype(np.int64) << BITS | feature[a:b])
        number = pairs >> BITS
        rows.append((np.cumsum(np.append(0, number[1:] != number[:-1]))[: len(pairs)]).astype(np.int32).tobytes())
        features.append((pairs & (1 << BITS) - 1).astype(np.int32).tobytes())
    return rows, features


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN, room: int = SAMPLE_BYTES) -> Model:
    """Fit on labels (id, y) and docs (id, text); labels that the caller holds out are not passed."""
    known = labels.where("y is not null and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("y") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                cols = [pa.array(x, pa.binary()) for x in _bag_rows(part)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), *cols], names=["id", "y", "sentence", "feature"])

    # at most 2 * most rows: the side that is broadcast is bounded
    bag = docs.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("id", "y", "text").mapInArrow(run, "id long, y int, sentence binary, feature binary")
    bag = cut(bag)
    sizes = bag.select("id", F.xxhash64("id").alias("h"), F.expr("octet_length(sentence) + octet_length(feature)").alias("bytes")).toArrow().sort_by([("h", "ascending"), ("id", "ascending")])
    left, taken = room, []
    for one, size in zip(sizes["id"].to_pylist(), sizes["bytes"].to_pylist()):
        if size <= left:
            left -= size
            taken.append((one,))
    got = bag.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "id long")), "id").toArrow().sort_by("id")
    forget(bag)
    y = got["y"].to_numpy().astype(float) if got.num_rows else np.zeros(0)
    if not len(y):
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0)
    sentences = [np.frombuffer(x, np.int32) for x in got["sentence"].to_pylist()]
    feature = np.concatenate([np.frombuffer(x, np.int32) for x in got["feature"].to_pylist()])
    count = np.array([int(x[-1]) + 1 if len(x) else 0 for x in sentences])
    base = np.cumsum(np.append(0, count))
    row = np.concatenate([x + np.int32(b) for x, b in zip(sentences, base)])
    del got, sentences
    found = {label: max(1, int((y == label).sum())) for label in (0, 1)}
    everything = sum(total.get(label, 0) for label in (0, 1)) or 1
    weight = np.array([total.get(int(v), 0) / everything / found[int(v)] for v in y])
    return fit(np.repeat(np.arange(len(y)), count), row, feature, y, weight / weight.sum())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (id, text) to id, score, n_sentences, n_offending and the worst sentence's code points [start, end)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB: 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                doc, sentence, feature, bounds, data, offsets = bags(part.column("text"))
                own, z = model.sentences(sentence, feature)
                owner = np.searchsorted(offsets, bounds[own], "right") - 1
                p, log_not = _noisy_or(z, owner, n)
                order = np.lexsort((-own, z, owner))
                last = np.flatnonzero(np.append(owner[order][1:] != owner[order][:-1], True)) if len(own) else np.zeros(0, int)
                worst, has = order[last], owner[order[last]] if len(own) else np.zeros(0, int)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                start, end = np.full(n, -1), np.full(n, -1)
                start[has] = points[bounds[own[worst]]] - points[offsets[has]]
                end[has] = points[bounds[own[worst] + 1]] - points[offsets[has]]
                total = -np.expm1(log_not) if model.prior is None else np.full(n, model.prior)
                cols = [np.clip(total, 0, 1), np.bincount(owner, minlength=n), np.bincount(owner[p >= OFFENDING], minlength=n), start, end]
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, cols)], names=["id", "score", "n_sentences", "n_offending", "worst_start", "worst_end"])

    return docs.select("id", "text").mapInArrow(run, "id long, score double, n_sentences long, n_offending long, worst_start long, worst_end long")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN) -> DataFrame:
    """Score every document; labels of ids with crc32(id as text) mod 3 = 1 are held out of training."""
    held = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = labels.where(~held).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    out = score(rows, train(rows, known, most)).withColumnRenamed("id", id_col)
    return out.select(id_col, held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "n_offending", "worst_start", "worst_end")
