"""Language ID by Bayesian evidence fusion.

For each text, four kinds of evidence meet in one posterior over the languages that the training texts have, and und (another language, or none):

* the text: byte trigrams under a multinomial model of each language, tempered because trigrams overlap; und is the
  null model in which the order of letters says nothing: products of byte frequencies, or any trigram alike;
* the declared markup language: P(declared | language), from counts of declared tags by text posterior;
* the address suffix: country suffixes of a language add pseudo-counts to the suffix's prior;
* the host: counts of text posteriors by host, registered domain and suffix, each level shrunk
  to its parent (Dirichlet smoothing with STRENGTH pseudo-counts) and the text's own share left out.

The text model never sees the evidence that it is fused with: a training text is labelled by the function words in it (WORDS).
Only a declared language without such a list lends its tag as the label of texts that no list claims. Training reads a bounded
sample, at most SAMPLE texts, about PER_TAG for each declared tag so that rare languages are in it, chosen by a hash of the id. All
counts are grouped aggregations over every row; hosts are unique on their side of the join, so a
host with a third of all rows is a hot key on one side only.

A text is kept when a language's posterior reaches KEEP. Null texts, empty texts and texts without
letters have no text evidence: lang comes from the other evidence, kept is false. Null hosts
and declared tags are values of their own. Repeated rows are judged one by one. Ties go to the language that is first by name, und last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text
from .common import cut, slices
from .url_filter import levels

BITS, SAMPLE, PER_TAG, TEMPER, STRENGTH, KEEP = 16, 4000, 1000, 0.2, 5.0, 0.5
OTHER = "und"
#: Common function words by language.
WORDS = {
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind",
    "en": "the of and to in is that it for was with as on be are this by at from have not or which were but they has their an been he she you we",
    "es": "el la los las y de que en un una por con para es del se al lo como más su pero sus este ya entre cuando muy sin sobre también me hasta hay",
    "fr": "le la les et des est que dans une pour qui pas sur au du par en un ce il elle ne se plus avec sont aux mais ou nous vous leur cette ces été",
    "it": "il lo gli e di che è un una per con non sono del della nel alla dei più come anche si al ma le da questo delle dal nella",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij nog uit naar heeft door over worden",
    "pt": "o os um uma e do da em que não com por para se no na dos das mais como mas ao foi ele são seu sua ou quando muito",
}
#: Share of a text's words that a list must have, and how far ahead of the next list it must be.
CLAIM, AHEAD = 0.05, 1.3
#: Country suffixes and the language that they speak for.
COUNTRY = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en"}
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_LETTER = np.array([c > 127 or chr(c).isalpha() for c in range(256)])


def trigrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed byte trigrams of a column whose middle byte is part of a letter, n + 1 bounds by text, where they begin, and the bytes."""
    data, offsets = text.buffer(col)
    if len(data) < 3:
        return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), data
    f = _FOLD[data]
    code = ((f[:-2] << 16 | f[1:-1] << 8 | f[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.uint16)
    good = _LETTER[data[1:-1]]
    cuts = offsets[1:-1]
    for shift in (1, 2):  # trigrams across a text's end
        at = cuts - shift
        good[at[(at >= 0) & (at < len(good))]] = False
    at = np.flatnonzero(good)
    return code[at], np.searchsorted(at, offsets), at, data


def claims(col: pa.Array) -> list[str | None]:
    """The language whose function words claim each text, if one does."""
    hashes, bounds = text.words(col)
    shares = np.zeros((len(col), len(WORDS)))
    for k, words in enumerate(WORDS.values()):
        known = text.words(pa.array([words]))[0]
        hit = np.concatenate([[0], np.cumsum(np.isin(hashes, known))])
        shares[:, k] = (hit[bounds[1:]] - hit[bounds[:-1]]) / np.maximum(1, np.diff(bounds))
    names, order = list(WORDS), np.sort(shares, axis=1)
    clear = (order[:, -1] >= CLAIM) & (order[:, -1] >= AHEAD * order[:, -2])
    return [names[k] if ok else None for k, ok in zip(shares.argmax(1), clear)]


class Model:
    """Languages, the log probabilities of their trigrams, and the null model's bytes."""

    def __init__(self, names: list[str], counts: np.ndarray, bytes_seen: np.ndarray) -> None:
        self.names = [*names, OTHER]
        share = (counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * counts.shape[1])  # what is never seen is less likely than under the null model
        self.log = np.log(share).astype(np.float32)
        self.bytes = ((bytes_seen + 0.5) / (bytes_seen.sum() + 128)).astype(np.float32)

    def null(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of the trigrams that begin at at."""
        share = self.bytes[_FOLD[data]]
        return np.log(0.5 * share[at] * share[at + 1] * share[at + 2] + 0.5 / (1 << BITS))

    def posterior(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) tempered posterior under equal priors, and the trigrams of each text."""
        codes, bounds, at, data = trigrams(col)
        n = np.diff(bounds)
        total = np.zeros((len(n), len(self.names)))
        has = np.flatnonzero(n)
        if len(has):
            for i, row in enumerate(self.log):
                total[has, i] = np.add.reduceat(row[codes].astype(np.float64), bounds[has])
            total[has, -1] = np.add.reduceat(self.null(data, at).astype(np.float64), bounds[has])
        p = np.exp(TEMPER * (total - total.max(1, keepdims=True)))
        return p / p.sum(1, keepdims=True), n


def train(rows: DataFrame, most: int = SAMPLE, per_tag: int = PER_TAG) -> Model:
    """Count trigrams by label over at most `most` rows of (id, text, declared)."""
    named = rows.where("id is not null and text is not null")
    tags = named.groupBy("declared").agg(F.count("*").alias("of"))  # as many rows as there are tags of two or three letters
    chance = F.expr(f"pmod(xxhash64(id, 1), {1 << 30}L) * of < {per_tag}D * {1 << 30}L")
    tagged = named.select("id", F.coalesce("declared", F.lit("")).alias("declared")).join(F.broadcast(tags.select(F.coalesce("declared", F.lit("")).alias("declared"), "of")), "declared")
    chosen = tagged.where(chance).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        seen = np.zeros(256, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                codes, bounds, _, data = trigrams(part.column("text"))
                seen += np.bincount(_FOLD[data], minlength=256)
                for i, (claim, tag) in enumerate(zip(claims(part.column("text")), part.column("tag").to_pylist())):
                    label = claim or (tag if tag and tag not in WORDS else None)
                    if label:
                        total.setdefault(label, np.zeros(1 << BITS, np.int64))
                        total[label] += np.bincount(codes[bounds[i] : bounds[i + 1]], minlength=1 << BITS)
        names = [*total, ""]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([*(x.tobytes() for x in total.values()), seen.tobytes()], pa.binary())], names=["label", "counts"])

    # at most `most` rows: the side that is broadcast is bounded, and so are 8 tasks' counts
    sample = rows.select("id", "text").join(F.broadcast(chosen.select("id", F.col("declared").alias("tag"))), "id").select("text", "tag")
    got = sample.repartition(8).mapInArrow(run, "label string, counts binary").toArrow()
    names = sorted(set(got["label"].to_pylist()) - {""})
    counts, seen = np.zeros((len(names), 1 << BITS)), np.zeros(256)
    for name, raw in zip(got["label"].to_pylist(), got["counts"].to_pylist()):
        if name:
            counts[names.index(name)] += np.frombuffer(raw, np.int64)
        else:
            seen += np.frombuffer(raw, np.int64)
    return Model(names, counts, seen)


def _sums(n: int) -> list[Column]:
    return [F.array(*[F.round(F.sum(F.col("p")[i]), 6) for i in range(n)]).alias("c"), F.count("*").cast("double").alias("rows")]


def tag(declared: Column) -> Column:
    """Primary subtag of a declared language; null unless it has two or three letters."""
    t = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when(t != "", t)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source", keep: float = KEEP) -> DataFrame:
    """One row a text: id, lang, posterior, text_lang, n_trigrams, kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), tag(F.col(declared_col)).alias("declared"), F.coalesce(F.col(host_col), F.lit("")).alias("host"))
    model = train(rows)
    names, size = model.names, len(model.names)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 256 kB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p, n = sent.value.posterior(part.column("text"))
                lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, size, np.int32), p.ravel())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("declared"), part.column("host"), lists, pa.array(n)], names=["id", "declared", "host", "p", "n"])

    rows = rows.withColumn("declared", F.coalesce("declared", F.lit("")))
    seen = cut(rows.mapInArrow(run, "id long, declared string, host string, p array<double>, n long"))
    domain, suffix = levels(F.col("host"))
    spoke = seen.where("n > 0")
    hosts = spoke.groupBy("host").agg(*_sums(size)).select("host", domain.alias("domain"), suffix.alias("suffix"), "c", "rows")
    fold = F.array(*[F.sum(F.col("c")[i]) for i in range(size)]).alias("c")
    up = [fold, F.sum("rows").alias("rows")]
    equal = F.array(*[F.lit(1 / size)] * size)

    def shrunk(prior: str, own: str = "c", n: str = "rows") -> Column:
        return F.expr(f"zip_with({own}, {prior}, (c, q) -> (c + {STRENGTH}D * q) / ({n} + {STRENGTH}D))")

    whole = spoke.groupBy().agg(*_sums(size)).select(F.when(F.col("rows") > 0, F.expr("transform(c, x -> (x + 1) / (rows + size(c)))")).otherwise(equal).alias("q")).scalar()
    spoken = F.create_map(*[F.lit(x) for pair in COUNTRY.items() for x in pair])
    says = F.try_element_at(spoken, F.col("suffix"))
    nation = F.array(*[F.when(says.isNull() | ~says.isin(names), F.col("q")[i]).otherwise((says == name).cast("double")) for i, name in enumerate(names)])
    s = hosts.groupBy("suffix").agg(*up).withColumn("q", whole).withColumn("q", F.zip_with(F.col("q"), nation, lambda a, b: (a + b) / 2)).select("suffix", shrunk("q").alias("qs"))
    d = hosts.groupBy("domain", "suffix").agg(*up).join(s, "suffix").select("domain", "suffix", shrunk("qs").alias("qd"))
    h = hosts.join(d, ["domain", "suffix"]).select("host", "c", F.col("rows").alias("of"), "qd")
    told = spoke.groupBy("declared").agg(*_sums(size)).select("declared", F.col("c").alias("told"))
    out = seen.join(h, "host", "left").join(told, "declared", "left")
    own = "zip_with(c, p, (c, x) -> greatest(0D, c - if(n > 0, x, 0D)))"
    out = out.withColumn("prior", F.coalesce(shrunk("qd", own, "greatest(0D, of - if(n > 0, 1D, 0D))"), whole))
    # P(declared | language): the tag's counts over the language's, own share left out
    totals = F.coalesce(spoke.groupBy().agg(*_sums(size)).select("c").scalar(), equal)
    out = out.withColumn("all", totals).withColumn("told", F.coalesce("told", F.array(*[F.lit(0.0)] * size)))
    out = out.withColumn("likely", F.expr("zip_with(zip_with(told, p, (c, x) -> greatest(0D, c - if(n > 0, x, 0D)) + 0.5D), all, (c, a) -> c / (a + 1D))"))
    joint = F.zip_with(F.zip_with("prior", "likely", lambda a, b: a * b), "p", lambda a, b: a * b)
    out = out.withColumn("joint", joint).withColumn("mass", F.aggregate("joint", F.lit(0.0), lambda a, x: a + x))
    best = F.array_position("joint", F.array_max("joint")).cast("int")
    label = F.array(*map(F.lit, names))
    posterior = F.col("joint")[best - 1] / F.col("mass")
    return out.select(
        F.col("id").alias(id_col),
        label[best - 1].alias("lang"),
        F.round(posterior, 6).alias("posterior"),
        F.when(F.col("n") > 0, label[F.array_position("p", F.array_max("p")).cast("int") - 1]).alias("text_lang"),
        F.col("n").alias("n_trigrams"),
        ((F.col("n") > 0) & (posterior >= keep) & (best < size)).alias("kept"),
    )
