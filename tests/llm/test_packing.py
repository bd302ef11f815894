"""Packing: whole ids once each, gapless sequences, little padding, and the placement rule."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from meridia.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_library():
    rng = random.Random(1)
    letters = list("aB1 '.,s\n\té–!?tß́İΣ \x00-_d日ll　﷽")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["it's 12,345 'tis we'LL", "", None, " ", "a" * 5000]
    t = Tokenizer.from_file(PATH)
    for _ in range(2):  # the second time from memory
        ids, bounds = P.tokens(PATH).encode(pa.array(texts))
        for i, x in enumerate(texts):
            assert list(ids[bounds[i] : bounds[i + 1]]) == t.encode(x or "", add_special_tokens=False).ids


def cost(level, length, at, size):
    m = level.copy()
    m[at] -= at > 0
    m[at + size] += at + size < length
    return int((m**2).sum())


def test_places_by_sum_of_squares():
    rng = np.random.default_rng(2)
    for most in (10_000, 12, 1):
        p, put, closed = P.SumOfSquares(64, most), 0, 0
        for _ in range(600):
            size, n = int(rng.integers(1, 64)), p.level.copy()
            options = [h for h in range(65 - size) if h == 0 or n[h]]
            at = p.best(size)
            assert cost(n, 64, at, size) == min(cost(n, 64, h, size) for h in options)
            done = p.add(0, np.zeros(size, np.uint32))
            put, closed = put + size, closed + sum(len(x[2]) for taken in done for x in taken)
            assert all(sum(len(x[2]) for x in taken) == 64 for taken in done)
            assert p.count == p.level.sum() <= most
            if at or n.sum() < most:  # placed whole
                m = n.copy()
                m[at] -= at > 0
                m[at + size] += at + size < 64
                assert np.array_equal(m, p.level)
        assert put - closed == sum(len(x[2]) for level in p.open for taken in level for x in taken) < most * 64
        sizes = [sum(len(x[2]) for x in taken) for taken in p.finish()]
        assert sum(sizes) == put - closed and all(s == 64 or s & (s - 1) == 0 for s in sizes) and p.count == 0


def test_pieces_make_whole_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "it's", "Grüße,", "42"]) for _ in range(rng.randint(0, 3000)))) for i in range(60)] + [(60, None), (61, ""), (62, "x " * 30_000)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, offset int").repartition(3)
    got = P.pack(df, PATH).collect()
    t = Tokenizer.from_file(PATH)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append((r.start, r.length, r.doc_tokens, r.ids, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in rows:
        want = t.encode(text or "", add_special_tokens=False).ids + [2]
        have = []
        for start, length, total, ids, crc in sorted(docs[i]):
            assert start == len(have) and length == len(ids) and total == len(want)
            assert crc == zlib.crc32(np.array(ids, "<u4").tobytes())
            have += ids
        assert have == want
    padding = total = 0
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096
        total += end
        padding += 0 if end & (end - 1) == 0 else 4096 - end
    assert padding == 0
    at_end = defaultdict(int)
    for r in got:
        at_end[r.sequence_id >> 40] += r.length * r.at_end
    assert all(n < P.OPEN * 4096 for n in at_end.values())
    assert P.pack(df.where("doc_id < 0"), PATH).collect() == []
