"""Decontamination: alignment against a plain Smith-Waterman, edited copies, clean texts."""

import random

import numpy as np

from meridia.llm import decontaminate as D


def plain(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_equals_plain():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, w = rng.integers(1, 6, 9).astype(np.uint64), rng.integers(1, 6, (4, 17)).astype(np.uint64)
        assert list(D.align(a, w)[0]) == [plain(a, b) for b in w]


def test_finds_edited_copies_only(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(8)] + [(8, ""), (9, None), (10, "two words")]
    rows, want = [], set()
    for i in range(80):
        w = [word() for _ in range(rng.randint(0, 200))]
        if i % 4 == 0:
            k = i % 8
            copy = items[k][1].upper().split()
            for _ in range(5):
                copy[rng.randrange(len(copy))] = word()
            del copy[rng.randrange(len(copy))]
            w[len(w) // 2 : len(w) // 2] = copy
            want.add((i, k))
        rows.append((i, ", ".join(w)))
    rows += [(80, None), (81, ""), (82, items[3][1]), (82, items[3][1]), (83, "x " * 40_000), (84, "some two words here")]
    want |= {(82, 3), (84, 10)}
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, score double, item_id int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = D.hits(docs, tests).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) + 1
    blocks = D.hits(docs, tests, block_words=40).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == want
    left = D.decontaminate(docs, tests)
    assert left.count() == len(rows) - len([r for r in rows if r[0] in {i for i, _ in want}])
    assert D.hits(docs, tests.where("item_id < 0")).collect() == [] and D.hits(docs.where("doc_id < 0"), tests).collect() == []


def test_finds_copies_with_most_grams_broken_and_frequent_copies(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    edited = lambda words, share: [word() if rng.random() < share else w for w in words]
    items = [[word() for _ in range(rng.randint(14, 59))] for _ in range(60)]
    rows, want = [], set()
    for k, item in enumerate(items):
        copy = edited(item, rng.choice([0.2, 0.25, 0.3]))
        rows.append((k, " ".join([word() for _ in range(20)] + copy + [word() for _ in range(20)])))
        if plain(item, copy) >= len(item):
            want.add((k, k))
    items.append([word() for _ in range(40)])
    copy = [word() if i % 5 == 4 else w for i, w in enumerate(items[-1])]
    rows += [(1000 + i, f"{word()} {' '.join(copy)} {word()}") for i in range(1000)]
    want |= {(1000 + i, 60) for i in range(1000)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert len(want) > 1040 and {(r.doc_id, r.item_id) for r in D.hits(docs, tests).collect()} == want
