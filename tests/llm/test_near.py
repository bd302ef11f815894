"""Near duplicates against brute force; trees that must branch; odd rows."""

import random

import numpy as np
import pytest

from meridia.llm import near_dedup as N


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def brute(rows, percent=85):
    def shingles(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out, n = [], 0
    for _ in range(6):
        base = words(rng, rng.randint(40, 120))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = "x%d" % rng.randrange(10**6)
            out.append((n, " ".join(copy)))
            n += 1
    out += [(n + i, t) for i, t in enumerate(["", None, "  \n", "one two", "ONE two", "one two three four five six", " ".join(words(rng, 20_000))])]
    return out


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, "node", 1) for i, t in rows], "doc_id long, text string, node string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_small_leaves_branch_and_families_split(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, node=8, family=6).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(df).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert N.near_duplicates(df.where("doc_id < 0")).collect() == []


def test_inverted_lists_equal_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(40)]
    f = N.Forest(40)
    assert len(list(N.linked(N.Sets(sets, 60), f, range(39)))) == 40 - len({f.find(i) for i in range(40)})
    g = N.Forest(40)
    for a in range(40):
        for b in range(a):
            i = len(np.intersect1d(sets[a], sets[b]))
            if 100 * i >= 60 * (len(sets[a]) + len(sets[b]) - i):
                g.join(a, b)
    assert [f.find(i) for i in range(40)] == [g.find(i) for i in range(40)]


def test_pairs_of_a_large_family_under_the_threshold_all_meet(spark):
    rng = random.Random(31)
    core, rows = words(rng, 400), []
    for i in range(0, 120, 2):  # pairs near 0.87 in a family whose other pairs lie near 0.84
        both = ["p%dx%d" % (i, k) for k in range(9)]
        rows += [(i + m, " ".join(core + both + ["o%dx%d" % (i + m, k) for k in range(29)])) for m in (0, 1)]
    rows.append((120, " ".join(core[:330] + words(rng, 20_000))))
    want = brute(rows)
    assert all(want[i][1] == i // 2 * 2 for i in range(120))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, family=6).collect()}
    assert got == want


@pytest.mark.parametrize("spread", [0.80, 0.92])
def test_dense_nodes_that_cannot_be_split_meet_whole(spark, spread):
    """150 variants of one text, at similarities around the threshold; no level of branching helps."""
    rng = random.Random(int(100 * spread))
    core, rows = words(rng, 300), []
    for i in range(150):
        copy = list(core)
        for _ in range(rng.randint(0, round(300 * (1 - spread) / 4))):
            copy[rng.randrange(300)] = "x%d" % rng.randrange(10**6)
        rows.append((1000 - i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for depth in (0, 2):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, node=20, family=16, depth=depth).collect()}
        assert got == brute(rows)


def test_null_ids_and_two_texts_under_one_id(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "a b c d e f"), (None, "only me here and so on"), (None, None), (3, "x")]
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.n_shingles, r.kept) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([(1, 1, 2, True), (1, 1, 2, True), (2, 1, 2, False), (0, 1, 2, False), (0, 0, 2, True), (0, 0, 0, True), (3, 3, 1, True)])
