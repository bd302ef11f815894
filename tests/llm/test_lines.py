"""Line dedup against a plain Python version of its definition, and what it guarantees."""

import random

import numpy as np
import pyarrow as pa

from meridia.llm import line_dedup as D


def line(rng, n):
    return " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(n))


def split(text):
    return [x.strip() for x in (text or "").split("\n") if x.strip()]


def repeats(rows, least):
    """Of each text: the lines in runs of least words that occur earlier, by comparing all runs of lines themselves."""
    texts = {i: split(t) for i, t in sorted(rows)}
    seen, out = {}, {i: set() for i in texts}
    for i, own in texts.items():
        for a in range(len(own)):
            words = 0
            for b in range(a, len(own)):
                words += len(own[b].split())
                run = "\n".join(own[a : b + 1])
                if words >= least and seen.setdefault(run, (i, a)) < (i, a):
                    out[i] |= set(range(a, b + 1))
    return out


def rows():
    rng = random.Random(4)
    long, short, block = line(rng, 60), line(rng, 8), [line(rng, rng.randint(3, 30)) for _ in range(12)]
    out = []
    for i in range(40):
        own = [line(rng, rng.randint(1, 70)) for _ in range(rng.randint(1, 10))]
        for piece in ([long], [short], block, block[3:9], ["", "  "]):
            if rng.random() < 0.4:
                at = rng.randint(0, len(own))
                own[at:at] = piece
        out.append((i, "\n".join(own)))
    return out + [(40, None), (41, ""), (42, "\n\n"), (43, out[0][1]), (44, "\n".join([long] * 5)), (45, line(rng, 30_000))]


def test_deletes_what_repeats(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "k", 1, 2.0, "n") for r in data], "doc_id long, text string, row string, pos int, spans double, `old.new` string")
    for gram, window in ((40, 50), (5, 8), (12, 30)):
        out = D.line_dedup(df, gram=gram, window=window)
        assert out.columns == [*df.columns, "n_removed"]
        got = out.collect()
        by = {r.doc_id: r.text for r in got}
        must, may = repeats(data, window), repeats(data, gram)
        for i, text in data:
            own = split(text)
            assert by[i] is None if text is None else True
            # the kept lines are the text's without a set between the two
            left, at = split(by[i]), 0
            least = [x for k, x in enumerate(own) if k not in may[i]]
            most = [x for k, x in enumerate(own) if k not in must[i]]
            assert len(least) <= len(left) <= len(most)
            for x in left:
                at = most.index(x, at) + 1
            at = 0
            for x in least:
                at = left.index(x, at) + 1
        assert all(r.row == "k" and r.spans == 2.0 and (r.n_removed > 0) == (by[r.doc_id] != dict(data)[r.doc_id]) for r in got)
        assert by[40] is None and by[41] == "" and by[43] == ""
        kept = {x for t in by.values() for x in split(t)}
        assert all(x in kept for _, t in data for x in split(t))  # nothing is lost
    assert D.line_dedup(df.where("doc_id < 0")).collect() == []


def test_a_run_whose_start_occurs_earlier_in_another_context(spark):
    x, y = "a b c d e f g h i j", "k l m n o p q"
    data = [(1, x + "\nmore"), (2, f"{x}\n{y}"), (3, f"own\n{x}\n{y}\nlast"), (4, f"{x}\nother words")]
    got = {r.doc_id: r.text for r in D.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: x + "\nmore", 2: y, 3: "own\nlast", 4: "other words"}


def test_every_shared_window_has_a_shared_fingerprint():
    rng = random.Random(9)
    for _ in range(40):
        run = [line(rng, rng.randint(1, 40)) for _ in range(8)]
        if sum(len(x.split()) for x in run) < 50:
            continue
        found = []
        for _ in range(2):
            text = "\n".join([line(rng, 9)] * rng.randint(0, 3) + run + [line(rng, 30)] * rng.randint(0, 3))
            h, m, _ = D.lines(pa.array([text]))
            found.append({k for k, _, _ in D.fingerprints(h, m, 40, 50)})
        assert found[0] & found[1]


def test_repeated_rows_are_treated_alike(spark):
    text = line(random.Random(1), 60)
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 9, r.text) for r in D.line_dedup(df).collect()) == [(1, text), (1, text), (2, ""), (9, text)]
    two = spark.createDataFrame([(1, "x\n" + text), (1, text + "\ny")], "doc_id long, text string")  # two texts under one id
    assert sorted(r.text for r in D.line_dedup(two).collect()) in (["x", text + "\ny"], ["x\n" + text, "y"])
    assert np.array_equal(D.lines(pa.array(["a\nb", "c"]))[2], [0, 2, 3])
