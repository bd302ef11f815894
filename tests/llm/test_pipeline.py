"""The pipeline against its stages in plain Python, and its stages' own contracts."""

import random
from collections import defaultdict

from tokenizers import Tokenizer

import corpus_pipeline
from meridia.llm.queries import TOKENIZER
from tests.llm import test_lines, test_near
from tests.llm.test_texts import SOUNDS, prose


def corpus():
    rng = random.Random(8)
    item = prose(rng, "en", 40)
    passage = prose(rng, "en", 60)
    rows = []
    for i in range(40):
        lang = rng.choice(list(SOUNDS))
        body = [prose(rng, lang, rng.randint(20, 45)) for _ in range(rng.randint(2, 5))]
        if i in (5, 11, 17):
            body.insert(1, passage)
        if i in (7, 19):
            body.append(item)
        rows.append([i, "\n".join(body), lang, f"src{i % 3}"])
    near = rows[2][1].split(" ")
    near[4] = "changed"
    rows += [[40, " ".join(near), rows[2][2], "src0"], [41, rows[3][1], rows[3][2], "src1"], [42, None, "en", "src1"], [43, "123 456", "en", "src2"], [44, "", "de", None]]
    long = prose(rng, "en", 300).split(" ")
    rows.append([45, " ".join(long), "en", "src0"])
    rows += [[46, " ".join([*long[:100], "other", *long[101:]]), "en", "src1"], [47, prose(rng, "fr", 20_000), "fr", "src1"], [48, rows[0][1] + "\nnew line here", rows[0][2], "src1"], [48, rows[0][1] + "\nnew line here", rows[0][2], "src1"]]
    return rows, item


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows, item = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, n long, kept string, spans string"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, "a", "b") for r in rows], schema)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    gone = test_lines.repeats(kept, 8)
    assert gone == test_lines.repeats(kept, 5)
    texts = {i: "\n".join(x for k, x in enumerate(test_lines.split(t)) if k not in gone[i]) for i, t in kept}
    groups = test_near.brute(list(texts.items()))
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    texts = {i: t for i, t in texts.items() if item not in t}
    t = Tokenizer.from_file(TOKENIZER)
    want = {i: t.encode(x, add_special_tokens=False).ids + [2] for i, x in texts.items()}

    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id].append((r.start, r.ids))
    assert len(got[48]) == 2 and [ids for _, ids in got[48]] == [want[48]] * 2  # repeated rows stay alike
    del got[48], want[48]
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in got.items()} == want
    assert 46 not in want and 7 not in want and 42 not in want and 11 in want and len(want[40]) < 100

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert stage(spark, docs.where("doc_id < 0"), str(tmp_path)).collect() == [], name
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_near_dedup_stage_links_from_080(spark):
    rng = random.Random(21)
    base = prose(rng, "en", 200).split()[:200]
    rows = []
    for k, own in enumerate((0, 15, 18, 22, 26)):  # share of the base: 196 - own of 196 + own shingles
        rows.append((k, " ".join(base[: 200 - own] + [f"own{k}x{i}" for i in range(own)]), "en", "s", 1))
    want = {i: c for i, (_, c) in test_near.brute([r[:2] for r in rows], percent=80).items()}
    assert want[2] == 0 and test_near.brute([r[:2] for r in rows])[2][1] == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert left == {i for i, c in want.items() if i == c}
