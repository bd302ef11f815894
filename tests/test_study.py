"""Listings, atlas selections, classification rows, the lake's stages and the whole group inference."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia import config
from meridia.operators import connectivity as C
from meridia.operators import learning as L
from meridia.operators import listing as N
from meridia.operators import relational as R
from meridia.sources import lake


def test_listing(spark):
    names = ["sub-b_run-2_task-other_bold.h5", "sub-a_task-calm_run-10_bold.nii.gz", "sub-a_run-1_bold.h5", "sub-a_task-busy_run-1_bold.h5", "notes.txt", ""]
    files = N.described(spark.createDataFrame([(n,) for n in names], "name string"))
    assert [r.name for r in N.matching(files, {"sub": "a", "run": "1"}, "bold", ".h5").orderBy("name").collect()] == [names[2], names[3]]
    assert N.matching(files, {}).count() == len(names)
    order = [r.name for r in files.where("size(entities) > 0").orderBy(*N.sort_keys(["task", "run"], {"task": ["calm", "busy"]})).collect()]
    assert order == [names[1], names[3], names[0], names[2]]
    e, s, x = F.col("entities"), F.col("suffix"), F.col("extension")
    got = files.where("name like 'sub-b%'").select(N.file_name(N.reordered(e, ["sub", "task", "none"]), s, x), N.file_name(N.without(e, ["run"]), s, x), N.file_name(N.kept(e, ["task"]), F.lit(None).cast("string"), F.lit(None).cast("string"))).first()
    assert list(got) == ["sub-b_task-other_run-2_bold.h5", "sub-b_task-other_bold.h5", "task-other"]
    assert N.paired(files, files).count() == 3  # the name without a task has no partner


def test_rois(spark):
    atlas = spark.createDataFrame(
        [(0, "cortical", "front", "n1", "LH"), (1, "cortical", "front", "n2", "RH"), (2, "cortical", "back", "n1", "RH"), (3, "subcortical", "left deep", None, "LH"), (4, "subcortical", "deep", None, None), (0, "cortical", "front", "n1", "LH")],
        "row_index int, kind string, region string, network string, hemisphere string",
    )
    rows = lambda **k: sorted(r.row_index for r in R.selected_rois(atlas, **k).collect())
    assert rows(regions=[("front", None)]) == [0, 1] and rows(regions=[("front", "RH")]) == [1]
    assert rows(regions=[("front", None)], networks=[("n1", None)]) == [0] and rows(networks=[("n1", "RH")]) == [2]
    assert rows(subcortical=[("deep", None)]) == [3, 4] and rows(subcortical=[("deep", "LH")]) == [3] and rows() == []
    assert R.find_rois(atlas, rows=[2, 3], networks=["n1"]).count() == 1
    assert R.checked_rows(atlas, 5).count() == 6 and len(R.checked_rows(atlas, 5).collect()) == 6
    with pytest.raises(Exception, match="row 4 of 4"):
        R.checked_rows(atlas, 4).collect()
    assert R.spelt(atlas, {"network": "kind", "side": "hemisphere"}).select("network", "side").first() == ("n1", "LH")


def test_classification_rows(spark):
    f = spark.createDataFrame([("s1", None, 0, [1.0, float("nan")]), ("s1", "chunk_1", 1, [float("inf"), 2.0]), ("s2", None, 0, [3.0, 4.0]), ("s3", None, 0, [5.0, None])], "subject string, leaf string, roi int, v array<double>")
    cohort = spark.createDataFrame([("s1", "b", "control"), ("s1", "a", "case"), ("s2", "a", "strange"), ("s3", "a", "control")], "subject string, file string, cohort string")
    rows = {r.group: (r.y, r.v, r.scrubbed) for r in R.roi_rows(R.labelled(f, cohort, {"control": 0, "case": 1})).collect()}
    assert rows == {"s1_roi000": (1, [1.0, 0.0], 1), "s1_chunk_1_roi001": (1, [0.0, 2.0], 1), "s3_roi000": (0, [5.0, 0.0], 1)}
    near = spark.createDataFrame([(0, 2, 1.0), (0, 1, 1.0), (0, 3, 0.4), (1, 3, 1.0), (1, 2, 1.0)], "query int, y int, distance double")
    assert {r.query: r.predicted for r in L.vote_classes(near).collect()} == {0: 3, 1: 2}


def test_stages(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    rows = lambda *v: spark.createDataFrame([(s, "rest", float(x)) for s, x in v], "subject string, task string, x double")
    assert not lake.stale(spark, root, "modes", {"k": 1})
    lake.write_stage(rows(("a", 1)), root, "modes", {"k": 1}, key="subject")
    lake.write_stage(rows(("a", 9), ("b", 2)), root, "modes", {"k": 1}, key="subject")
    assert sorted((r.subject, r.x) for r in lake.read_stage(spark, root, "modes", {"k": 1}).collect()) == [("a", 1.0), ("b", 2.0)]
    lake.write_stage(rows(("a", 9)), root, "modes", {"k": 1}, overwrite=True)
    assert [r.x for r in lake.read_stage(spark, root, "modes", {"k": 1}).collect()] == [9.0]
    assert lake.stale(spark, root, "modes", {"k": 2}) and not lake.stale(spark, root, "modes", {"k": 1})
    facts = lake.read(spark, root, "attributes").collect()
    assert [(r.stage, r.name, r.value) for r in facts] == [("modes", "k", "1")]
    out = f"file://{tmp_path}/reports"
    for n in ("0001", "0002"):
        assert lake.next_run(spark, out) == n
        lake.write_report(spark.range(1), spark.range(1), out, n)
    lake.write_splits(spark.createDataFrame([("b", "train"), ("a", "train"), ("c", "holdout")], "subjectkey string, split string"), f"{out}/splits")
    assert [r.value for r in spark.read.text(f"{out}/splits/train").collect()] == ["subjectkey", "a", "b"]
    assert lake.dump(spark.range(3), f"{out}/d", False).count() == 3
    assert config.result_directory("out") == "out" and config.result_directory("out", "front", ["z", "a"]) == "out/front__net-a_z"


def test_group_statistics(spark):
    """Planted differences on a triangle of edges: one significant component of three edges, the rest not masked."""
    rng = np.random.default_rng(11)
    triangle = {(0, 1), (0, 2), (1, 2)}
    rows = [(s, i, j, float(rng.normal() + (4 if s < 8 and (i, j) in triangle else 0))) for s in range(16) for i in range(6) for j in range(i + 1, 6)]
    z = spark.createDataFrame(rows, "subject int, i int, j int, z double")
    people = spark.createDataFrame([(s, s < 8) for s in range(16)], "subject int, is_case boolean")
    edges, table = C.group_statistics(z, people, 200, 3.1)
    got = {(r.i, r.j): r for r in edges.collect()}
    assert len(got) == 15 and {k for k, r in got.items() if r.mask} == triangle
    assert all(got[k].p_fwer < 0.05 and got[k].q < 0.05 and got[k].component == 0 for k in triangle)
    top = max(table.collect(), key=lambda r: r.size)
    assert (top.component, top.size) == (0, 3) and top.p < 0.05


def test_images_of_tables(spark):
    """Resizing is linear, so the mean of resized images is the resized mean; the largest normalised power of a channel is 1."""
    import os

    import duckdb

    from meridia.operators import signal as G
    from meridia.plans.images import resized_mean
    from meridia.plans.signals import cwt_normalised

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    rows = duckdb.sql(f"SELECT label, embedding FROM '{data}/embeddings.parquet'").fetchall()
    got = {(r.label, r.cell): r["mean"] for r in resized_mean(spark, data).collect()}
    for label in {r[0] for r in rows}:
        image = G.resize(np.mean([v for k, v in rows if k == label], axis=0).reshape(1, 8, 8), 16, 16).ravel()
        assert np.allclose([got[label, c] for c in range(256)], image, atol=2e-5)
    tops = cwt_normalised(spark, data).groupBy("channel").agg(F.max(F.array_max("power")).alias("m"), F.min(F.array_min("power")).alias("l")).collect()
    assert len(tops) == len(rows) and all(r.m == 1 and r.l >= 0 for r in tops)


class Handed:
    """Stands for a table: keeps the function that mapInArrow() is given."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


@pytest.mark.parametrize("name", ["cwt_power", "cwt_normalised"])
def test_scalograms_take_bounded_memory(monkeypatch, name):
    """A batch of 3000 signals has 344 MB of power; no more than a few blocks of 8 MB stand at once."""
    import tracemalloc

    import pyarrow as pa

    from meridia.operators import signal as G
    from meridia.plans import signals

    x = np.random.default_rng(3).normal(size=(3000, 64)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(list(x), pa.list_(pa.float32()))], names=["channel", "x"])
    stub = Handed()
    monkeypatch.setattr(signals, "_embeddings", lambda spark, d: stub)
    getattr(signals, name)(None, "")
    G.cwt_power(np.zeros((1, 64)), G.cwt_grid())
    tracemalloc.start()
    before, rows = pa.total_allocated_bytes(), 0
    for out in stub.run(iter([batch])):
        assert out.nbytes <= 16 * G.CWT_VALUES and pa.total_allocated_bytes() - before <= 64 * G.CWT_VALUES
        rows += out.num_rows
    assert rows == 3000 * 224 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_scalograms_of_any_length(spark):
    from meridia.operators import signal as G
    from meridia.plans.signals import scalogram

    rng = np.random.default_rng(4)
    signals = {1: rng.normal(size=64), 2: rng.normal(size=100) * 50, 3: np.zeros(64), 4: rng.normal(size=3), 5: [], 6: None}
    df = spark.createDataFrame([(k, None if v is None else [float(e) for e in v]) for k, v in signals.items()], "channel long, x array<double>")
    for normalised in (False, True):
        got = {}
        for r in scalogram(df, normalised).orderBy("channel", "scale").collect():
            got.setdefault(r.channel, []).append(r.power)
        assert sorted(got) == [1, 2, 3, 4]  # null and empty signals have no rows
        for k, image in got.items():
            x = np.array(signals[k])
            want = np.stack([np.abs(np.convolve(x, G._morlet(len(x), f, G.FS)[0]))[G._morlet(len(x), f, G.FS)[1] :][: len(x)] ** 2 for f in G.cwt_grid()])
            assert np.allclose(image, want / (want.max() or 1) if normalised else want, rtol=1e-9, atol=6e-6)


def test_blocks_of_wavelet_power_are_the_whole():
    from meridia.operators import signal as G

    x, grid = np.random.default_rng(5).normal(size=(7, 70)), G.cwt_grid()
    whole = G.cwt_power(x, grid)
    for normalised, want in ((False, whole), (True, whole / whole.max((1, 2), keepdims=True))):
        for limit in (1, 1000, 20_000, G.CWT_VALUES):
            out = np.full(whole.shape, np.nan)
            for rows, scales, power in G.cwt_blocks(x, grid, normalised, limit):
                assert power.size <= max(limit, 70) and np.isnan(out[rows, scales]).all()
                out[rows, scales] = power
            assert np.allclose(out, want, rtol=1e-12)


def test_rounding_is_that_of_spark(spark):
    from meridia.operators import signal as G

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=2000), (rng.integers(0, 10**6, 2000) * 10 + 5) / 10**6, [0.0, -0.0, 2.675, 1.000005, -0.000005, 4.5e-6, 1e300, 123456789.123455, np.nan, np.inf, -np.inf]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").select("i", (F.round("v", 5) + 0.0).alias("v"))
    want = np.array([r.v for r in df.orderBy("i").collect()])
    assert np.array_equal(G.round_half_up(x, 5), want, equal_nan=True)
