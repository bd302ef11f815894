"""Hand-computed cases and analytic invariants of the operators."""

import gzip
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia import config
from meridia.functions import series as S
from meridia.operators import connectivity as C
from meridia.operators import learning as L
from meridia.operators import relational as R
from meridia.operators import scores as M
from meridia.operators import signal as G
from meridia.sources import files, lake


def ramp(spark, values):
    return spark.createDataFrame([(0, t, float(x)) for t, x in enumerate(values)], "k int, t int, x double")


def column(df, expr):
    return [r.v for r in df.select("t", expr.alias("v")).orderBy("t").collect()]


def test_zscore_and_percent_change(spark):
    z = column(ramp(spark, [1, 2, 3, 4, 5]), S.zscore("x", ["k"]))
    assert abs(np.mean(z)) < 1e-12 and abs(np.std(z, ddof=1) - 1) < 1e-12
    assert column(ramp(spark, [10] * 5), S.zscore("x", ["k"], keep_constant=True)) == [10.0] * 5
    assert column(ramp(spark, [10] * 5), S.zscore("x", ["k"])) == [0.0] * 5
    assert np.allclose(column(ramp(spark, [100, 110, 90, 105, 95]), S.percent_change("x", ["k"])), [0, 10, -10, 5, -5])
    assert np.allclose(column(ramp(spark, [3, 5, 7, 9]), S.detrended("x", "t", ["k"])), 0)


def test_constant_and_identical_channels(spark):
    rows = [(c, t, float(x)) for t, base in enumerate([1, 4, 2, 8, 5]) for c, x in ((0, base), (1, base), (2, 7), (3, -base))]
    e = {(r.i, r.j): r for r in C.edges(spark.createDataFrame(rows, "channel int, t int, x double").withColumn("run", F.lit(1)), ["run"]).collect()}
    assert len(e) == 10 and e[0, 1].pearson == pytest.approx(1) and e[0, 1].fisher_z == pytest.approx(math.atanh(0.9999))
    assert e[0, 2].pearson is None and e[0, 2].fisher_z is None and e[0, 3].pearson == pytest.approx(-1)


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 0, 0.2), (2, 1, 0.8), (3, 1, 0.9)], "id int, y int, p double")
    assert df.agg(M.brier()).first()[0] == pytest.approx(0.025) and df.agg(M.log_loss()).first()[0] < 0.25
    assert M.auc_roc(df).first()[0] == 1
    assert M.auc_pr(df).first()[0] == 1
    assert 0.2 < M.youden(df).first().threshold <= 0.8 and 0.2 < M.f1(df).first().threshold <= 0.8
    half = spark.createDataFrame([(i, i % 2, 0.5) for i in range(6)], "id int, y int, p double")
    assert M.auc_roc(half).first()[0] == 0.5
    spec = spark.createDataFrame(list(zip([0, 0, 0, 0, 1, 1], [0.1, 0.2, 0.3, 0.4, 0.8, 0.9])), "y int, p double")
    assert M.at_specificity(spec, 0.75).first().threshold == pytest.approx(0.4)
    one = df.where("y = 1")
    assert M.auc_roc(one).first()[0] is None and M.at_specificity(one, 0.9).first().threshold == 0.0
    fit = M.isotonic(df)
    assert [r.calibrated for r in M.isotonic_transform(df, fit).orderBy("id").collect()] == [0, 0, 1, 1]
    bins = {r.bin: r.n for r in M.bins(df).collect()}
    assert len(bins) == 10 and bins[1] == bins[2] == bins[8] == bins[9] == 1


def test_confusion(spark):
    df = spark.createDataFrame(list(zip([0, 1, 0, 1, 1], [0.0, 1.0, 1.0, 1.0, 0.0])), "y int, p double")
    r = df.agg(*M.confusion(F.col("p") >= 0.5)).withColumn("acc", M.rates()["accuracy"]).first()
    assert (r.tn, r.fp, r.fn, r.tp, r.acc) == (1, 1, 1, 2, 0.6)


def test_neighbours_and_calibrators(spark):
    pts = [(0, 0, [0.0, 0.0]), (1, 0, [0.1, 0.0]), (2, 0, [0.0, 0.1]), (3, 1, [5.0, 5.0]), (4, 1, [5.1, 5.0]), (5, 1, [5.0, 5.1])]
    train = spark.createDataFrame(pts, "id long, y int, v array<double>")
    q = spark.createDataFrame([(10, [0.05, 0.05]), (11, [5.05, 5.05])], "id long, v array<double>")
    got = {r.query: r.predicted for r in L.vote(L.nearest(train, q, 3, "euclidean")).collect()}
    assert got == {10: 0, 11: 1} and L.nearest(train, q, 3, "euclidean", block=1).count() == 6
    x = np.array([[4, 2, 0.4], [2, 3, 0.5], [0.4, 0.5, 1]])
    low = np.linalg.cholesky(x)
    assert np.allclose(low @ low.T, x)
    data = np.random.default_rng(0).normal(size=(200, 3)) @ low.T
    mean, inv = L.whiten_full(data, 0.0)
    assert np.allclose(np.cov((data - mean) @ inv.T, rowvar=False), np.eye(3), atol=1e-4)
    frame = lambda p, y: spark.createDataFrame([(int(b), float(a)) for a, b in zip(p, y)], "y int, p double")
    assert L.platt(frame([0.1, 0.9], [0, 1])) == (1.0, 0.0) and L.platt(frame(np.linspace(0, 1, 9), np.ones(9))) == (1.0, 0.0)
    rng = np.random.default_rng(5)
    p = rng.random(300).round(2)
    y = (rng.random(300) < 1 / (1 + np.exp(2 - 5 * p))).astype(int)
    a, b = L.platt(frame(p, y))
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    q = 1 / (1 + np.exp(-(a * p + b)))
    assert abs((q - t).sum()) < 1e-5 and abs(((q - t) * p).sum()) < 1e-5  # the gradient of the loss
    one = frame(p[y == 1], y[y == 1])
    assert [r.calibrated for r in M.calibrate(one, one).collect()] == [r.p for r in one.collect()]
    assert M.calibrate(one, frame(p, y)).count() == M.calibrate(one, frame(p, y), "isotonic").count() == y.sum()
    d, ids = np.round(rng.random((20, 60)), 1), np.broadcast_to(rng.permutation(60), (20, 60))
    got = L._best(d, ids, ids, 7)
    for row in range(20):
        want = sorted(zip(d[row], ids[row]))[:7]
        assert list(zip(got[0][row], got[1][row])) == want
    for shape, k, want in (((50, 4), 2, 2), ((30, 4), 9, 4), ((5, 10), 20, 4)):
        axes = L.pca(np.random.default_rng(1).normal(size=shape), k)[1]
        assert len(axes) == want and np.allclose(np.linalg.norm(axes, axis=1), 1)


def test_splits(spark):
    df = spark.createDataFrame([(i, i % 2, i // 4) for i in range(80)], "id int, y int, subject int").withColumn("y", F.col("subject") % 2)
    s = L.by_subject(df, "subject", "y")
    assert s.groupBy("subject").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    counts = {(r.split, r.y): r["count"] for r in L.balanced(L.stratified(df.where("id < 60 or y = 1"), "id", "y"), "id", "y").groupBy("split", "y").count().collect()}
    assert counts["train", 0] == counts["train", 1]


def test_fdr(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.001, 0.01, 0.05, 0.1, 0.5])], "i int, p double")
    q = [r.q for r in C.bh_fdr(df, "p", ["i"]).orderBy("i").collect()]
    assert q == sorted(q) and q[0] == pytest.approx(0.005) and q[-1] == 0.5
    assert C.bh_fdr(df.where("i < 0"), "p", ["i"]).collect() == []


def test_order_by_ranges(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(700), 3)
    y = (rng.random(700) < p).astype(int)
    df = spark.createDataFrame([(int(b), float(a)) for a, b in zip(p, y)], "y int, p double")
    for r in M.curve(df).collect():
        assert (r.tp, r.fp, r.pos, r.neg) == (int(y[p >= r.p].sum()), int((1 - y)[p >= r.p].sum()), int(y.sum()), int((1 - y).sum()))
    fit = {r.p: r.y_hat for r in M.isotonic(df).collect()}
    scores = sorted(fit)
    mean = lambda a, b: y[(p >= a) & (p <= b)].mean()
    for s in scores[::40]:
        want = max(min(mean(a, b) for b in scores if b >= s) for a in scores if a <= s)
        assert fit[s] == pytest.approx(want)
    q = {r.k: r.q for r in C.bh_fdr(spark.createDataFrame([(k, float(v)) for k, v in enumerate(p)], "k int, v double"), "v", ["k"]).collect()}
    order = np.lexsort((np.arange(700), p))
    raw = np.minimum(1, p[order] * 700 / np.arange(1, 701))
    assert [q[k] for k in order] == pytest.approx(np.minimum.accumulate(raw[::-1])[::-1].tolist())


def test_permutations_by_matrix(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 14))
    x[0, :5] = np.nan
    x[1] = 2.0
    cases = np.array([rng.permutation(14) < 6 for _ in range(30)])
    got = C.welch_matrix(x, cases)
    for e in range(12):
        for k, c in enumerate(cases):
            a, b = (v[~np.isnan(v)] for v in (x[e, c], x[e, ~c]))
            se = np.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)) if min(len(a), len(b)) > 1 else 0
            assert got[e, k] == pytest.approx((a.mean() - b.mean()) / se if se > 1e-12 else 0, abs=1e-9)
    rows = [(s, e, e + 1, float(x[e, s])) for e in range(2, 12) for s in range(14)]
    z = spark.createDataFrame(rows, "subject int, i int, j int, z double")
    people = spark.createDataFrame([(s, s < 6) for s in range(14)], "subject int, is_case boolean")
    out = C.permutation_p(C.permuted(z, people, 60, blocks=3), 60).collect()
    assert len(out) == 10 and all(1 / 61 <= r.p_uncorr <= r.p_fwer <= 1 for r in out)


def test_components(spark):
    e = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 5, 6), (1, 1, 9)], "perm int, i int, j int")
    assert sorted((r.perm, r.i, r.component) for r in C.components(e, ["perm"]).collect()) == [(0, 1, 1), (0, 2, 1), (0, 5, 5), (1, 1, 1)]


def test_tones():
    t = np.arange(488)
    x = np.sin(2 * np.pi * 0.1 * t / 1.25)[None]
    assert np.argmax(G.psd(x)[0]) * 1.25 / 488 == pytest.approx(0.1, abs=0.003)
    assert G.inst_freq(x)[0, 50:-50].mean() == pytest.approx(0.1, abs=1e-3) and G.envelope(x)[0, 50:-50].mean() == pytest.approx(1, abs=0.02)
    grid = G.cwt_grid()
    assert grid[np.argmax(G.cwt_power(x, grid)[0].mean(1))] == pytest.approx(0.1, rel=0.08)
    assert grid[0] == pytest.approx(0.25) and grid[-1] == pytest.approx(0.01)


def test_mode_decomposition():
    t = np.arange(256) / 256
    x = np.stack([np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 20 * t), np.sin(2 * np.pi * 20 * t)])
    modes, freqs, n = G.mvmd(x, modes=2, alpha=2000, init="linear", fs=256)
    assert modes.shape == (2, 2, 256) and n <= 500
    assert freqs == pytest.approx([5, 20], abs=1)
    tones = np.stack([np.sin(2 * np.pi * 50 * np.arange(512) / 2000) + np.sin(2 * np.pi * 200 * np.arange(512) / 2000)])
    a, fa, _ = G.mvmd(tones, modes=2, alpha=2000, noise=1, most=200)
    b, fb, _ = G.mvmd(tones, modes=2, alpha=2000, noise=1, most=200)
    assert np.array_equal(a, b) and a.shape == (2, 1, 512) and np.abs(a).max() > 0 and fa[1] - fa[0] > 0.04


def test_images():
    assert np.allclose(G.resize_weights(7, 224).sum(1), 1) and np.allclose(G.resize(np.ones((5, 7)), 9, 11), 1)
    x = np.random.default_rng(0).normal(size=(2, 6, 6))
    w = np.random.default_rng(1).normal(size=(3, 2, 3, 3))
    y = G.conv2d(x, w, 1, 1)
    pad = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    assert y.shape == (3, 6, 6) and y[1, 2, 3] == pytest.approx((pad[:, 2:5, 3:6] * w[1]).sum())
    small = G.DenseNet(G.random_weights(1), blocks=(2, 2), growth=4, start=8)
    f = small.features(np.random.default_rng(2).normal(size=(3, 32, 32)))
    assert len(f) == (8 + 8) // 2 + 8 and np.isfinite(f).all()


def test_names(spark):
    name = "sub-LAB7XY204_task-oddball_run-03_space-native_res-1_desc-clean_bold.nii.gz"
    df = spark.createDataFrame([(name,)], "name string")
    e = R.entities(F.col("name"))
    suffix, extension = R.suffix_and_extension(F.col("name"))
    r = df.select(F.try_element_at(e, F.lit("task")).alias("task"), F.try_element_at(e, F.lit("ses")).alias("ses"), suffix.alias("s"), extension.alias("x"), R.keep_entities(e, ["sub", "run"]).alias("k")).first()
    assert tuple(r) == ("oddball", None, "bold", ".nii.gz", "sub-LAB7XY204_run-03")
    ids = spark.createDataFrame([("sub-NDARLAB7XY204",), ("NDARLAB7XY204",), ("NDAR_LAB7XY204",)], "s string")
    assert {x[0] for x in ids.select(R.canonical_subject(F.col("s"))).collect()} == {"NDARLAB7XY204"}
    assert config.selection_fingerprint("front", ["A1", "B2"], ["NUC"]) == "front:A1,B2|NUC"
    assert config.selection_fingerprint("net", ["A1"], [], ["Y", "X"]) == "net:A1||net=X,Y"
    study = config.load("sampling_rate = 2.0\nunknown = 1\n[hht]\nnum_modes = 20\n[fc]\npermutations = 10")
    assert (study.sampling_rate, study.hht.num_modes, study.hht.alpha, study.fc.permutations, study.classification.k) == (2.0, 20, 1000.0, 10, 3)


def nifti(x, affine=None):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, x.ndim, *x.shape, *[1] * (7 - x.ndim))
    struct.pack_into("<h", head, 70, 16)
    struct.pack_into("<8f", head, 76, 1, 2, 2, 2, 0, 0, 0, 0)
    struct.pack_into("<f", head, 108, 352)
    if affine is not None:
        struct.pack_into("<h", head, 254, 1)
        struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    return bytes(head) + x.astype("<f4").tobytes(order="F")


def test_volumes(spark, tmp_path):
    rng = np.random.default_rng(0)
    bold, labels = rng.normal(size=(4, 4, 4, 6)), rng.integers(0, 4, (4, 4, 4))
    x, affine = files.read_nifti(gzip.compress(nifti(bold)))
    assert np.allclose(x, bold.astype("f4")) and np.allclose(np.diag(affine), [2, 2, 2, 1])
    (tmp_path / "a.nii").write_bytes(nifti(bold))
    got = files.parcel_series(spark, f"file://{tmp_path}/*.nii", nifti(labels)).orderBy("channel").collect()
    want = [bold[labels == k].mean(0) for k in (1, 2, 3)]
    assert np.allclose([r.x for r in got], want, atol=1e-5) and [r.channel for r in got] == [0, 1, 2]
    shifted = np.eye(4)
    shifted[0, 3] = 1
    out = files.resample_labels(labels, np.eye(4), (5, 4, 4), shifted)
    assert np.array_equal(out[:3], labels[1:]) and not out[3:].any()
    with pytest.raises(ValueError):
        files.label_volume(nifti(bold))


def test_tables(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("junk\nsubjectkey,Group,age\nA,GenPop,3\nB,Other,n/a\nC,GenPop,x\n")
    got = files.delimited(spark, f"file://{tmp_path}/d.tsv", "subjectkey string, Group string, age int", sep=",", skip=1).collect()
    assert [tuple(r) for r in got] == [("A", "GenPop", 3), ("B", "Other", None), ("C", "GenPop", None)]
    (tmp_path / "lut.txt").write_text("17networks_LH_LimbicA_PFCm_1\n5 1 2 3\n17networks_RH_DefaultB_PFCv_2\n9 0 0 0\n")
    assert [tuple(r) for r in files.cortical_table(spark, f"file://{tmp_path}/lut.txt").orderBy("row_index").collect()] == [(4, "17networks_LH_LimbicA_PFCm_1"), (8, "17networks_RH_DefaultB_PFCv_2")]
    for p in ("sub-1/anat/a.nii", "sub-1/func/sub-1_task-restAP_run-01.nii", "sub-2/func/sub-2_task-hammerAP.nii"):
        (tmp_path / "data" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "data" / p).write_text("x")
    assert [tuple(r) for r in files.subject_folders(spark, f"file://{tmp_path}/data", ["restAP", "hammerAP"]).collect()] == [("sub-1", True, False)]
    head = json.dumps({"w": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}}).encode()
    tensors = files.read_tensors(struct.pack("<Q", len(head)) + head + np.array([1, 2], "<f4").tobytes())
    supply = files.weights_or_random(tensors, G.random_weights(1))
    assert list(supply("w", (2,))) == [1, 2] and supply("w", (3,)).shape == (3,)


def test_lake(spark, tmp_path):
    root, df = f"file://{tmp_path}/lake", spark.createDataFrame([(1, "rest", 1.0), (2, "hammer", 2.0)], "subject int, task string, x double")
    assert lake.missing(df, spark, root, "ts", ["subject", "task"]).count() == 2
    lake.write(df, root, "ts", ["task"])
    lake.write(spark.createDataFrame([(3, "rest", 9.0)], df.schema), root, "ts", ["task"])
    assert sorted((r.subject, r.task) for r in lake.read(spark, root, "ts").collect()) == [(2, "hammer"), (3, "rest")]
    assert [r.subject for r in lake.missing(df, spark, root, "ts", ["subject", "task"]).collect()] == [1]
    lake.write_tsv(df, f"{root}/out", ["subject"])
    assert spark.read.option("header", True).option("sep", "\t").csv(f"{root}/out").count() == 2
    assert lake.fingerprint({"a": 1, "b": 2}) == lake.fingerprint({"b": 2, "a": 1}) != lake.fingerprint({"a": 2, "b": 2})


def test_blocks(spark):
    ev = spark.createDataFrame([(1, 0.0, None), (1, 1.0, 1.0), (1, 2.0, None), (1, 3.0, 1.0)], "run int, onset double, cue double")
    got = [r.block_id for r in R.sessionize(ev, "run", ["onset"], F.col("cue").isNotNull()).orderBy("onset").collect()]
    assert got == [0, 1, 1, 2]
    runs = spark.createDataFrame([(1, [float(i) for i in range(10)])], "run int, x array<double>")
    blocks = spark.createDataFrame([(1, -2.0, 1.0), (1, 1.6, 3.9), (1, 50.0, 60.0)], "run int, onset double, end double")
    assert sorted((r.first, r.stop, r.x) for r in R.slice_blocks(blocks, runs, ["run"], 0.8).collect()) == [(0, 2, [0.0, 1.0]), (2, 5, [2.0, 3.0, 4.0])]
