"""Queries of splits, neighbours, projections and calibrated classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.catalog import query
from meridia.operators import learning as L
from meridia.operators import scores as M
from meridia.plans.adapters import SCORED, scored, table

_SPLIT = """ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat('42:', {id})), {id}) AS r, count(*) OVER (PARTITION BY y) AS n FROM {src}),
split AS (SELECT *, CASE WHEN r <= round(n * 0.7) THEN 'train' WHEN r <= round(n * 0.7) + round(n * 0.15) THEN 'holdout' ELSE 'calibration' END AS split FROM ranked)
"""
_ROWS = "WITH rows AS (SELECT vec_id AS id, (label >= 5)::int AS y, embedding::double[] AS v FROM embeddings), " + _SPLIT.format(src="rows", id="id")


def rows(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("y"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))


@query("split_rows_stratified", _ROWS + "SELECT id, y, split FROM split")
def split_rows_stratified(spark, d):
    return L.stratified(rows(spark, d).select("id", "y"), "id", "y")


@query("split_subjects_stratified", "WITH s AS (SELECT DISTINCT user_id, (user_id % 2)::int AS y FROM events), " + _SPLIT.format(src="s", id="user_id") + "SELECT event_id, user_id, split FROM events JOIN split USING (user_id)")
def split_subjects_stratified(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.expr("int(user_id % 2)").alias("y"))
    return L.by_subject(e, "user_id", "y").select("event_id", "user_id", "split")


@query("balance_train", _ROWS + ", t AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat('42:', id)), id) AS k FROM split WHERE split = 'train') SELECT id, y, split FROM t WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM t GROUP BY y)) UNION ALL SELECT id, y, split FROM split WHERE split <> 'train'")
def balance_train(spark, d):
    return L.balanced(L.stratified(rows(spark, d).select("id", "y"), "id", "y"), "id", "y")


#: Every row whose id is divisible by 20, against all other rows.
_PAIRS = "pairs AS (SELECT q.id AS query, x.id AS id, x.y AS y, {dist} AS distance FROM {src} q JOIN {src} x ON q.id <> x.id WHERE q.id % 20 = 0), top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM pairs QUALIFY rank <= 11)\n"
_COS = "1 - list_dot_product(q.v, x.v) / greatest(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(x.v, x.v)), 1e-8)"
_EUC = "list_distance(q.v, x.v)"
_R = "WITH rows AS (SELECT vec_id AS id, (label >= 5)::int AS y, embedding::double[] AS v FROM embeddings), "
_WHITE = _R + """dims AS (SELECT unnest(range(64)) AS i), sd AS (SELECT i, sqrt(0.9 * var_samp(v[i + 1]) + 0.1) AS s FROM rows CROSS JOIN dims GROUP BY i), scale AS (SELECT list(s ORDER BY i) AS s FROM sd),
white AS (SELECT id, y, list_transform(list_zip(v, s), lambda p: p[1] / p[2]) AS v FROM rows CROSS JOIN scale), """


def _knn(metric, white=False):
    def run(spark, d):
        r = rows(spark, d)
        r = L.whiten_diagonal(r, 0.1) if white else r
        return L.nearest(r, r.where("id % 20 = 0").select("id", "v"), 11, metric)

    return run


def _shown(df):
    return df.select("query", "rank", "id", F.round("distance", 6).alias("distance"))


_TOP = 'SELECT query, "rank"::int AS "rank", id, round(distance, 6) AS distance FROM top'
query("knn_cosine", _R + _PAIRS.format(src="rows", dist=_COS) + _TOP)(lambda spark, d: _shown(_knn("cosine")(spark, d)))
query("knn_euclidean", _R + _PAIRS.format(src="rows", dist=_EUC) + _TOP)(lambda spark, d: _shown(_knn("euclidean")(spark, d)))
query("knn_mahalanobis_diag", _WHITE + _PAIRS.format(src="white", dist=_EUC) + _TOP)(lambda spark, d: _shown(_knn("euclidean", True)(spark, d)))


@query("knn_topk", _R + _PAIRS.format(src="rows", dist=_COS) + "SELECT query, id FROM top WHERE \"rank\" = 1")
def knn_topk(spark, d):
    return _knn("cosine")(spark, d).where("rank = 1").select("query", "id")


@query("knn_proba", _R + _PAIRS.format(src="rows", dist=_COS) + ", p AS (SELECT query, sum(CASE WHEN y = 1 THEN 1 / (distance + 1e-8) ELSE 0 END) / sum(1 / (distance + 1e-8)) AS p FROM top GROUP BY 1) SELECT query, round(p, 6) AS p, (p > 0.5)::int AS predicted FROM p")
def knn_proba(spark, d):
    return L.vote(_knn("cosine")(spark, d)).select("query", F.round("p", 6).alias("p"), "predicted")


@query("pca_project")
def pca_project(spark, d):
    """Size of each row's first eight coordinates on the principal axes, whose signs are free."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = rows(spark, d)
    mean = df.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("m")).scalar()
    df = df.withColumn("m", mean).select("id", array_to_vector(F.zip_with("v", "m", lambda a, b: a - b)).alias("v"))
    model = PCA(k=8, inputCol="v", outputCol="p").fit(df)
    return model.transform(df).select("id", F.posexplode(vector_to_array("p")).alias("component", "x")).select("id", "component", F.round(F.abs("x"), 5).alias("size"))


def _forest(spark, d, trees=100):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = L.stratified(rows(spark, d), "id", "y").withColumn("features", array_to_vector("v")).withColumn("label", F.col("y").cast("double"))
    rf = RandomForestClassifier(numTrees=trees, maxDepth=12, featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=True, seed=42)
    model = rf.fit(df.where("split = 'train'"))
    return model.transform(df.where("split <> 'train'")).select("id", "y", "split", vector_to_array("probability")[1].alias("p"))


@query("rf_proba")
def rf_proba(spark, d):
    return _forest(spark, d).select("id", "y", "split", F.round("p", 6).alias("p"))


@query("platt")
def platt(spark, d):
    """Calibrated scores; the two parameters come from sums over scores pooled by value."""
    r = scored(spark, d)
    a, b = L.platt(r)
    return r.select("id", F.round(1 / (1 + F.exp(-(F.lit(a) * F.col("p") + b))), 6).alias("calibrated"))


@query("calibrator_choice", SCORED + "SELECT id, p AS calibrated FROM scored WHERE y = 1")
def calibrator_choice(spark, d):
    """The choice by size, where it must fall back: calibration rows of one class leave the scores as they are."""
    ones = scored(spark, d).where("y = 1")
    return M.calibrate(ones, ones).select("id", "calibrated")


@query("class_counts", _ROWS + "SELECT split, count(*) AS n, count(*) FILTER (y = 1) AS positives, count(DISTINCT id) AS subjects FROM split GROUP BY 1")
def class_counts(spark, d):
    return L.stratified(rows(spark, d).select("id", "y"), "id", "y").groupBy("split").agg(F.count("*").alias("n"), F.sum((F.col("y") == 1).cast("long")).alias("positives"), F.countDistinct("id").alias("subjects"))


@query("classification_report")
def classification_report(spark, d):
    """Neighbours fitted on balanced training rows, calibrated and thresholded on the calibration split, reported on holdout."""
    split = L.balanced(L.stratified(rows(spark, d), "id", "y"), "id", "y")
    train, rest = split.where("split = 'train'"), split.where("split <> 'train'")
    p = L.vote(L.nearest(train, rest.select("id", "v"), 11, "cosine")).join(rest.select(F.col("id").alias("query"), "y", "split"), "query")
    cal = p.where("split = 'calibration'").select(F.col("query").alias("id"), "y", "p")
    fit = M.isotonic(cal)
    hold = M.isotonic_transform(p.where("split = 'holdout'").select(F.col("query").alias("id"), "y", "p"), fit).select("id", "y", F.col("calibrated").alias("p"))
    cut = M.youden(M.isotonic_transform(cal, fit).select("id", "y", F.col("calibrated").alias("p"))).select("threshold").scalar()
    hard = hold.withColumn("t", cut).groupBy("t").agg(*M.confusion(F.col("p") >= F.col("t")), M.brier().alias("brier"), M.log_loss().alias("log_loss"))
    return hard.select(F.round("t", 6).alias("threshold"), "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(k) for k, c in M.rates().items()], F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"))
