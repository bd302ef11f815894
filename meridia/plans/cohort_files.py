"""Queries over file listings, atlas selections and the rows of a classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.catalog import query
from meridia.operators import learning as L
from meridia.operators import listing as N
from meridia.operators import relational as R
from meridia.plans.adapters import table

#: A file name an event; views have no task.
_FILES = """files AS (SELECT event_id, user_id AS folder, CASE event_type WHEN 'click' THEN 'restAP' WHEN 'error' THEN 'hammerAP' WHEN 'view' THEN NULL ELSE event_type END AS task, '0' || (1 + event_id % 3) AS run,
  CASE WHEN event_id % 2 = 0 THEN 'bold' ELSE 'events' END AS suffix, CASE WHEN event_id % 5 = 0 THEN '.nii.gz' ELSE '.h5' END AS extension FROM events)
"""


def _files(spark, d):
    e = table(spark, d, "events")
    task = F.expr("case event_type when 'click' then 'restAP' when 'error' then 'hammerAP' when 'view' then null else event_type end")
    parts = F.concat_ws("_", F.concat(F.lit("sub-"), F.col("user_id").cast("string")), F.concat(F.lit("task-"), task), F.expr("concat('run-0', 1 + event_id % 3)"), F.expr("if(event_id % 2 = 0, 'bold', 'events')"))
    return N.described(e.select("event_id", F.col("user_id").alias("folder"), F.concat(parts, F.expr("if(event_id % 5 = 0, '.nii.gz', '.h5')")).alias("name")))


@query("bids_match", "WITH " + _FILES + "SELECT event_id, folder FROM files WHERE task = 'hammerAP' AND run = '02' AND suffix = 'bold' AND extension = '.h5'")
def bids_match(spark, d):
    return N.matching(_files(spark, d), {"task": "hammerAP", "run": "02"}, "bold", ".h5").select("event_id", "folder")


@query(
    "bids_order",
    "WITH " + _FILES + """SELECT folder, array_to_string(list(event_id ORDER BY CASE task WHEN 'restAP' THEN 1 WHEN 'hammerAP' THEN 2 WHEN NULL THEN 9 ELSE CASE WHEN task IS NULL THEN 9 ELSE 3 END END, run, event_id), ',') AS files FROM files GROUP BY 1""",
)
def bids_order(spark, d):
    """Files of each folder: rest before the other named task before the rest, names without a task last, then by run."""
    rank = F.row_number().over(R.Window.partitionBy("folder").orderBy(*N.sort_keys(["task", "run"], {"task": ["restAP", "hammerAP"]}), "event_id"))
    ranked = _files(spark, d).withColumn("k", rank)
    return ranked.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_id"))), lambda s: s["event_id"].cast("string")), ",").alias("files"))


@query(
    "bids_rename",
    "WITH " + _FILES + """SELECT event_id, concat_ws('_', 'run-' || run, 'sub-' || folder, 'task-' || task, suffix) || extension AS reordered, concat_ws('_', 'sub-' || folder, 'run-' || run, suffix) || extension AS untasked,
    concat_ws('_', 'sub-' || folder, 'task-' || task, 'events') || '.tsv' AS events_file FROM files""",
)
def bids_rename(spark, d):
    e = F.col("entities")
    return _files(spark, d).select(
        "event_id",
        N.file_name(N.reordered(e, ["run"]), F.col("suffix"), F.col("extension")).alias("reordered"),
        N.file_name(N.without(e, ["task"]), F.col("suffix"), F.col("extension")).alias("untasked"),
        N.file_name(N.kept(e, ["sub", "task"]), F.lit("events"), F.lit(".tsv")).alias("events_file"),
    )


@query(
    "event_pairing",
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS sub, o_orderstatus AS task, o_orderkey % 3 AS run, o_orderpriority LIKE '1%' AS is_events FROM orders)
    SELECT e.k AS events_key, s.k AS series_key FROM o e JOIN o s USING (sub, task, run) WHERE e.is_events AND NOT s.is_events""",
)
def event_pairing(spark, d):
    """Event files and series of the same subject, task and run, whatever the order of the parts in their names."""
    o = table(spark, d, "orders")
    events = N.described(o.where("o_orderpriority like '1%'").select(F.expr("concat('run-', o_orderkey % 3, '_sub-', o_custkey, '_task-', o_orderstatus, '_id-', o_orderkey, '_events.tsv')").alias("name")))
    runs = N.described(o.where("o_orderpriority not like '1%'").select(F.expr("concat('sub-', o_custkey, '_task-', o_orderstatus, '_run-', o_orderkey % 3, '_id-', o_orderkey, '_bold.h5')").alias("name")))
    key = lambda c: F.try_element_at(R.entities(F.col(c)), F.lit("id")).cast("long")
    return N.paired(events, runs).select(key("left_name").alias("events_key"), key("right_name").alias("series_key"))


def _atlas(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("row_index"), F.col("p_name").alias("id"), F.expr("if(p_size > 25, 'subcortical', 'cortical')").alias("kind"),
        F.col("p_type").alias("region"), F.col("p_brand").alias("network"), F.expr("if(p_partkey % 2 = 0, 'LH', 'RH')").alias("hemisphere"),
    )


@query(
    "roi_predicates",
    """WITH a AS (SELECT p_partkey AS row_index, p_size > 25 AS deep, p_type AS region, p_brand AS network, p_partkey % 2 = 0 AS lh FROM part)
    SELECT row_index, CASE WHEN deep THEN CASE WHEN contains(region, 'ARGE') THEN 'ARGE' ELSE 'M' END ELSE region END AS matched FROM a
    WHERE NOT deep AND (region = 'ECONOMY' AND lh OR region = 'SMALL') AND (network = 'Brand#2' OR network = 'Brand#4' AND NOT lh OR network = 'Brand#17')
    OR deep AND (contains(region, 'ARGE') AND NOT lh OR contains(region, 'M'))""",
)
def roi_predicates(spark, d):
    """Cortical rows in both lists, names pinned to a hemisphere or not; subcortical rows that contain a pattern."""
    chosen = R.selected_rois(_atlas(spark, d), [("ECONOMY", "LH"), ("SMALL", None)], [("Brand#2", None), ("Brand#4", "RH"), ("Brand#17", None)], [("ARGE", "RH"), ("M", None)])
    return chosen.select("row_index", "matched")


@query("roi_find", "SELECT p_partkey AS row_index FROM part WHERE p_type IN ('PROMO', 'LARGE') AND p_brand = 'Brand#3'")
def roi_find(spark, d):
    return R.find_rois(_atlas(spark, d), networks=["Brand#3"], regions=["PROMO", "LARGE"]).select("row_index")


@query("any_answered", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE nullif(l_discount, 0) IS NOT NULL OR nullif(l_tax, 0) IS NOT NULL")
def any_answered(spark, d):
    items = F.expr("nullif(l_discount, 0D)"), F.expr("nullif(l_tax, 0D)")
    return table(spark, d, "lineitem").where(R.any_answered(*items)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "channel_concat",
    "SELECT vec_id AS run, unnest(range(72))::int AS channel, unnest(list_concat(embedding, embedding[1:8]))::double AS x FROM embeddings",
)
def channel_concat(spark, d):
    """A second set of eight channels numbered on from the first 64."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("run"), F.posexplode("embedding").alias("channel", "x")).withColumn("x", F.col("x").cast("double"))
    return R.concat_channels(e, e.where("channel < 8"), 64)


_FEATURES = """f AS (SELECT vec_id, label AS subject, CASE WHEN vec_id % 3 = 0 THEN 'chunk_' || vec_id % 2 ELSE 'block_1' END AS leaf, (vec_id % 500)::int AS roi, embedding::double[] AS v FROM embeddings),
cohort AS (SELECT label AS subject, CASE WHEN min(vec_id) % 3 = 0 THEN 'case' WHEN min(vec_id) % 3 = 1 THEN 'control' ELSE 'unknown' END AS cohort FROM embeddings GROUP BY 1)
"""


def _features(spark, d):
    e = table(spark, d, "embeddings")
    v = F.transform("embedding", lambda x, i: F.when((i == 3) & (F.col("vec_id") % 7 == 0), F.lit(float("nan"))).otherwise(x.cast("double")))
    features = e.select("vec_id", F.col("label").alias("subject"), F.expr("if(vec_id % 3 = 0, concat('chunk_', vec_id % 2), 'block_1')").alias("leaf"), F.expr("int(vec_id % 500)").alias("roi"), v.alias("v"))
    cohort = e.select(F.col("label").alias("subject"), F.col("vec_id").alias("file"), F.expr("element_at(array('case', 'control', 'unknown'), int(vec_id % 3) + 1)").alias("cohort"))
    return R.labelled(features, cohort, {"control": 0, "case": 1})


_GROUP = "lpad(roi::varchar, 3, '0') AS \"group\", c.cohort = 'case' AS y, vec_id % 7 = 0 AS bad, v FROM f JOIN cohort c USING (subject) WHERE cohort <> 'unknown'"
_SUM = "round(list_sum(v) - CASE WHEN bad THEN v[4] ELSE 0 END, 5)"


@query("roi_dataset", "WITH " + _FEATURES + f", r AS (SELECT vec_id, subject || '_' || leaf || '_roi' || {_GROUP}) SELECT vec_id, \"group\", y::int AS y, bad::int AS scrubbed, {_SUM} AS total FROM r")
def roi_dataset(spark, d):
    """A row a subject, leaf and region with its label; cells that are not finite become 0 and are counted."""
    f = _features(spark, d)
    rows = R.roi_rows(f.withColumn("v", F.concat("v", F.array(F.col("vec_id").cast("double")))))
    return _totals(rows)


@query("leaf_dataset", "WITH " + _FEATURES + f", r AS (SELECT vec_id, leaf, subject || '_roi' || {_GROUP} AND leaf LIKE 'chunk%') SELECT vec_id, leaf, \"group\", y::int AS y, bad::int AS scrubbed, {_SUM} AS total FROM r")
def leaf_dataset(spark, d):
    """The same for the leaves of one kind, each a data set of its own."""
    f = N.leaves(_features(spark, d), "chunk")
    rows = R.roi_rows(f.withColumn("v", F.concat("v", F.array(F.col("vec_id").cast("double")))), per_leaf=True)
    return _totals(rows, "leaf")


def _totals(rows, *more):
    total = F.aggregate(F.slice("v", 1, 64), F.lit(0.0), lambda a, x: a + x)
    return rows.select(F.element_at("v", -1).cast("long").alias("vec_id"), *more, "group", "y", "scrubbed", F.round(total, 5).alias("total"))


_CLASSES = """WITH rows AS (SELECT vec_id AS id, label AS y, embedding::double[] AS v FROM embeddings),
pairs AS (SELECT q.id AS query, x.id AS id, x.y AS y, 1 - list_dot_product(q.v, x.v) / greatest(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(x.v, x.v)), 1e-8) AS distance FROM rows q JOIN rows x ON q.id <> x.id WHERE q.id % 20 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS r FROM pairs QUALIFY r <= 11),
w AS (SELECT query, y, sum(1 / (distance + 1e-8)) AS w FROM top GROUP BY ALL)
SELECT query, arg_max(y, (w, -y))::int AS predicted, round(max(w) / sum(w), 5) AS share FROM w GROUP BY 1"""


@query("knn_classes", _CLASSES)
def knn_classes(spark, d):
    """The label of the most weight among the eleven nearest, of ten labels."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return L.vote_classes(L.nearest(rows, rows.where("id % 20 = 0").select("id", "v"), 11)).select("query", "predicted", F.round("share", 5).alias("share"))
