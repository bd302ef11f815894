"""Queries of the relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.catalog import query
from meridia.operators import relational as R
from meridia.plans.adapters import SERIES, series, table


@query("scan_filter_project", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def scan_filter_project(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_acctbal")


@query("distinct_key", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders GROUP BY 1")
def distinct_key(spark, d):
    return R.one_per_key(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderpriority"])


@query(
    "item_score_sum",
    """SELECT l_orderkey, sum((CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity > 25 THEN 1 ELSE 0 END) + (l_discount > 0.05)::int + (l_returnflag = 'R')::int + (l_tax > 0.04)::int)::bigint AS score
    FROM lineitem GROUP BY 1""",
)
def item_score_sum(spark, d):
    items = [F.expr("if(l_quantity < 5, -9, int(l_quantity > 25))"), F.expr("int(l_discount > 0.05D)"), F.expr("int(l_returnflag = 'R')"), F.expr("int(l_tax > 0.04D)")]
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(R.item_score(*items)).cast("long").alias("score"))


@query(
    "row_mean_null_strict",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity + nullif(l_discount, 0) * 100 + nullif(l_tax, 0) * 100) / 3, 6) AS mean FROM lineitem",
)
def row_mean_null_strict(spark, d):
    mean = R.strict_mean(F.col("l_quantity"), F.expr("nullif(l_discount, 0D) * 100"), F.expr("nullif(l_tax, 0D) * 100"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(mean, 6).alias("mean"))


_PRICE = "price AS (SELECT o_custkey AS c_custkey, avg(o_totalprice) AS price FROM orders GROUP BY 1)"


@query(
    "population_threshold",
    f"WITH {_PRICE}, lim AS (SELECT avg(price) - 1.5 * stddev_samp(price) AS t FROM price) SELECT c_custkey, round(price, 4) AS price, round(t, 4) AS threshold FROM price, lim WHERE price < t",
)
def population_threshold(spark, d):
    price = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("price"))
    return R.below_population(price, "price", 1.5).select("c_custkey", F.round("price", 4).alias("price"), F.round("threshold", 4).alias("threshold"))


@query(
    "union_distinct",
    "SELECT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def union_distinct(spark, d):
    c = table(spark, d, "customer")
    flagged = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return flagged.union(c.where("c_acctbal < 0").select("c_custkey")).union(c.where("c_mktsegment = 'BUILDING'").select("c_custkey")).distinct()


@query("anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_join(spark, d):
    seen = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(seen, "c_custkey", "left_anti")


@query("inner_join_semantics", "SELECT c_custkey, o_orderkey, c_mktsegment, o_orderstatus FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice >= 300000")
def inner_join_semantics(spark, d):
    o = table(spark, d, "orders").where("o_totalprice >= 300000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey").select("c_custkey", "o_orderkey", "c_mktsegment", "o_orderstatus")


@query(
    "cohort_selection",
    f"""WITH {_PRICE}, lim AS (SELECT avg(price) - 1.5 * stddev_samp(price) AS t FROM price),
    pool AS (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY'),
    flagged AS (SELECT c_custkey FROM price, lim WHERE price < t UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0),
    present AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'F')
    SELECT c_custkey, 'control' AS cohort FROM pool WHERE c_custkey IN (SELECT c_custkey FROM present) AND c_custkey NOT IN (SELECT c_custkey FROM flagged)
    UNION ALL SELECT c_custkey, 'case' FROM flagged WHERE c_custkey IN (SELECT c_custkey FROM present)""",
)
def cohort_selection(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    price = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("price"))
    present = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.cohorts(c.where("c_mktsegment <> 'MACHINERY'"), [R.below_population(price, "price", 1.5), c.where("c_acctbal < 0")], present, "c_custkey")


@query(
    "roi_select",
    """SELECT p_partkey AS row_index, p_brand AS network, p_type AS region, CASE WHEN p_partkey % 2 = 0 THEN 'LH' ELSE 'RH' END AS hemisphere FROM part
    WHERE p_type IN ('ECONOMY', 'SMALL') AND p_brand IN ('Brand#2', 'Brand#4', 'Brand#17') AND p_partkey % 2 = 0""",
)
def roi_select(spark, d):
    atlas = table(spark, d, "part").select(F.col("p_partkey").alias("row_index"), F.col("p_brand").alias("network"), F.col("p_type").alias("region"), F.expr("if(p_partkey % 2 = 0, 'LH', 'RH')").alias("hemisphere"))
    return R.roi_select(atlas, ["ECONOMY", "SMALL"], ["Brand#2", "Brand#4", "Brand#17"], "LH")


@query(
    "atlas_label_parse",
    """WITH ids AS (SELECT p_partkey, '17networks_' || (CASE WHEN p_partkey % 2 = 0 THEN 'LH' ELSE 'RH' END) || '_' || replace(p_brand, '#', '') || '_' || p_type || (CASE WHEN p_size > 25 THEN '_' || p_size ELSE '' END) AS id FROM part)
    SELECT p_partkey, split_part(id, '_', 2) AS hemisphere, split_part(id, '_', 3) AS network, split_part(id, '_', 4) AS region, try_cast(split_part(id, '_', -1) AS INTEGER) AS parcel FROM ids""",
)
def atlas_label_parse(spark, d):
    label = F.expr("concat('17networks_', if(p_partkey % 2 = 0, 'LH', 'RH'), '_', replace(p_brand, '#', ''), '_', p_type, if(p_size > 25, concat('_', p_size), ''))")
    return table(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in R.parse_atlas_id(label).items()])


_NAME = "concat('sub-NDAR', doc_id, '_task-', {}, '_run-0', 1 + doc_id % 2, '_desc-preproc_bold', {})"


@query(
    "bids_parse",
    f"""WITH names AS (SELECT doc_id, {_NAME.format("CASE WHEN doc_id % 3 = 0 THEN 'hammerAP' ELSE 'rest-AP' END", "CASE WHEN doc_id % 2 = 0 THEN '.nii.gz' ELSE '.h5' END")} AS name FROM documents)
    SELECT doc_id, regexp_extract(name, '(^|_)sub-([^_.]*)', 2) AS sub, regexp_extract(name, '_task-([^_.]*)', 1) AS task, regexp_extract(name, '_run-([^_.]*)', 1) AS run,
    'bold' AS suffix, regexp_extract(name, '^[^.]*([.].*)$', 1) AS extension, regexp_extract(name, '^(sub-[^_]*_task-[^_]*)', 1) AS stem FROM names""",
)
def bids_parse(spark, d):
    name = F.expr(_NAME.format("if(doc_id % 3 = 0, 'hammerAP', 'rest-AP')", "if(doc_id % 2 = 0, '.nii.gz', '.h5')"))
    rows = table(spark, d, "documents").select("doc_id", name.alias("name"))
    e = R.entities(F.col("name"))
    suffix, extension = R.suffix_and_extension(F.col("name"))
    return rows.select("doc_id", *[F.try_element_at(e, F.lit(k)).alias(k) for k in ("sub", "task", "run")], suffix.alias("suffix"), extension.alias("extension"), R.keep_entities(e, ["sub", "task"]).alias("stem"))


@query(
    "subject_id_normalize",
    "SELECT doc_id, 'NDARINV' || doc_id AS subject FROM documents",
)
def subject_id_normalize(spark, d):
    spelt = F.expr("concat(element_at(array('sub-NDARINV', 'NDAR_INV', 'NDARINV'), int(doc_id % 3) + 1), doc_id)")
    return table(spark, d, "documents").select("doc_id", R.canonical_subject(spelt).alias("subject"))


@query(
    "group_key_parse",
    """WITH k AS (SELECT event_id, user_id::varchar || (CASE WHEN event_id % 2 = 0 THEN '_' || event_type ELSE '' END) || '_roi' || lpad((event_id % 500)::varchar, 3, '0') AS key FROM events)
    SELECT event_id, key, split_part(key, '_', 1) AS subject, regexp_extract(key, '_roi([0-9]+)$', 1)::int AS roi FROM k""",
)
def group_key_parse(spark, d):
    e = table(spark, d, "events").select("event_id", R.group_key(F.col("user_id").cast("string"), F.expr("if(event_id % 2 = 0, event_type, null)"), F.expr("int(event_id % 500)")).alias("key"))
    subject, roi = R.parse_group_key(F.col("key"))
    return e.select("event_id", "key", subject.alias("subject"), roi.alias("roi"))


_BLOCKS = "blocks AS (SELECT *, sum((event_type = 'signup')::int) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block_id FROM events)"


def _sessions(spark, d):
    return R.sessionize(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup")


@query("block_sessionize", f"WITH {_BLOCKS} SELECT event_id, user_id, block_id::bigint AS block_id FROM blocks")
def block_sessionize(spark, d):
    return _sessions(spark, d).select("event_id", "user_id", "block_id")


@query(
    "block_agg",
    f"""WITH {_BLOCKS} SELECT user_id, block_id::bigint AS block_id, arg_min(event_type, (ts, event_id)) AS trial_type, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value,
    round(avg(value), 6) AS mean_response, round(median(value), 6) AS median_response, count(event_type) AS n_trials, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS span,
    array_to_string(list(event_id ORDER BY ts, event_id), ',') AS trials FROM blocks GROUP BY 1, 2""",
)
def block_agg(spark, d):
    at = F.struct("ts", "event_id")
    first, last = F.min_by("value", at), F.max_by("value", at)
    trials = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda s: s["event_id"].cast("string"))
    return _sessions(spark, d).groupBy("user_id", "block_id").agg(
        F.min_by("event_type", at).alias("trial_type"), first.alias("first_value"), last.alias("last_value"), F.round(F.avg("value"), 6).alias("mean_response"),
        F.round(F.median("value"), 6).alias("median_response"), F.count("event_type").alias("n_trials"), F.round(last - first, 6).alias("span"), F.array_join(trials, ",").alias("trials"),
    )


@query(
    "block_slice",
    SERIES
    + """, blocks AS (SELECT user_id AS subject, event_id, (epoch(ts) - epoch((SELECT d FROM d0)::timestamp)) / 86400 - 0.5 AS onset, (epoch(ts) - epoch((SELECT d FROM d0)::timestamp)) / 86400 + value / 100 AS stop FROM events WHERE event_type = 'purchase'),
    b AS (SELECT *, greatest(floor(onset / 0.8), 0)::int AS lo, least(ceil(stop / 0.8), 30)::int AS hi FROM blocks)
    SELECT event_id, b.subject, channel, lo AS first, hi AS stop, round(sum(x), 4) AS total, count(*)::int AS n FROM b JOIN series s ON s.subject = b.subject AND t >= lo AND t < hi GROUP BY ALL""",
)
def block_slice(spark, d):
    runs = series(spark, d).groupBy("subject", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("x"))
    events = table(spark, d, "events")
    start = events.agg(F.min(F.to_date("ts")).alias("d")).scalar()
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_seconds(start.cast("timestamp"))) / 86400
    blocks = events.where("event_type = 'purchase'").select(F.col("user_id").alias("subject"), "event_id", (at - 0.5).alias("onset"), (at + F.col("value") / 100).alias("end"))
    out = R.slice_blocks(blocks, runs, ["subject"], 0.8)
    return out.select("event_id", "subject", "channel", "first", "stop", F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("x").alias("n"))


@query(
    "parcel_mean",
    """WITH v AS (SELECT l_suppkey AS label, month(l_shipdate)::int AS t, l_quantity AS value FROM lineitem), labels AS (SELECT s_suppkey AS label FROM supplier UNION ALL SELECT -1)
    SELECT label, t, round(coalesce(m, 0), 6) AS x FROM labels CROSS JOIN (SELECT DISTINCT t FROM v) LEFT JOIN (SELECT label, t, avg(value) AS m FROM v WHERE label <> 0 GROUP BY ALL) USING (label, t)""",
)
def parcel_mean(spark, d):
    voxels = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("label"), F.month("l_shipdate").alias("t"), F.col("l_quantity").alias("value"))
    labels = table(spark, d, "supplier").select(F.col("s_suppkey").alias("label")).union(spark.range(1).select(F.lit(-1).cast("long")))
    return R.parcel_means(voxels, labels).select("label", "t", F.round("x", 6).alias("x"))


@query("label_index", 'SELECT l_suppkey AS label, (row_number() OVER (ORDER BY l_suppkey) - 1)::int AS "row" FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey <> 0)')
def label_index(spark, d):
    return R.label_index(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("label")))
