"""Queries of connectivity and of group inference on its edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.catalog import query
from meridia.operators import connectivity as C
from meridia.plans.adapters import SERIES, series, table

PERMUTATIONS, PRIMARY = 200, 1.0

#: Edges of a table ({src}: {k} keys, channel, t, x) in SQL.
EDGES = """sums AS (SELECT {ka}, a.channel AS i, b.channel AS j, count(*) AS n, sum(a.x) AS sa, sum(b.x) AS sb, sum(a.x * b.x) AS sab, sum(a.x * a.x) AS saa, sum(b.x * b.x) AS sbb
  FROM {src} a JOIN {src} b ON {on} AND a.t = b.t AND a.channel <= b.channel GROUP BY ALL),
var AS (SELECT *, saa / n - sa / n * sa / n AS va, sbb / n - sb / n * sb / n AS vb FROM sums),
rs AS (SELECT {k}, i, j, CASE WHEN va <= 1e-12 * (saa / n) OR vb <= 1e-12 * (sbb / n) THEN NULL ELSE (sab / n - sa / n * sb / n) / sqrt(abs(va * vb)) END AS r FROM var),
fc AS (SELECT *, CASE WHEN r IS NULL THEN NULL ELSE atanh(greatest(least(r, 0.9999), -0.9999)) END AS z FROM rs)
"""


def _sql(src: str, keys: list[str]) -> str:
    return EDGES.format(src=src, k=", ".join(keys), ka=", ".join(f"a.{k}" for k in keys), on=" AND ".join(f"a.{k} = b.{k}" for k in keys))


FC = SERIES + ", " + _sql("series", ["subject"])


@query("fc_pearson", FC + "SELECT subject, i, j, round(r, 6) AS pearson FROM fc")
def fc_pearson(spark, d):
    return C.edges(series(spark, d), ["subject"]).select("subject", "i", "j", F.round("pearson", 6).alias("pearson"))


@query("fc_fisher_z", FC + "SELECT subject, i, j, round(z, 5) AS fisher_z FROM fc")
def fc_fisher_z(spark, d):
    return C.edges(series(spark, d), ["subject"]).select("subject", "i", "j", F.round("fisher_z", 5).alias("fisher_z"))


@query("fc_gram", FC + "SELECT subject, i, j, round(r, 6) AS pearson FROM fc")
def fc_gram(spark, d):
    runs = series(spark, d).groupBy("subject", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("x"))
    out = C.edges_gram(runs, ["subject"], "subject long, i int, j int, pearson double, fisher_z double")
    return out.select("subject", "i", "j", F.round(F.nanvl("pearson", F.lit(None).cast("double")), 6).alias("pearson"))


_BLOCK = "b AS (SELECT subject, (t // 5)::int AS block_id, channel, t, x FROM series), "


def _block_edges(spark, d):
    return C.edges(series(spark, d).withColumn("block_id", F.expr("t div 5").cast("int")), ["subject", "block_id"])


#: Centre frequencies of the six blocks when they stand for modes.
_FREQ = "element_at(array(0.012D, 0.02D, 0.03D, 0.05D, 0.1D, 0.3D), block_id + 1)"


@query(
    "band_mean_fisher",
    SERIES
    + ", "
    + _BLOCK
    + _sql("b", ["subject", "block_id"])
    + """, m AS (SELECT *, ([0.012, 0.02, 0.03, 0.05, 0.1, 0.3])[block_id + 1] AS f FROM fc), g AS (SELECT *, CASE WHEN f >= 0.01 AND f < 0.027 THEN 'slow_5' WHEN f >= 0.027 AND f < 0.073 THEN 'slow_4' WHEN f >= 0.073 AND f < 0.198 THEN 'slow_3' WHEN f >= 0.198 AND f < 0.25 THEN 'slow_2_trunc' END AS band FROM m)
    SELECT subject, band, i, j, round(avg(z), 5) AS fisher_z_mean, round(tanh(avg(z)), 5) AS pearson FROM g WHERE band IS NOT NULL GROUP BY ALL""",
)
def band_mean_fisher(spark, d):
    z = _block_edges(spark, d).withColumn("band", C.band_of(F.expr(_FREQ))).where("band is not null")
    return C.mean_z(z, ["subject", "band"]).select("subject", "band", "i", "j", F.round("fisher_z_mean", 5).alias("fisher_z_mean"), F.round("pearson", 5).alias("pearson"))


_POWER = """WITH d0 AS (SELECT min(ts)::date AS d FROM events), p AS (SELECT user_id AS subject, event_type, 0.012 * power(1.5, hour(ts) // 3) AS f, (ts::date - (SELECT d FROM d0))::int AS t, value * value AS v FROM events),
g AS (SELECT *, CASE WHEN f >= 0.01 AND f < 0.027 THEN 'slow_5' WHEN f >= 0.027 AND f < 0.073 THEN 'slow_4' WHEN f >= 0.073 AND f < 0.198 THEN 'slow_3' WHEN f >= 0.198 AND f < 0.25 THEN 'slow_2_trunc' END AS band FROM p),
power AS (SELECT subject, band, event_type AS channel, t, avg(v) AS x FROM g WHERE band IS NOT NULL GROUP BY ALL), """


@query("band_power_fc", _POWER + _sql("power", ["subject", "band"]) + "SELECT subject, band, i, j, round(r, 5) AS pearson, round(z, 4) AS fisher_z FROM fc")
def band_power_fc(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min(F.to_date("ts")).alias("d")).scalar()
    band = C.band_of(F.expr("0.012D * power(1.5D, hour(ts) div 3)"))
    p = e.select(F.col("user_id").alias("subject"), F.col("event_type").alias("channel"), band.alias("band"), F.datediff(F.to_date("ts"), first).alias("t"), (F.col("value") * F.col("value")).alias("v"))
    power = p.where("band is not null").groupBy("subject", "band", "channel", "t").agg(F.avg("v").alias("x"))
    return C.edges(power, ["subject", "band"]).select("subject", "band", "i", "j", F.round("pearson", 5).alias("pearson"), F.round("fisher_z", 4).alias("fisher_z"))


_CONDITION = SERIES + ", " + _BLOCK + _sql("b", ["subject", "block_id"]) + ", cond AS (SELECT subject, CASE WHEN block_id % 2 = 0 THEN 'face' ELSE 'shape' END AS condition, i, j, avg(z) AS m FROM fc GROUP BY ALL) "


def _conditions(spark, d):
    return C.mean_z(_block_edges(spark, d).withColumn("condition", F.expr("if(block_id % 2 = 0, 'face', 'shape')")), ["subject", "condition"])


@query("block_condition_mean", _CONDITION + "SELECT subject, condition, i, j, round(m, 5) AS fisher_z_mean FROM cond")
def block_condition_mean(spark, d):
    return _conditions(spark, d).select("subject", "condition", "i", "j", F.round("fisher_z_mean", 5).alias("fisher_z_mean"))


@query("paired_contrast", _CONDITION + "SELECT subject, i, j, round(a.m - b.m, 5) + 0.0 AS contrast FROM cond a JOIN cond b USING (subject, i, j) WHERE a.condition = 'face' AND b.condition = 'shape' AND a.m IS NOT NULL AND b.m IS NOT NULL")
def paired_contrast(spark, d):
    return C.contrast(_conditions(spark, d), "condition", "face", "shape", ["subject"]).select("subject", "i", "j", (F.round("contrast", 5) + 0.0).alias("contrast"))


_T = """n1, n0, CASE WHEN n1 < 2 OR n0 < 2 OR v1 / n1 + v0 / n0 = 0 THEN 0 ELSE (m1 - m0) / sqrt(v1 / n1 + v0 / n0) END AS t"""
_MOMENTS = "count(z) FILTER ({c}) AS n1, count(z) FILTER (NOT {c}) AS n0, avg(z) FILTER ({c}) AS m1, avg(z) FILTER (NOT {c}) AS m0, var_samp(z) FILTER ({c}) AS v1, var_samp(z) FILTER (NOT {c}) AS v0"
GROUPS = FC + f""", obs AS (SELECT i, j, {_T} FROM (SELECT i, j, {_MOMENTS.format(c='subject % 2 = 1')} FROM fc WHERE i < j GROUP BY ALL)),
subjects AS (SELECT DISTINCT subject, subject % 2 = 1 AS is_case FROM series),
perms AS (SELECT b AS perm, subject, row_number() OVER (PARTITION BY b ORDER BY md5(concat('42:', b, ':', subject))) <= (SELECT count(*) FROM subjects WHERE is_case) AS c FROM subjects CROSS JOIN (SELECT unnest(range({PERMUTATIONS})) AS b)),
nul AS (SELECT perm, i, j, {_T} FROM (SELECT perm, i, j, {_MOMENTS.format(c='c')} FROM fc JOIN perms USING (subject) WHERE i < j GROUP BY ALL)),
p AS (SELECT i, j, any_value(o.t) AS t, (1 + count(*) FILTER (abs(n.t) >= abs(o.t))) / {PERMUTATIONS + 1}.0::double AS p_uncorr FROM obs o JOIN nul n USING (i, j) GROUP BY ALL),
tops AS (SELECT perm, max(abs(t)) AS top FROM nul GROUP BY ALL),
pf AS (SELECT i, j, t, p_uncorr, (1 + (SELECT count(*) FROM tops WHERE top >= abs(p.t))) / {PERMUTATIONS + 1}.0::double AS p_fwer FROM p)
"""


def _stack(spark, d):
    z = C.edges(series(spark, d), ["subject"], diagonal=False).select("subject", "i", "j", F.col("fisher_z").alias("z"))
    subjects = table(spark, d, "events").select(F.col("user_id").alias("subject")).distinct().withColumn("is_case", F.expr("subject % 2 = 1"))
    return z, subjects, C.welch(z, ["i", "j"], F.expr("subject % 2 = 1"))


@query("welch_t", GROUPS + "SELECT i, j, round(t, 6) AS t FROM obs")
def welch_t(spark, d):
    return _stack(spark, d)[2].select("i", "j", F.round("t", 6).alias("t"))


def _inference(spark, d):
    z, subjects, _ = _stack(spark, d)
    return C.permutation_p(C.permuted(z, subjects, PERMUTATIONS), PERMUTATIONS)


@query("permutation_p", GROUPS + "SELECT i, j, round(p_uncorr, 6) AS p_uncorr FROM pf")
def permutation_p(spark, d):
    return _inference(spark, d).select("i", "j", F.round("p_uncorr", 6).alias("p_uncorr"))


@query("fwer_p", GROUPS + "SELECT i, j, round(p_fwer, 6) AS p_fwer FROM pf")
def fwer_p(spark, d):
    return _inference(spark, d).select("i", "j", F.round("p_fwer", 6).alias("p_fwer"))


@query(
    "bh_fdr",
    GROUPS
    + """, ranked AS (SELECT *, row_number() OVER (ORDER BY p_uncorr, i, j) AS k, count(*) OVER () AS n FROM pf)
    SELECT i, j, round(p_uncorr, 6) AS p_uncorr, round(min(least(1, p_uncorr * n / k)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 6) AS q FROM ranked""",
)
def bh_fdr(spark, d):
    return C.bh_fdr(_inference(spark, d), "p_uncorr", ["i", "j"]).select("i", "j", F.round("p_uncorr", 6).alias("p_uncorr"), F.round("q", 6).alias("q"))


_NBS = GROUPS.replace("WITH d0", "WITH RECURSIVE d0", 1) + f""", sup AS (SELECT -1 AS perm, i, j FROM obs WHERE abs(t) >= {PRIMARY} UNION ALL SELECT perm, i, j FROM nul WHERE abs(t) >= {PRIMARY}),
und AS (SELECT perm, i AS a, j AS b FROM sup UNION SELECT perm, j, i FROM sup),
reach AS (SELECT perm, a, a AS r FROM und UNION SELECT u.perm, u.a, reach.r FROM und u JOIN reach ON reach.perm = u.perm AND reach.a = u.b),
low AS (SELECT perm, a, min(r) AS component FROM reach GROUP BY ALL),
comp AS (SELECT s.perm, s.i, s.j, component FROM sup s JOIN low ON low.perm = s.perm AND low.a = s.i),
sizes AS (SELECT perm, component, count(*) AS size FROM comp GROUP BY ALL)
"""


def _components(spark, d):
    z, subjects, _ = _stack(spark, d)
    over = C.permuted(z, subjects, PERMUTATIONS, primary=PRIMARY).where("kind = 'over'").select("perm", "i", "j")
    return C.components(over, ["perm"])


@query("nbs_components", _NBS + "SELECT i, j, component FROM comp WHERE perm = -1")
def nbs_components(spark, d):
    return _components(spark, d).where("perm = -1").select("i", "j", "component")


@query(
    "nbs_component_p",
    _NBS + f", big AS (SELECT perm, max(size) AS size FROM sizes WHERE perm >= 0 GROUP BY ALL) SELECT component, size::bigint AS size, round((1 + (SELECT count(*) FROM big WHERE big.size >= s.size)) / {PERMUTATIONS + 1}.0::double, 6) AS p FROM sizes s WHERE perm = -1",
)
def nbs_component_p(spark, d):
    sizes = _components(spark, d).groupBy("perm", "component").agg(F.count("*").alias("size"))
    tops = sizes.where("perm >= 0").groupBy("perm").agg(F.max("size").alias("size")).agg(F.collect_list("size").alias("s")).scalar()
    out = sizes.where("perm = -1").withColumn("tops", tops)
    return out.select("component", "size", F.round((1 + F.size(F.filter("tops", lambda s: s >= F.col("size")))) / (PERMUTATIONS + 1), 6).alias("p"))


_RUN = _NBS + f""", ranked AS (SELECT *, row_number() OVER (ORDER BY p_uncorr, i, j) AS k, count(*) OVER () AS n FROM pf),
qs AS (SELECT *, min(least(1, p_uncorr * n / k)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS q FROM ranked),
big AS (SELECT perm, max(size) AS size FROM sizes WHERE perm >= 0 GROUP BY ALL),
cp AS (SELECT component, (1 + (SELECT count(*) FROM big WHERE big.size >= s.size)) / {PERMUTATIONS + 1}.0::double AS p FROM sizes s WHERE perm = -1),
mem AS (SELECT i, j, component, p FROM comp JOIN cp USING (component) WHERE perm = -1)
"""


@query(
    "group_statistics",
    _RUN + "SELECT i, j, round(t, 6) AS t, round(p_uncorr, 6) AS p_uncorr, round(p_fwer, 6) AS p_fwer, round(q, 6) AS q, component, round(p, 6) AS p_component, coalesce(p < 0.05, false) AS mask FROM qs LEFT JOIN mem USING (i, j)",
)
def group_statistics(spark, d):
    z, subjects, _ = _stack(spark, d)
    edges, _ = C.group_statistics(z, subjects, PERMUTATIONS, PRIMARY)
    return edges.select("i", "j", "component", "mask", *[F.round(c, 6).alias(c) for c in ("t", "p_uncorr", "p_fwer", "q", "p_component")])


@query("fc_lookup", FC + "SELECT subject, i, j, round(r, 6) AS pearson FROM fc WHERE subject = 7 AND i = 0")
def fc_lookup(spark, d):
    """One row of one subject's matrix: the filter on the key reaches the scan of the events."""
    return C.edges(series(spark, d).where("subject = 7"), ["subject"]).where("i = 0").select("subject", "i", "j", F.round("pearson", 6).alias("pearson"))
