"""Queries of the metrics and of calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.catalog import query
from meridia.operators import scores as M
from meridia.plans.adapters import SCORED, scored

_C = "count(*) FILTER (p >= {t} AND y = 1) AS tp, count(*) FILTER (p >= {t} AND y = 0) AS fp, count(*) FILTER (p < {t} AND y = 0) AS tn, count(*) FILTER (p < {t} AND y = 1) AS fn"
_RATES = """round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity"""
_MORE = """round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tn / nullif(tn + fn, 0), 6) AS npv, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
round((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc"""


def _rounded(names, digits=6):
    r = M.rates()
    return [F.round(r[n], digits).alias(n) for n in names]


@query("confusion_metrics", SCORED + f", c AS (SELECT {_C.format(t=0.5)} FROM scored) SELECT tp, fp, tn, fn, {_RATES} FROM c")
def confusion_metrics(spark, d):
    return scored(spark, d).agg(*M.confusion(F.col("p") >= 0.5)).select("tp", "fp", "tn", "fn", *_rounded(["accuracy", "sensitivity", "specificity"]))


@query("hard_report", SCORED + f", c AS (SELECT {_C.format(t=0.5)} FROM scored) SELECT {_RATES}, {_MORE} FROM c")
def hard_report(spark, d):
    return scored(spark, d).agg(*M.confusion(F.col("p") >= 0.5)).select(*_rounded(M.rates()))


@query("brier", SCORED + "SELECT round(avg((p - y) * (p - y)), 8) AS brier FROM scored")
def brier(spark, d):
    return scored(spark, d).agg(F.round(M.brier(), 8).alias("brier"))


@query("log_loss", SCORED + "SELECT round(avg(-ln(CASE WHEN y = 1 THEN greatest(least(p, 1 - 1e-7), 1e-7) ELSE 1 - greatest(least(p, 1 - 1e-7), 1e-7) END)), 8) AS log_loss FROM scored")
def log_loss(spark, d):
    return scored(spark, d).agg(F.round(M.log_loss(), 8).alias("log_loss"))


_CURVE = SCORED + """, g AS (SELECT p, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM scored GROUP BY p),
curve AS (SELECT p, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER () AS pos, sum(b) OVER () AS neg FROM g WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
roc AS (SELECT p, (fp / neg)::double AS fpr, (tp / pos)::double AS tpr FROM curve WHERE pos > 0 AND neg > 0 UNION ALL SELECT 'infinity'::double, 0, 0),
pr AS (SELECT p, (tp / pos)::double AS recall, (tp / (tp + fp))::double AS "precision" FROM curve WHERE pos > 0)
"""


@query("roc_curve", _CURVE + "SELECT round(fpr, 8) AS fpr, round(tpr, 8) AS tpr FROM roc")
def roc_curve(spark, d):
    return M.roc(scored(spark, d)).select(F.round("fpr", 8).alias("fpr"), F.round("tpr", 8).alias("tpr"))


@query("pr_curve", _CURVE + 'SELECT round(recall, 8) AS recall, round("precision", 8) AS "precision" FROM pr')
def pr_curve(spark, d):
    return M.pr(scored(spark, d)).select(F.round("recall", 8).alias("recall"), F.round("precision", 8).alias("precision"))


@query("auc_roc", _CURVE + ", s AS (SELECT fpr - lag(fpr, 1, 0) OVER w AS dx, (tpr + lag(tpr, 1, 0) OVER w) / 2 AS m FROM roc WINDOW w AS (ORDER BY p DESC)) SELECT round(sum(dx * m), 8) AS auc FROM s")
def auc_roc(spark, d):
    return M.auc_roc(scored(spark, d)).select(F.round("auc", 8).alias("auc"))


@query("auc_pr", _CURVE + ', s AS (SELECT recall - lag(recall, 1, 0) OVER w AS dx, ("precision" + coalesce(lag("precision") OVER w, "precision")) / 2 AS m FROM pr WINDOW w AS (ORDER BY p DESC)) SELECT round(sum(dx * m), 8) AS auc FROM s')
def auc_pr(spark, d):
    return M.auc_pr(scored(spark, d)).select(F.round("auc", 8).alias("auc"))


_BINS = SCORED + ", g AS (SELECT least(floor(p * 10), 9)::int AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM scored GROUP BY 1), bins AS (SELECT b.bin, coalesce(n, 0) AS n, mean_p, rate FROM (SELECT unnest(range(10))::int AS bin) b LEFT JOIN g USING (bin)) "


@query("calibration_bins", _BINS + "SELECT bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM bins")
def calibration_bins(spark, d):
    return M.bins(scored(spark, d)).select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"))


@query("ece", _BINS + "SELECT round(sum(coalesce(abs(mean_p - rate), 0) * n) / sum(n), 8) AS ece FROM bins")
def ece(spark, d):
    return M.ece(scored(spark, d)).select(F.round("ece", 8).alias("ece"))


@query("threshold_sweep", SCORED + f", c AS (SELECT threshold, {_C.format(t='threshold')} FROM scored CROSS JOIN (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7])::double AS threshold) GROUP BY 1) SELECT threshold, tp, fp, tn, fn, {_RATES}, {_MORE} FROM c")
def threshold_sweep(spark, d):
    return M.sweep(scored(spark, d)).select("threshold", "tp", "fp", "tn", "fn", *_rounded(M.rates()))


_CAND = SCORED + """, g AS (SELECT p, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM (SELECT p, y FROM scored UNION ALL SELECT 0, NULL UNION ALL SELECT 1, NULL) GROUP BY p),
curve AS (SELECT p, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER () AS pos, sum(b) OVER () AS neg FROM g WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
c AS (SELECT p, round(coalesce(tp / nullif(pos, 0), 0) + coalesce((neg - fp) / nullif(neg, 0), 0) - 1, 12) AS youden, round(coalesce(2 * tp / nullif(2 * tp + fp + pos - tp, 0), 0), 12) AS f1, (neg - fp) / nullif(neg, 0) AS spec FROM curve)
"""


@query("youden_threshold", _CAND + "SELECT arg_max(p, (youden, -p)) AS threshold, round(max(youden), 8) AS score FROM c")
def youden_threshold(spark, d):
    return M.youden(scored(spark, d)).select("threshold", F.round("score", 8).alias("score"))


@query("f1_threshold", _CAND + "SELECT arg_max(p, (f1, -p)) AS threshold, round(max(f1), 8) AS score FROM c")
def f1_threshold(spark, d):
    return M.f1(scored(spark, d)).select("threshold", F.round("score", 8).alias("score"))


@query("spec_threshold", _CAND + "SELECT coalesce(min(p) FILTER (spec >= 0.9), 1.0)::double AS threshold FROM c")
def spec_threshold(spark, d):
    return M.at_specificity(scored(spark, d), 0.9)


_PAV = SCORED + """, g AS (SELECT p, sum(y)::double AS s, count(*) AS n, row_number() OVER (ORDER BY p) AS i FROM scored GROUP BY p),
cum AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(n) OVER (ORDER BY i) AS cn FROM g),
means AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM cum a JOIN cum b ON a.i <= b.i),
inner_min AS (SELECT a, g.i, min(m) AS m FROM means JOIN g ON a <= g.i AND b >= g.i GROUP BY ALL),
fit AS (SELECT g.p, max(m) AS y_hat FROM inner_min JOIN g USING (i) GROUP BY ALL)
"""


@query("isotonic_pav", _PAV + "SELECT p, round(y_hat, 8) AS y_hat FROM fit")
def isotonic_pav(spark, d):
    return M.isotonic(scored(spark, d)).select("p", F.round("y_hat", 8).alias("y_hat"))


@query(
    "isotonic_transform",
    _PAV
    + """, q AS (SELECT id, p * p AS p FROM scored), lo AS (SELECT id, q.p AS p, arg_max(y_hat, f.p) AS ly, max(f.p) AS lp FROM q LEFT JOIN fit f ON f.p <= q.p GROUP BY ALL), hi AS (SELECT id, arg_min(y_hat, f.p) AS hy, min(f.p) AS hp FROM q LEFT JOIN fit f ON f.p >= q.p GROUP BY ALL)
    SELECT id, round(CASE WHEN ly IS NULL THEN hy WHEN hy IS NULL THEN ly ELSE ly + coalesce((p - lp) / nullif(hp - lp, 0), 0) * (hy - ly) END, 6) AS calibrated FROM lo JOIN hi USING (id)""",
)
def isotonic_transform(spark, d):
    rows = scored(spark, d)
    out = M.isotonic_transform(rows.withColumn("p", F.col("p") * F.col("p")), M.isotonic(rows))
    return out.select("id", F.round("calibrated", 6).alias("calibrated"))
