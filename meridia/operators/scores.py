"""Probabilistic and hard metrics, curves, thresholds and calibration from (id, y, p) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.ranges import cut_points, range_of, running

EPS, BINS, SWEEP = 1e-7, 10, (0.3, 0.4, 0.5, 0.6, 0.7)


def finite(df: DataFrame) -> DataFrame:
    return df.where(~F.isnan("p") & (F.abs("p") < float("inf")))


def confusion(positive: Column) -> list[Column]:
    """tp, fp, tn, fn of a decision."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    y = F.col("y") == 1
    return [n(positive & y).alias("tp"), n(positive & ~y).alias("fp"), n(~positive & ~y).alias("tn"), n(~positive & y).alias("fn")]


def rates() -> dict[str, Column]:
    """Figures of columns tp, fp, tn, fn; null where undefined."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return {
        "accuracy": F.try_divide(tp + tn, tp + fp + tn + fn),
        "sensitivity": recall,
        "specificity": F.try_divide(tn, tn + fp),
        "precision": precision,
        "npv": F.try_divide(tn, tn + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        "mcc": F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }


def brier() -> Column:
    return F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))


def log_loss() -> Column:
    q = F.greatest(F.least(F.col("p"), F.lit(1 - EPS)), F.lit(EPS))
    return F.avg(-F.log(F.when(F.col("y") == 1, q).otherwise(1 - q)))


def curve(df: DataFrame) -> DataFrame:
    """p, tp, fp, pos, neg, a, b: counts at or above each distinct finite score, from the highest down; a, b: at the score."""
    by = finite(df).groupBy("p").agg(F.sum((F.col("y") == 1).cast("long")).alias("a"), F.sum((F.col("y") != 1).cast("long")).alias("b"))
    out = running(by, "p", ["a", "b"], cut_points(by, "p"))
    return out.select("p", F.col("a_to").alias("tp"), F.col("b_to").alias("fp"), F.col("a_all").alias("pos"), F.col("b_all").alias("neg"), "a", "b")


def roc(df: DataFrame) -> DataFrame:
    c = curve(df).where("pos > 0 and neg > 0")
    points = c.select("p", (F.col("fp") / F.col("neg")).alias("fpr"), (F.col("tp") / F.col("pos")).alias("tpr"))
    start = points.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(float("inf")).alias("p"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points)


def pr(df: DataFrame) -> DataFrame:
    return curve(df).where("pos > 0").select("p", (F.col("tp") / F.col("pos")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def auc_roc(df: DataFrame) -> DataFrame:
    """Trapezoids under the curve: each point's own counts lead back to the point before it."""
    area = F.col("b") / F.col("neg") * (2 * F.col("tp") - F.col("a")) / (2 * F.col("pos"))
    return curve(df).where("pos > 0 and neg > 0").agg(F.sum(area).alias("auc"))


def auc_pr(df: DataFrame) -> DataFrame:
    """Trapezoids of precision over recall; before the first point its own precision holds."""
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.try_divide(F.col("tp") - F.col("a"), F.col("tp") - F.col("a") + F.col("fp") - F.col("b"))
    return curve(df).where("pos > 0").agg(F.sum(F.col("a") / F.col("pos") * (here + F.coalesce(before, here)) / 2).alias("auc"))


def bins(df: DataFrame, n: int = BINS) -> DataFrame:
    """bin, count, mean score and observed rate; empty bins stay, with null means."""
    which = F.least(F.floor(F.col("p") * n), F.lit(n - 1)).cast("int")
    got = finite(df).groupBy(which.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").fillna(0, ["n"])


def ece(df: DataFrame, n: int = BINS) -> DataFrame:
    return bins(df, n).agg(F.sum(F.coalesce(F.abs(F.col("mean_p") - F.col("rate")), F.lit(0.0)) * F.col("n")).alias("s"), F.sum("n").alias("n")).select(F.try_divide("s", F.col("n")).alias("ece"))


def sweep(df: DataFrame, thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    each = df.select("y", "p", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return each.groupBy("threshold").agg(*confusion(F.col("p") >= F.col("threshold")))


def candidates(df: DataFrame) -> DataFrame:
    """Threshold counts at every distinct finite score and at 0 and 1."""
    ends = df.sparkSession.range(2).select(F.col("id").cast("double").alias("p"), F.lit(None).cast("int").alias("y"))
    rows = finite(df).select("p", F.col("y").cast("int").alias("y")).union(ends)
    by = rows.groupBy("p").agg(F.sum((F.coalesce(F.col("y"), F.lit(-1)) == 1).cast("long")).alias("a"), F.sum((F.coalesce(F.col("y"), F.lit(-1)) == 0).cast("long")).alias("b"))
    out = running(by, "p", ["a", "b"], cut_points(by, "p"))
    c = out.select("p", F.col("a_to").alias("tp"), F.col("b_to").alias("fp"), F.col("a_all").alias("pos"), F.col("b_all").alias("neg"))
    return c.select("p", "tp", "fp", (F.col("neg") - F.col("fp")).alias("tn"), (F.col("pos") - F.col("tp")).alias("fn"))


def best(df: DataFrame, score: Column) -> DataFrame:
    """The candidate with the highest score; ties: the lowest threshold."""
    c = candidates(df).withColumn("score", F.round(score, 12))
    return c.agg(F.max_by("p", F.struct("score", -F.col("p"))).alias("threshold"), F.max("score").alias("score"))


def youden(df: DataFrame) -> DataFrame:
    r = rates()
    return best(df, F.coalesce(r["sensitivity"], F.lit(0.0)) + F.coalesce(r["specificity"], F.lit(0.0)) - 1)


def f1(df: DataFrame) -> DataFrame:
    return best(df, F.coalesce(rates()["f1"], F.lit(0.0)))


def at_specificity(df: DataFrame, target: float) -> DataFrame:
    """The lowest threshold with that specificity, else 1; 0 without negatives."""
    c = candidates(df).withColumn("s", rates()["specificity"])
    none = F.max(F.col("tn") + F.col("fp")) == 0
    return c.agg(F.when(none, 0.0).otherwise(F.coalesce(F.min(F.when(F.col("s") >= target, F.col("p"))), F.lit(1.0))).alias("threshold"))


def isotonic(df: DataFrame) -> DataFrame:
    """p, y_hat: non-decreasing fit of mean y by distinct score: adjacent violators are pooled.

    Pools of a range of scores are pools of any larger range's pooling too, so each range is pooled in a task of its own, and
    one last pass pools the ranges' pools, a few figures each. The pools then go back to the scores of their ranges.
    """
    by = finite(df).groupBy("p").agg(F.sum(F.col("y").cast("double")).alias("s"), F.count("*").alias("n"))
    points = cut_points(by, "p")
    by = by.withColumn("range_", range_of(F.col("p"), points))
    pool = F.udf(_pav, "array<struct<p:double,s:double,n:long>>", useArrow=False)
    first = by.groupBy("range_").agg(pool(F.array_sort(F.collect_list(F.struct("p", "s", "n")))).alias("a"))
    last = first.agg(pool(F.array_sort(F.flatten(F.collect_list("a")))).alias("a")).select(F.explode("a").alias("r"))
    fit = last.select("r.p", (F.col("r.s") / F.col("r.n")).alias("m"), range_of(F.col("r.p"), points).alias("range_"))
    # the value of a score: the last pool that begins at or below it, in its range or carried in from those before
    carried = fit.groupBy("range_").agg(F.max_by("m", "p").alias("end"))
    ranges = df.sparkSession.range(len(points) + 1).select(F.col("id").cast("int").alias("range_"))
    w = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = ranges.join(carried, "range_", "left").select("range_", F.last("end", True).over(w).alias("carried"))
    inside = Window.partitionBy("range_").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = by.select("p", "range_").join(fit, ["p", "range_"], "left").join(F.broadcast(carried), "range_")
    return own.select("p", F.coalesce(F.last("m", True).over(inside), "carried").alias("y_hat"))


def _pav(rows: list) -> list[tuple[float, float, int]]:
    """Pools of rows (first score, sum, count) in order."""
    pools: list[list] = []
    for p, s, n in rows:
        pools.append([p, s, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] > pools[-1][1] * pools[-2][2]:
            _, s2, n2 = pools.pop()
            pools[-1][1] += s2
            pools[-1][2] += n2
    return [tuple(x) for x in pools]


def isotonic_transform(df: DataFrame, fit: DataFrame) -> DataFrame:
    """df with calibrated p: linear between fitted scores, constant outside; fit is one row a distinct score.

    Without a fit, of fewer than four rows or one class, scores stay (see calibrate()). Rows and fitted scores are ordered
    together in each range of scores; the neighbours beyond a range's ends are carried in, a row a range.
    """
    points = cut_points(fit, "p")
    knots = fit.withColumn("range_", range_of(F.col("p"), points))
    ends = knots.groupBy("range_").agg(F.min(F.struct("p", "y_hat")).alias("low"), F.max(F.struct("p", "y_hat")).alias("high"))
    ranges = df.sparkSession.range(len(points) + 1).select(F.col("id").cast("int").alias("range_"))
    w = Window.orderBy("range_")
    near = ranges.join(ends, "range_", "left").select(
        "range_",
        F.last("high", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("low", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    rows = df.select(F.col("p"), F.struct(*df.columns).alias("row"), F.lit(None).cast("struct<p:double,y_hat:double>").alias("knot"))
    rows = rows.unionByName(knots.select("p", F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.struct("p", "y_hat").alias("knot")))
    rows = rows.withColumn("range_", range_of(F.col("p"), points)).join(F.broadcast(near), "range_")
    by = Window.partitionBy("range_").orderBy("p")
    low = F.coalesce(F.last("knot", True).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "before")
    high = F.coalesce(F.first("knot", True).over(by.rangeBetween(Window.currentRow, Window.unboundedFollowing)), "after")
    out = rows.withColumn("low", low).withColumn("high", high).where("row is not null")
    share = F.coalesce(F.try_divide(F.col("p") - F.col("low.p"), F.col("high.p") - F.col("low.p")), F.lit(0.0))
    value = F.when(F.col("low").isNull(), F.col("high.y_hat")).when(F.col("high").isNull(), F.col("low.y_hat")).otherwise(F.col("low.y_hat") + share * (F.col("high.y_hat") - F.col("low.y_hat")))
    return out.select("row.*", value.alias("calibrated"))


def fittable(df: DataFrame) -> bool:
    """Whether a calibrator can be fitted: four rows, both classes."""
    r = finite(df).agg(F.count("*").alias("n"), F.countDistinct("y").alias("classes")).first()
    return r.n >= 4 and r.classes > 1


def calibrate(df: DataFrame, calibration: DataFrame, kind: str = "auto", enough: int = 1000) -> DataFrame:
    """df (p) with calibrated: isotonic from enough calibration rows on, else Platt's sigmoid, or as kind says; p itself where nothing can be fitted."""
    from meridia.operators.learning import platt

    if not fittable(calibration):
        return df.withColumn("calibrated", F.col("p"))
    if kind == "auto":
        kind = "isotonic" if finite(calibration).count() >= enough else "platt"
    if kind == "isotonic":
        return isotonic_transform(df, isotonic(calibration))
    a, b = platt(calibration)
    return df.withColumn("calibrated", 1 / (1 + F.exp(-(F.lit(a) * F.col("p") + b))))
