"""Running sums over an order of the whole table, without a window that holds it in one task.

The table is cut by value at RANGES quantiles, which are driver-side literals. Sums of the ranges, a row each,
give every range its start; inside a range an ordinary window goes on from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def cut_points(df: DataFrame, order: str, ranges: int = RANGES) -> list[float]:
    """At most ranges - 1 rising values that split df into parts of about equal size; ties stay together."""
    return sorted(set(df.approxQuantile(order, [k / ranges for k in range(1, ranges)], 0.25 / ranges)))


def range_of(order: Column, points: list[float]) -> Column:
    """Number of the range that holds a value, rising with it."""
    if not points:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, points)), lambda b: b <= order))


def running(df: DataFrame, order: str, sums: list[str], points: list[float], tie: list[str] | None = None, down: bool = True) -> DataFrame:
    """df with range_, and for each of sums c: c_to (the sum up to the row and including it) and c_all (of all rows).

    From the highest value of order down, or up. Ties go by the columns tie; without tie the values must be distinct.
    """
    rows = df.withColumn("range_", range_of(F.col(order), points))
    totals = rows.groupBy("range_").agg(*[F.sum(c).alias(f"{c}_of") for c in sums])  # a row a range
    turn = F.col("range_").desc() if down else F.col("range_")
    before, every = Window.orderBy(turn).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    start = totals.select("range_", *[F.coalesce(F.sum(f"{c}_of").over(before), F.lit(0)).alias(f"{c}_from") for c in sums], *[F.sum(f"{c}_of").over(every).alias(f"{c}_all") for c in sums])
    key = F.col(order).desc() if down else F.col(order)
    inside = Window.partitionBy("range_").orderBy(key, *(tie or [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(F.broadcast(start), "range_")
    return out.withColumns({f"{c}_to": F.col(f"{c}_from") + F.sum(c).over(inside) for c in sums}).drop(*[f"{c}_from" for c in sums])
