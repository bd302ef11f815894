"""Per-series statistics as window expressions: standardising, detrending, scaling, Fisher's z."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16
CLIP = 0.9999


def zscore(x: str, by: list[str], sample: bool = True, keep_constant: bool = False) -> Column:
    """(x - mean) / deviation by series; a constant series is centred only, or left alone."""
    w = Window.partitionBy(*by)
    mean, sd = F.avg(x).over(w), (F.stddev_samp(x) if sample else F.stddev_pop(x)).over(w)
    flat = F.coalesce(sd, F.lit(0.0)) < EPS
    return F.when(flat, F.col(x) if keep_constant else F.col(x) - mean).otherwise((F.col(x) - mean) / F.when(~flat, sd))


def percent_change(x: str, by: list[str]) -> Column:
    """(x - mean) / |mean| * 100 by series; 0 where the mean is 0."""
    mean = F.avg(x).over(Window.partitionBy(*by))
    return F.when(F.abs(mean) < EPS, 0.0).otherwise((F.col(x) - mean) / F.when(F.abs(mean) >= EPS, F.abs(mean)) * 100)


def detrended(x: str, t: str, by: list[str]) -> Column:
    """Residuals of a line fitted to x over t, by series."""
    w = Window.partitionBy(*by)
    n, mx, mt = F.count(x).over(w), F.avg(x).over(w), F.avg(t).over(w)
    cov = F.sum(F.col(x) * F.col(t)).over(w) - n * mx * mt
    var = F.sum(F.col(t).cast("double") * F.col(t)).over(w) - n * mt * mt
    return F.col(x) - mx - F.coalesce(F.try_divide(cov, var), F.lit(0.0)) * (F.col(t) - mt)


def minmax(x: str, by: list[str]) -> Column:
    """(x - min) / (max - min + 1e-8) by series."""
    w = Window.partitionBy(*by)
    low = F.min(x).over(w)
    return (F.col(x) - low) / (F.max(x).over(w) - low + 1e-8)


def scrub(x: Column) -> Column:
    """Non-finite values as 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def pearson(n: Column, sa: Column, sb: Column, sab: Column, saa: Column, sbb: Column) -> Column:
    """Correlation from sums, population moments; null where a side is constant."""
    va, vb = saa / n - sa / n * sa / n, sbb / n - sb / n * sb / n
    small = lambda v, s: v <= 1e-12 * (s / n)  # noqa: E731  cancellation leaves such residues of a constant
    return F.when(small(va, saa) | small(vb, sbb), F.lit(None)).otherwise(F.try_divide(sab / n - sa / n * sb / n, F.sqrt(F.abs(va * vb))))


def fisher_z(r: Column) -> Column:
    """atanh of r clipped to +-CLIP; null and NaN stay (least and greatest would pass over a null)."""
    return F.when(r.isNull() | F.isnan(r), r).otherwise(F.atanh(F.greatest(F.least(r, F.lit(CLIP)), F.lit(-CLIP))))
