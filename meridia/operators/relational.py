"""Cohort selection, sessionising, slicing and label parsing as column expressions, joins and windows."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The row of each key that comes first by order; combined before the shuffle, unlike a window."""
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")


def item_score(*items: Column) -> Column:
    """Sum of the items that are 0 or 1; unanswered ones count 0."""
    return reduce(add, [F.when(c.isin(0, 1), c).otherwise(0) for c in items])


def strict_mean(*items: Column) -> Column:
    """Mean of the items; null if one is null."""
    return reduce(add, [c.cast("double") for c in items]) / len(items)


def below_population(df: DataFrame, column: str, deviations: float = 2.0) -> DataFrame:
    """Rows whose value lies under mean - deviations * sample standard deviation, with the threshold."""
    limit = df.agg((F.avg(column) - deviations * F.stddev_samp(column)).alias("limit")).scalar()
    return df.withColumn("threshold", limit).where(F.col(column) < F.col("threshold"))


def cohorts(candidates: DataFrame, flagged: list[DataFrame], present: DataFrame, key: str) -> DataFrame:
    """key and cohort: flagged keys that are present are cases, other candidates that are present controls."""
    cases = reduce(DataFrame.union, [f.select(key) for f in flagged]).distinct()
    cases, free = cases.join(present, key, "left_semi"), candidates.select(key).distinct().join(cases, key, "left_anti")
    controls = free.join(present, key, "left_semi")
    return controls.withColumn("cohort", F.lit("control")).unionByName(cases.withColumn("cohort", F.lit("case")))


def sessionize(df: DataFrame, by: str, order: list[str], starts: Column) -> DataFrame:
    """block_id: the number of starts so far in order; rows before the first are block 0."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("block_id", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w))


def block_range(onset: Column, end: Column, tr: Column | float, samples: Column | int) -> tuple[Column, Column]:
    """First sample and end of a block: floor(onset / tr), not under 0, and ceil(end / tr) within the run."""
    return F.greatest(F.floor(onset / tr), F.lit(0)), F.least(F.ceil(end / tr), F.lit(samples) if isinstance(samples, int) else samples)


def slice_blocks(blocks: DataFrame, runs: DataFrame, keys: list[str], tr: float) -> DataFrame:
    """blocks (keys, onset, end, ...) with the part of each run's array x that they cover; empty ones go."""
    joined = blocks.join(runs, keys)
    first, stop = block_range(F.col("onset"), F.col("end"), tr, F.size("x"))
    out = joined.withColumn("first", first.cast("int")).withColumn("stop", stop.cast("int")).where("first < stop")
    return out.withColumn("x", F.expr("slice(x, first + 1, stop - first)"))


def parcel_means(voxels: DataFrame, labels: DataFrame, most: int = 100_000) -> DataFrame:
    """label, t, x: mean value of each label at each time; labels without voxels are 0. labels is an atlas, of at most `most` rows."""
    if labels.limit(most + 1).count() > most:
        raise ValueError(f"an atlas of over {most} labels")
    means = voxels.where("label != 0").groupBy("label", "t").agg(F.avg("value").alias("m"))
    times = voxels.select("t").distinct()
    names = labels.agg(F.collect_list("label").alias("l")).scalar()  # checked above
    grid = times.withColumn("l", names).select("t", F.explode("l").alias("label"))
    return grid.join(means, ["label", "t"], "left").select("label", "t", F.coalesce("m", F.lit(0.0)).alias("x"))


def label_index(voxels: DataFrame) -> DataFrame:
    """Distinct labels but 0 and their row, in order."""
    return voxels.select("label").where("label != 0").distinct().withColumn("row", F.row_number().over(Window.orderBy("label")) - 1)


def roi_select(atlas: DataFrame, regions: list[str] | None = None, networks: list[str] | None = None, hemisphere: str | None = None) -> DataFrame:
    """Atlas rows in any of the regions and any of the networks (None: all), one hemisphere; sorted, once each."""
    out = atlas
    for column, names in (("region", regions), ("network", networks)):
        out = out.where(F.col(column).isin(names)) if names else out
    out = out.where(F.col("hemisphere") == hemisphere) if hemisphere else out
    return out.dropDuplicates(["row_index"]).orderBy("row_index")


def parse_atlas_id(label: Column) -> dict[str, Column]:
    """Parts of a cortical id such as 17networks_LH_LimbicA_OFC_1: hemisphere, network, region, parcel."""
    parts = F.split(label, "_")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    last = F.try_element_at(parts, F.lit(-1))
    return {"hemisphere": at(2), "network": at(3), "region": at(4), "parcel": last.try_cast("int")}


def entities(name: Column) -> Column:
    """Map of the key-value entities of a file name (value: after the first dash)."""
    stem = F.regexp_extract(name, r"^([^.]*)", 1)
    parts = F.filter(F.split(stem, "_"), lambda p: F.instr(p, "-") > 1)
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.substring_index(p, "-", 1).alias("k"), F.regexp_replace(p, "^[^-]*-", "").alias("v"))))


def suffix_and_extension(name: Column) -> tuple[Column, Column]:
    """The part after the last underscore without dashes, and everything from the first dot on."""
    stem = F.regexp_extract(name, r"^([^.]*)", 1)
    last = F.substring_index(stem, "_", -1)
    return F.when(F.instr(last, "-") == 0, last), F.regexp_extract(name, r"^[^.]*(\..*)$", 1)


def keep_entities(mapping: Column, keys: list[str]) -> Column:
    """Entities of the given keys, in that order, as a stem."""
    parts = [F.when(F.map_contains_key(mapping, k), F.concat(F.lit(f"{k}-"), F.try_element_at(mapping, F.lit(k)))) for k in keys]
    return F.concat_ws("_", *parts)


def canonical_subject(value: Column) -> Column:
    """One spelling of a subject id: sub-X, NDAR_X and X agree."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), "^sub-", ""), "^NDAR_", "NDAR")


def group_key(subject: Column, leaf: Column, roi: Column) -> Column:
    """subject[_leaf]_roiNNN."""
    return F.concat_ws("_", subject, leaf, F.format_string("roi%03d", roi))


def parse_group_key(key: Column) -> tuple[Column, Column]:
    """Subject and roi of a group key."""
    roi = F.regexp_extract(key, r"_roi(\d+)$", 1)
    return F.substring_index(key, "_", 1), F.when(roi != "", roi).try_cast("int")


def any_answered(*items: Column) -> Column:
    """Whether some item is not null."""
    return reduce(lambda a, b: a | b, [c.isNotNull() for c in items])


def spelt(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with each right name from a misspelt column; names that are right already stay."""
    return df.withColumns({right: F.col(wrong) for right, wrong in names.items() if right not in df.columns and wrong in df.columns})


Pattern = tuple[str, str | None]


def matches(patterns: list[Pattern], contains: bool = False) -> Column:
    """The first pattern (name, hemisphere or None: any) that a row's region equals or contains; null where none does."""
    hit = lambda name, side: (F.contains("region", F.lit(name)) if contains else F.col("region") == name) & (F.lit(side is None) | F.col("hemisphere").eqNullSafe(F.lit(side)))
    return F.coalesce(F.lit(None).cast("string"), *[F.when(hit(n, s), n) for n, s in patterns])


def selected_rois(atlas: DataFrame, regions: list[Pattern] = (), networks: list[Pattern] = (), subcortical: list[Pattern] = ()) -> DataFrame:
    """Rows of the selection, once each by row_index: atlas has row_index, kind, region, network, hemisphere.

    A cortical row has to match both lists, an empty one of which matches all; with both empty no cortical row is meant.
    A subcortical row has to contain a pattern. matched: the region, or the pattern contained.
    """
    cortical = F.lit(bool(regions or networks)) & (F.col("kind") == "cortical")
    if regions:
        cortical &= matches(regions).isNotNull()
    if networks:
        cortical &= reduce(lambda a, b: a | b, [(F.col("network") == n) & (F.lit(s is None) | F.col("hemisphere").eqNullSafe(F.lit(s))) for n, s in networks])
    inner = F.when(F.col("kind") == "subcortical", matches(subcortical, contains=True))
    out = atlas.withColumn("matched", F.when(cortical, F.col("region")).otherwise(inner)).where("matched is not null")
    return out.dropDuplicates(["row_index"])


def find_rois(atlas: DataFrame, rows: list[int] | None = None, ids: list[str] | None = None, networks: list[str] | None = None, regions: list[str] | None = None) -> DataFrame:
    """Atlas rows by any mix of row numbers, ids, networks and regions (None: all)."""
    for column, values in (("row_index", rows), ("id", ids), ("network", networks), ("region", regions)):
        atlas = atlas if values is None else atlas.where(F.col(column).isin(values))
    return atlas


def checked_rows(selection: DataFrame, available: int) -> DataFrame:
    """selection; the job fails on a row_index outside 0 .. available - 1, at the row itself."""
    fail = F.raise_error(F.concat(F.lit("row "), F.col("row_index").cast("string"), F.lit(f" of {available}")))
    return selection.withColumn("row_index", F.when((F.col("row_index") >= 0) & (F.col("row_index") < available), F.col("row_index")).otherwise(fail.cast(selection.schema["row_index"].dataType)))


def concat_channels(cortical: DataFrame, subcortical: DataFrame, n_cortical: int) -> DataFrame:
    """Both sets of series, the second numbered on from n_cortical."""
    return cortical.unionByName(subcortical.withColumn("channel", (F.col("channel") + n_cortical).cast(cortical.schema["channel"].dataType)))


def labelled(features: DataFrame, cohort: DataFrame, labels: dict[str, int]) -> DataFrame:
    """features with y of their subject's cohort; subjects without one, or with a cohort that has no label, go.

    A subject that stands more than once in cohort (subject, file, cohort) has the cohort of its first file.
    """
    first = one_per_key(cohort, "subject", ["file"], ["cohort"])
    y = F.coalesce(F.lit(None).cast("int"), *[F.when(F.col("cohort") == k, v) for k, v in labels.items()])
    return features.join(first.select("subject", y.alias("y")).where("y is not null"), "subject")


def roi_rows(features: DataFrame, per_leaf: bool = False) -> DataFrame:
    """Rows of a classification: group, subject, leaf, y, v with 0 for values that are not finite, and how many those were.

    features: subject, leaf (null: none), roi, y, v (array). per_leaf: each leaf is a data set of its own, so the
    group does not name it.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    group = group_key(F.col("subject").cast("string"), F.lit(None).cast("string") if per_leaf else F.col("leaf"), F.col("roi"))
    scrubbed = F.size(F.filter("v", bad))
    return features.select(group.alias("group"), "subject", "leaf", "y", F.transform("v", lambda x: F.when(bad(x), 0.0).otherwise(x.cast("double"))).alias("v"), scrubbed.alias("scrubbed"))
