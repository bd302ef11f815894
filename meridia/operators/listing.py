"""File listings by the key-value entities of their names: matching, ordering, renaming, pairing, choice of leaves."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.operators.relational import entities, suffix_and_extension


def described(files: DataFrame, name: str = "name") -> DataFrame:
    """files with entities (a map), suffix and extension of each name."""
    suffix, extension = suffix_and_extension(F.col(name))
    return files.select("*", entities(F.col(name)).alias("entities"), suffix.alias("suffix"), extension.alias("extension"))


def value_of(key: str) -> Column:
    """Value of an entity; null where the name lacks it."""
    return F.try_element_at("entities", F.lit(key))


def matching(files: DataFrame, pairs: dict[str, str], suffix: str | None = None, extension: str | None = None) -> DataFrame:
    """Rows of described() with all the pairs, and with the suffix and extension where they are given."""
    wanted = [value_of(k) == v for k, v in pairs.items()]
    wanted += [F.col(c) == v for c, v in (("suffix", suffix), ("extension", extension)) if v is not None]
    return files.where(reduce(and_, wanted)) if wanted else files


def sort_keys(keys: list[str], ranks: dict[str, list[str]] | None = None) -> list[Column]:
    """Sort columns of entities: names that lack one come last; a key with ranks puts those values first, all others alike after them."""
    out = []
    for key in keys:
        value = value_of(key)
        listed = (ranks or {}).get(key)
        if listed:
            place = F.array_position(F.array(*map(F.lit, listed)), value)  # from 1; 0: not listed
            value = F.when(value.isNotNull(), F.when(place > 0, place).otherwise(len(listed) + 1))
        out.append(value.asc_nulls_last())
    return out


def kept(e: Column, keys: list[str]) -> Column:
    """Entities of the keys, in that order; those that are absent are left out."""
    one = lambda key: F.map_filter(e, lambda k, _: k == key)
    return F.map_concat(F.create_map().cast("map<string,string>"), *map(one, keys))


def without(e: Column, keys: list[str]) -> Column:
    return F.map_filter(e, lambda k, _: ~k.isin(keys))


def reordered(e: Column, keys: list[str]) -> Column:
    """The keys first, in that order, then the rest as they stood."""
    return F.map_concat(kept(e, keys), without(e, keys))


def file_name(e: Column, suffix: Column, extension: Column) -> Column:
    """Name of entities in their order; a null suffix or extension is left out."""
    parts = F.transform(F.map_entries(e), lambda p: F.concat(p["key"], F.lit("-"), p["value"]))
    return F.concat(F.concat_ws("_", F.array_join(parts, "_"), suffix), F.coalesce(extension, F.lit("")))


def paired(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("sub", "task", "run")) -> DataFrame:
    """left_name, right_name of described files that agree in the keys; a name that lacks one has no partner."""
    side = lambda df, n: df.select(*[value_of(k).alias(k) for k in keys], F.col("name").alias(n))
    return side(left, "left_name").join(side(right, "right_name"), list(keys))


def leaves(df: DataFrame, kind: str, column: str = "leaf") -> DataFrame:
    """Rows whose leaf is of a kind (chunk, block: kind_...)."""
    return df.where(F.startswith(F.col(column), F.lit(f"{kind}_")))
