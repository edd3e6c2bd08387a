"""Row filters and keyed corrections."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.operators.joins import attach


def keep_or_unknown(df: DataFrame, cond: Column) -> DataFrame:
    """Keep rows where the condition holds or cannot be decided."""
    return df.where(cond | cond.isNull())


def drop_value(df: DataFrame, column: str, value) -> DataFrame:
    """Drop rows with the given value. Rows without a value go as well."""
    return df.where(F.col(column) != F.lit(value))


def subset_counts(df: DataFrame, cond: Column) -> DataFrame:
    """How many rows a predicate keeps, drops and cannot decide."""
    return df.agg(
        F.count_if(cond).alias("n_kept"),
        F.count_if(~cond).alias("n_dropped"),
        F.count_if(cond.isNull()).alias("n_unknown"),
    )


def correct_cell(df: DataFrame, column: str, key: str, fixes: Mapping, also: Column | None = None) -> DataFrame:
    """Point fixes from a small literal map ``key value -> right value``.

    ``also`` narrows the fix, for instance to one visit.
    """
    out = F.col(column)
    for k, v in fixes.items():
        hit = F.col(key) == F.lit(k)
        out = F.when(hit if also is None else hit & also, F.lit(v)).otherwise(out)
    return df.withColumn(column, out)


def correct_from_table(df: DataFrame, column: str, corrections: DataFrame, keys: Iterable[str], new: str) -> DataFrame:
    """Fixes from a corrections table, unique by ``keys``."""
    fixed = attach(df, corrections.select(*keys, F.col(new).alias("__fix")), keys)
    return fixed.withColumn(column, F.coalesce(F.col("__fix"), F.col(column))).drop("__fix")


def remap_key(df: DataFrame, key: str, mapping: Mapping) -> DataFrame:
    """Move the rows of a mislabelled key to the right one."""
    return correct_cell(df, key, key, mapping)


def remap_from_table(df: DataFrame, key: str, remaps: DataFrame, old: str, new: str) -> DataFrame:
    """Same, with the pairs in a table that is unique by ``old``."""
    return correct_from_table(df, key, remaps.withColumnRenamed(old, key), [key], new)
