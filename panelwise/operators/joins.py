"""Joins on participant and visit keys.

Joins of tables carry no broadcast hint. Spark broadcasts a side only when its
measured size is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
shuffles both sides; adaptive execution then splits partitions of hot keys.
Only summaries whose rows were counted are broadcast on purpose. A table read
from files is measured by its compressed bytes, which are a small part of the
rows' size, so a side with rows per participant is kept from being broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(left: DataFrame, right: DataFrame, on: Iterable[str], null_safe: bool = True, grows: bool = False) -> DataFrame:
    """Left join in which a missing key matches a missing key.

    The right side must not repeat a key if row counts are to be kept. Its
    non-key columns must be new names. With ``grows`` the right side has rows per
    participant and never goes through the driver.
    """
    keys = list(on)
    if not null_safe:
        return left.join(right.hint("merge") if grows else right, keys, "left")
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    renamed = renamed.hint("merge") if grows else renamed
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, cond, "left").drop(*[f"__r_{k}" for k in keys])


def checked_small(df: DataFrame, cap: int = 50_000) -> DataFrame:
    """Materialise a summary; mark it for broadcasting if it has at most ``cap`` rows.

    The row count is known before the mark is set. A longer frame comes back
    unchanged and is joined by shuffling.
    """
    rows = df.limit(cap + 1).collect()
    if len(rows) > cap:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def keep_ids(df: DataFrame, ids: DataFrame, column: str, ids_column: str | None = None) -> DataFrame:
    """Rows whose id occurs in the list."""
    keys = ids.select(F.col(ids_column or column).alias("__id"))
    return df.join(keys, df[column] == keys["__id"], "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, column: str, ids_column: str | None = None) -> DataFrame:
    """Rows whose id does not occur in the list; rows without an id stay."""
    keys = ids.select(F.col(ids_column or column).alias("__id")).where("__id IS NOT NULL")
    return df.join(keys, df[column] == keys["__id"], "left_anti")


def ids_only_in(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct ids of ``a`` that ``b`` lacks."""
    return drop_ids(a.select(column).distinct(), b.select(column), column)
