"""Wide sheet to visit tables and back.

A sheet holds one row per participant, so everything a visit row needs is already
on that row. ``visits_from_wide`` therefore builds the visit table by exploding
one struct per visit: no shuffle at all. ``unpivot_wide`` and ``pivot_long`` are
the two halves for inputs that really are long.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.nulls import _col

# Fixed patterns of the column-name grammar.
VISIT_PATTERN = ".*_(.*)_.*"
VARIABLE_PATTERN = ".*([0-9]{2})"
LAB_PATTERN = r"^ychromo(.*?)(date)?$"


def unpivot_wide(df: DataFrame, ids: Iterable[str], columns: Iterable[str] | None = None,
                 key: str = "key", value: str = "value") -> DataFrame:
    """Stack columns as text."""
    ids = list(ids)
    cols = list(columns) if columns is not None else [c for c in df.columns if c not in ids]
    text = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols])
    return text.unpivot(ids, cols, key, value)


def unpivot_measures(df: DataFrame, ids: Iterable[str], measures: Iterable[str],
                     key: str = "measure", value: str = "value") -> DataFrame:
    """Stack columns of one type and keep that type."""
    ids, measures = list(ids), list(measures)
    return df.select(*ids, *measures).unpivot(ids, measures, key, value)


def visit_token(key: Column | str) -> Column:
    """Text between the last two underscores; a name without them is left alone."""
    return F.regexp_replace(_col(key), VISIT_PATTERN, "$1")


def variable_name(key: Column | str) -> Column:
    """Name after the last two-digit question number."""
    return F.regexp_replace(_col(key), VARIABLE_PATTERN, "")


def lab_visit(key: Column | str) -> Column:
    return F.regexp_replace(_col(key), LAB_PATTERN, "$1")


def lab_kind(key: Column | str) -> Column:
    return F.when(_col(key).contains("date"), F.lit("date")).otherwise(F.lit("value"))


def strip_prefix(key: Column | str, prefix: str) -> Column:
    return F.regexp_replace(_col(key), re.escape(prefix), "")


def pivot_long(df: DataFrame, keys: Iterable[str], variables: Sequence[str],
               variable: str = "variable", value: str = "value") -> DataFrame:
    """One column per listed variable.

    The list is explicit, so no job is spent on discovering it, and each cell is
    a conditional maximum: one aggregation with map-side combining. Cells that
    occur twice must be ruled out with ``duplicate_cells`` first.
    """
    cells = [F.max(F.when(F.col(variable) == v, F.col(value))).alias(v) for v in variables]
    return df.groupBy(*keys).agg(*cells)


def duplicate_cells(df: DataFrame, keys: Iterable[str], variable: str = "variable") -> DataFrame:
    """Cells that occur more than once; an empty frame means the pivot is exact."""
    return df.groupBy(*keys, variable).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def question_grid(columns: Iterable[str], visit_alias: Mapping[str, str] | None = None) -> dict[str, dict[str, str]]:
    """``visit -> variable -> column`` from column names alone.

    Raises when two columns fall on the same cell, as a pivot would.
    """
    alias = dict(visit_alias or {})
    grid: dict[str, dict[str, str]] = defaultdict(dict)
    clashes = []
    for name in columns:
        visit = re.sub(VISIT_PATTERN, r"\1", name)
        visit = alias.get(visit, visit)
        variable = re.sub(VARIABLE_PATTERN, "", name)
        if variable in grid[visit]:
            clashes.append((visit, variable, grid[visit][variable], name))
        grid[visit][variable] = name
    if clashes:
        raise ValueError(f"columns share a cell: {clashes}")
    return dict(grid)


def lab_grid(columns: Iterable[str]) -> dict[str, dict[str, str]]:
    """``visit -> value/date -> column`` for the laboratory columns."""
    grid: dict[str, dict[str, str]] = defaultdict(dict)
    for name in columns:
        visit = re.sub(LAB_PATTERN, r"\1", name)
        grid[visit]["date" if "date" in name else "value"] = name
    return dict(grid)


def visits_from_wide(df: DataFrame, ids: Iterable[str | Column], grid: Mapping[str, Mapping[str, str | Column]],
                     visit: str = "visit") -> DataFrame:
    """Visit table straight from the wide row: explode one struct per visit.

    Cells are column names or expressions over the wide row.
    """
    variables = sorted({v for cells in grid.values() for v in cells})

    def cell(cells: Mapping[str, str | Column], name: str) -> Column:
        return _col(cells[name]) if name in cells else F.lit(None)

    rows = [
        F.struct(F.lit(token).alias(visit), *[cell(cells, v).cast("string").alias(v) for v in variables])
        for token, cells in grid.items()
    ]
    return df.select(*ids, F.inline(F.array(*rows)))


def presence_columns(columns: Iterable[str], tokens: Iterable[str], stem: str = "VisitDate",
                     form: Mapping[str, str] | None = None) -> dict[str, str]:
    """Visit-date column of each visit, matched on the exact visit token.

    Where several forms carry a date for a visit, ``form`` names the one to use.
    """
    found = {}
    for token in tokens:
        hits = [c for c in columns if stem in c and re.sub(VISIT_PATTERN, r"\1", c) == token]
        want = (form or {}).get(token)
        if want:
            hits = [c for c in hits if c.startswith(want)]
        if len(hits) != 1:
            raise ValueError(f"visit {token}: expected one date column, found {hits}")
        found[token] = hits[0]
    return found


def presence_flags(df: DataFrame, dates: Mapping[str, str], prefix: str = "presence_") -> DataFrame:
    """0/1 column per visit: a visit date is recorded."""
    return df.withColumns({f"{prefix}{t}": F.col(c).isNotNull().cast("int") for t, c in dates.items()})


def presence_long(df: DataFrame, ids: Iterable[str], dates: Mapping[str, str]) -> DataFrame:
    """One row per visit with its 0/1 presence, without a shuffle."""
    rows = [
        F.struct(F.lit(t).alias("visit"), F.col(c).isNotNull().cast("int").alias("presence"))
        for t, c in dates.items()
    ]
    return df.select(*ids, F.inline(F.array(*rows)))
