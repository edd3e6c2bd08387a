"""Contingency tests, many at a time.

The heavy part is one ``groupBy(test, row, col).count()``. Everything after it
works on cells: at most rows x columns of them per test.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.tails import chi2_sf
from panelwise.operators.exact import Rx2, tests_2x2
from panelwise.operators.joins import attach
from panelwise.session import ensure_checkpoint_dir


class Pair(NamedTuple):
    test: str
    row: Column
    col: Column
    keep: Column | None = None


def contingency_counts(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """Cells of many row x column tables over complete pairs: one scan, one shuffle."""
    cells = []
    for p in pairs:
        cell = F.struct(
            F.lit(p.test).alias("test"), p.row.cast("string").alias("row"), p.col.cast("string").alias("col")
        )
        keep = p.row.isNotNull() & p.col.isNotNull()
        cells.append(F.when(keep if p.keep is None else keep & p.keep, cell))
    rows = df.select(F.explode(F.array(*cells)).alias("c")).where("c IS NOT NULL").select("c.*")
    return rows.groupBy("test", "row", "col").agg(F.count(F.lit(1)).alias("n"))


def keyed_counts(df: DataFrame, test: str, row: str, col: str) -> DataFrame:
    """Cells of one table per key, for instance one per site."""
    rows = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    return rows.groupBy(
        F.col(test).alias("test"), F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col")
    ).agg(F.count(F.lit(1)).alias("n"))


def chisq_test(cells: DataFrame, correct: bool = True) -> DataFrame:
    """Pearson statistic per test, with the continuity correction on 2 x 2 tables.

    Row, column and total sums are aggregates joined back, so a test with very many levels is spread.
    """
    n = F.col("n").cast("double")
    one = F.count(F.lit(1))
    cols = cells.groupBy("test", "col").agg(F.sum(n).alias("k"), one.alias("in_col"))
    rows = cells.groupBy("test", "row").agg(F.sum(n).alias("r"), one.alias("in_row"))
    rows = attach(rows, rows.groupBy("test").agg(F.sum("r").alias("t")), ["test"])
    c = attach(attach(cells, rows, ["test", "row"]), cols, ["test", "col"]).withColumn("e", F.col("r") * F.col("k") / F.col("t"))
    per = c.groupBy("test").agg(
        # The cells of a row add up to one, so this counts rows, and likewise columns.
        F.round(F.sum(1 / F.col("in_row"))).alias("n_row"),
        F.round(F.sum(1 / F.col("in_col"))).alias("n_col"),
        one.alias("n_cell"),
        F.max("t").alias("t"),
        F.sum(F.pow(n - F.col("e"), 2) / F.col("e")).alias("s"),
        F.sum("e").alias("se"),
        F.max(F.abs(n - F.col("e"))).alias("d"),
        F.max("r").alias("r"),
        F.max("k").alias("k"),
    )
    # Empty cells have no row here; each of them would add its expected count.
    full = F.col("s") + F.when(F.col("n_cell") < F.col("n_row") * F.col("n_col"), F.col("t") - F.col("se")).otherwise(0.0)
    d = F.greatest(F.col("d") - (0.5 if correct else 0.0), F.lit(0.0))
    t, r, k = F.col("t"), F.col("r"), F.col("k")
    two = F.pow(d, 2) * F.pow(t, 3) / (r * (t - r) * k * (t - k))
    is_two = (F.col("n_row") == 2) & (F.col("n_col") == 2)
    testable = (F.col("n_row") > 1) & (F.col("n_col") > 1)
    out = per.select(
        "test",
        F.when(testable, F.when(is_two, two).otherwise(full)).alias("statistic"),
        F.when(testable, ((F.col("n_row") - 1) * (F.col("n_col") - 1)).cast("int")).alias("df"),
        F.col("t").cast("bigint").alias("n"),
    )
    return out.withColumn("p_value", chi2_sf(F.col("statistic"), F.col("df")))


def fisher_exact_2x2(a: int, b: int, c: int, d: int) -> dict:
    """Exact 2 x 2 test of one table: two-sided p, conditional odds ratio and its interval."""
    p, odds, low, high = (float(v[0]) for v in tests_2x2([a], [b], [c], [d]))
    return {"p_value": p, "odds_ratio": None if np.isnan(odds) else odds, "ci_lower": low, "ci_upper": high}


FISHER_2X2 = "p_value double, odds_ratio double, ci_lower double, ci_upper double"


def _is(column: str, value: str) -> Column:
    return F.col(column) == F.col(value)


def _count(which: Column) -> Column:
    return F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("bigint")


def fisher_2x2(cells: DataFrame) -> DataFrame:
    """Exact test for every 2 x 2 table in the frame; other tests get a note.

    The four cells are conditional sums by the least and the greatest label, so a test of very many labels is
    never gathered. A batch of tests is solved at once.
    """
    ends = cells.groupBy("test").agg(
        F.min("row").alias("row_0"), F.max("row").alias("row_1"), F.min("col").alias("col_0"), F.max("col").alias("col_1")
    )
    other = ~((_is("row", "row_0") | _is("row", "row_1")) & (_is("col", "col_0") | _is("col", "col_1")))
    cell = {f"c{i}{j}": _count(_is("row", f"row_{i}") & _is("col", f"col_{j}")) for i in (0, 1) for j in (0, 1)}
    tables = attach(cells, ends, ["test"]).groupBy("test").agg(
        F.sum("n").cast("bigint").alias("n"),
        *[c.alias(name) for name, c in cell.items()],
        F.max(other | _is("row_0", "row_1") | _is("col_0", "col_1")).alias("odd"),
    )

    @F.pandas_udf(FISHER_2X2)
    def run(odd: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        fine = ~odd.to_numpy(bool)
        out = {}
        for name, values in zip(("p_value", "odds_ratio", "ci_lower", "ci_upper"), tests_2x2(*(v[fine] for v in (a, b, c, d)))):
            column = np.full(len(odd), None, object)
            column[fine] = [None if np.isnan(v) else float(v) for v in values]
            out[name] = column
        return pd.DataFrame(out)

    # Few bytes a row, but each costs arithmetic: a given number of partitions is not merged into fewer.
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    solved = tables.repartition(parts, "test").select("test", "n", run("odd", *cell).alias("r"), F.when(F.col("odd"), "not a 2x2 table").alias("note"))
    return solved.select("test", "n", "r.*", "note")


#: States of one test that a task keeps; beyond it they become rows, are merged by an aggregation and dealt to tasks.
STATES = 1 << 14
#: States that a row of work takes along.
STATES_OF_WORK = 1 << 11

PARTIAL = "test string, layer int, total bigint, weight double, many double, low double"


def _convolved(tables: Rx2, pending: dict[int, list[tuple]], limit: int) -> list[tuple[int, tuple[np.ndarray, ...]]]:
    """Carry states (by row of the table) on until they are counted; those of tables with more than `limit` are handed back."""
    handed = []
    while pending:
        layer = min(pending)
        states = tuple(np.concatenate(x) for x in zip(*pending.pop(layer), strict=True))
        last = tables.rows[states[0]] - 2 == layer
        tables.finish(*(x[last] for x in states))
        states = tuple(x[~last] for x in states)
        if not len(states[0]):
            continue
        kept, counts = [], np.zeros(len(tables.rows), np.int64)
        for chunk in tables.expand(layer, *states):
            last = tables.rows[chunk[0]] - 2 == layer + 1
            tables.finish(*(x[last] for x in chunk))
            chunk = tuple(x[~last] for x in chunk)
            counts += np.bincount(chunk[0].astype(np.int64), minlength=len(counts))
            kept.append(chunk)
            if counts.sum() > limit:
                large = counts > limit
                for i, held in enumerate(kept):
                    away = large[held[0]]
                    if away.any():
                        handed.append((layer + 1, tuple(x[away] for x in held)))
                        kept[i] = tuple(x[~away] for x in held)
        from_all = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
        if len(from_all[0]):
            pending.setdefault(layer + 1, []).append(from_all)
    return handed


def fisher_exact_rx2(counts: np.ndarray) -> float:
    """Exact two-sided p of an r x 2 table."""
    counts = np.asarray(counts)
    table = Rx2([counts.sum(axis=1)], [counts[:, 0]])
    _convolved(table, {0: [table.start()]}, np.iinfo(np.int64).max)
    return min(1.0, float(table.low[0]))


def _column(batch: pa.RecordBatch, name: str, field: str) -> list[np.ndarray]:
    """A field of an array of structs: one numpy array for each row."""
    column = batch.column(name)
    flat = column.flatten()
    values = flat.field(flat.type.get_field_index(field)).to_numpy(zero_copy_only=False)
    return np.split(values, np.cumsum(column.value_lengths().to_numpy())[:-1])


def _advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        tables = Rx2(_column(batch, "rows", "size"), _column(batch, "rows", "seen"))
        tests, layers = batch.column("test"), batch.column("layer").to_numpy()
        total, weight, many = (_column(batch, "states", f) for f in ("total", "weight", "many"))
        pending: dict[int, list[tuple]] = {}
        tables.low[tables.rows < 2] = 1.0
        for i in np.flatnonzero(tables.rows >= 2):
            pending.setdefault(int(layers[i]), []).append((np.full(len(total[i]), i), total[i].astype(float), weight[i], many[i]))
        handed = _convolved(tables, pending, STATES)
        names = ["test", "layer", "total", "weight", "many", "low"]
        for layer, (t, total_, weight_, many_) in handed:
            yield pa.RecordBatch.from_arrays([
                tests.take(pa.array(t)), pa.array(np.full(len(t), layer), pa.int32()), pa.array(total_.astype(np.int64)), pa.array(weight_), pa.array(many_),
                pa.nulls(len(t), pa.float64()),
            ], names)
        none = [pa.nulls(batch.num_rows, k) for k in (pa.int32(), pa.int64(), pa.float64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([tests, *none, pa.array(tables.low)], names)


def _r_by_2(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(test, n, columns) of all tests; (test, rows) of those with two columns: sizes and first cells of their rows."""
    by_col = cells.groupBy("test", "col").agg(F.sum("n").cast("bigint").alias("n"))
    tests = by_col.groupBy("test").agg(F.sum("n").alias("n"), F.count("*").alias("columns"), F.min("col").alias("col_0"))
    two = cells.join(tests.where("columns = 2").select("test", "col_0"), "test")
    rows = two.groupBy("test", "row").agg(F.sum("n").cast("bigint").alias("size"), _count(_is("col", "col_0")).alias("seen"))
    return tests.select("test", "n", "columns"), rows.groupBy("test").agg(F.collect_list(F.struct("size", "seen")).alias("rows"))


def fisher_rx2(cells: DataFrame) -> DataFrame:
    """Exact test for every r x 2 table.

    A test's partial tables are convolved row by row (`exact.Rx2`). Small tests end in the task that begins them. Of a large
    one the partial tables become rows (test, running total, log weight, multiplicity); an aggregation merges those that
    agree, whatever task they come from, and they are dealt to tasks again, until none is left. Tables without two
    columns get a note.
    """
    spark = cells.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tests, tables = _r_by_2(cells)
    first = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("many"))
    # Test keys of any type travel as text.
    tables = tables.select(F.col("test").cast("string").alias("test"), "rows")
    work = tables.select("test", "rows", F.lit(0).alias("layer"), F.array(first).alias("states"))
    found = []
    while True:
        found.append(work.repartition(parts).mapInArrow(_advanced, PARTIAL).checkpoint())
        states = found[-1].where("layer IS NOT NULL")
        if states.isEmpty():
            break
        # Weights of equal states differ by rounding only.
        states = states.groupBy("test", "layer", "total", F.round(F.col("weight") * 1e10).alias("w")).agg(F.min("weight").alias("weight"), F.sum("many").alias("many"))
        states = states.checkpoint()
        blocks = states.groupBy("test", "layer").agg(F.ceil(F.count("*") / STATES_OF_WORK).alias("blocks"))
        states = states.join(blocks, ["test", "layer"]).withColumn("block", F.pmod(F.xxhash64("total"), "blocks"))
        work = states.groupBy("test", "layer", "block").agg(F.collect_list(F.struct("total", "weight", "many")).alias("states"))
        work = work.join(tables, "test").select("test", "rows", "layer", "states")
    low = found[0]
    for more in found[1:]:
        low = low.unionByName(more)
    low = low.where("low IS NOT NULL").groupBy(F.col("test").alias("t")).agg(F.least(F.lit(1.0), F.sum("low")).alias("p_value"))
    note = F.when(F.col("columns") != 2, "not two columns").alias("note")
    return tests.join(low, F.col("test").cast("string").eqNullSafe(F.col("t")), "left").select("test", "n", "p_value", note)
