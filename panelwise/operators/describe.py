"""Counts, shares, quantiles and the descriptive tables built from them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.nulls import _col, any_true, ind, mean_na, ratio, sum_na
from panelwise.operators.joins import attach
from panelwise.session import written


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def count_distinct(df: DataFrame, column: str, name: str = "n_distinct") -> DataFrame:
    """Distinct values with a missing value counted as one value."""
    per = df.select(column).distinct()
    return per.agg(F.count("*").alias(name))


def with_share(grouped: DataFrame, n: str = "n", name: str = "pct") -> DataFrame:
    """Share of the whole of an already grouped frame.

    The total is a scalar subquery over the grouped rows, not a window without
    partitions, so a long grouped frame is never pulled into one task.
    """
    total = grouped.agg(F.sum(n)).scalar()
    return grouped.withColumn(name, ratio(F.col(n), total))


def freq(df: DataFrame, column: str, levels: Sequence | None = None, include_na: bool = False) -> DataFrame:
    """One-way table. With ``levels``, unused levels appear with a zero count."""
    rows = df if include_na else df.where(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    if levels is None:
        return counts
    wanted = list(levels) + ([None] if include_na else [])
    dtype = df.schema[column].dataType.simpleString()
    base = df.sparkSession.createDataFrame([(v,) for v in wanted], f"`{column}` {dtype}")
    return attach(base, counts, [column]).withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def freq_pct(df: DataFrame, column: str, levels: Sequence | None = None, include_na: bool = False) -> DataFrame:
    """One-way table with both denominators: all rows and rows with a value."""
    counts = freq(df, column, levels, include_na=True)
    known = counts.where(F.col(column).isNotNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    total = counts.agg(F.sum("n")).scalar()
    out = counts.withColumns({
        "pct_all": ratio(F.col("n"), total),
        "pct_known": F.when(F.col(column).isNotNull(), ratio(F.col("n"), known)),
    })
    return out if include_na else out.where(F.col(column).isNotNull())


def freq_filtered(df: DataFrame, column: str, cond: Column, na_rows: str = "drop") -> DataFrame:
    """One-way table below a predicate.

    ``na_rows="count"`` adds the rows whose predicate is unknown to the missing
    bucket; they never contribute their own value.
    """
    if na_rows == "count":
        rows = df.where(cond | cond.isNull()).withColumn(column, F.when(cond, F.col(column)))
    else:
        rows = df.where(cond)
    return freq(rows, column, include_na=True)


def freq_2way(df: DataFrame, a: str, b: str, include_na: bool = False) -> DataFrame:
    """Two-way table in long form."""
    rows = df if include_na else df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def group_share(df: DataFrame, column: str, known_only: bool = False) -> DataFrame:
    """Count and share per group; the missing group can be removed after counting."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    if known_only:
        counts = counts.where(F.col(column).isNotNull())
    return with_share(counts)


def share_within(counts: DataFrame, first: Iterable[str], n: str = "n", name: str = "pct") -> DataFrame:
    """Share inside a key of which grouped rows hold few each, such as the outcomes of a level."""
    w = Window.partitionBy(*list(first))
    return counts.withColumn(name, ratio(F.col(n), F.sum(n).over(w)))


def share_of_key(counts: DataFrame, first: Iterable[str], n: str = "n", name: str = "pct") -> DataFrame:
    """Share inside the first key of grouped rows, however many levels it has.

    The total is an aggregate that is joined back, so no key's levels meet in one task.
    """
    keys = list(first)
    total = counts.groupBy(*keys).agg(F.sum(n).alias("__total"))
    return attach(counts, total, keys).withColumn(name, ratio(F.col(n), F.col("__total"))).drop("__total")


def group_share_within(df: DataFrame, first: str, second: str, known_only: bool = False) -> DataFrame:
    """Row percentages: the denominator is the first key."""
    counts = df.groupBy(first, second).agg(F.count("*").alias("n"))
    if known_only:
        counts = counts.where(F.col(second).isNotNull())
    return share_of_key(counts, [first])


def level_rates(df: DataFrame, predictors: Mapping[str, Column], outcome: str,
                masks: Mapping[str, Column] | None = None) -> DataFrame:
    """Positives, rows and rate per level of every predictor, in one shuffle."""
    rows = stack_levels(df, [Item(k, c, (masks or {}).get(k)) for k, c in predictors.items()], [outcome])
    return rows.groupBy("variable", "level").agg(
        sum_na(F.col(outcome)).alias("num_pos"), F.count("*").alias("n")
    ).withColumn("pct", ratio(F.col("num_pos"), F.col("n")))


def group_pos_neg(df: DataFrame, by: str, value: str, positive, negative) -> DataFrame:
    v = F.col(value)
    return df.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(v == positive).alias("num_pos"),
        F.count_if(v == negative).alias("num_neg"),
    ).withColumn("pct_pos", ratio(F.col("num_pos"), F.col("n")))


def collapse_any(df: DataFrame, key: str, flags: Mapping[str, Column], na_rm: bool = False) -> DataFrame:
    """Any-of per participant, one column per condition."""
    return df.groupBy(key).agg(*[any_true(c, na_rm).alias(name) for name, c in flags.items()])


def any_totals(df: DataFrame, key: str, tests: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Participants ever positive and ever tested, per test column."""
    flags = {}
    for name, (column, positive) in tests.items():
        flags[f"pos_{name}"] = F.col(column) == positive
        flags[f"tested_{name}"] = F.col(column).isNotNull()
    per = collapse_any(df, key, flags, na_rm=True)
    return per.agg(*[F.sum(ind(F.col(f))).alias(f) for f in flags])


def overall_rate(df: DataFrame, cond: Column, na_rm: bool = False) -> DataFrame:
    flag = ind(cond)
    return df.agg(
        sum_na(flag, na_rm).alias("num_positive"),
        mean_na(flag, na_rm).alias("pct"),
        F.count("*").alias("n"),
    )


def ever_positive(df: DataFrame, key: str, value: str, positive) -> DataFrame:
    """Share of participants with any positive result."""
    per = collapse_any(df, key, {"has_positive": F.col(value) == positive})
    return overall_rate(per, F.col("has_positive"))


def availability(df: DataFrame, by: str, tests: Mapping[str, str], joint: tuple[str, str] | None,
                 denominator: int | Column) -> DataFrame:
    """Known results per visit for several tests and for a pair of them."""
    den = F.lit(denominator) if isinstance(denominator, int) else denominator
    aggs = [F.count(c).alias(f"n_{name}") for name, c in tests.items()]
    names = list(tests)
    if joint:
        a, b = (F.col(tests[j]) for j in joint)
        aggs.append(F.count_if(a.isNotNull() & b.isNotNull()).alias("n_both"))
        names.append("both")
    out = df.groupBy(by).agg(*aggs)
    return out.withColumns({f"pct_{x}": ratio(F.col(f"n_{x}"), den) for x in names})


def presence_summary(df: DataFrame, by: str, flag: str = "presence", na_rm: bool = False) -> DataFrame:
    p = F.col(flag)
    return df.groupBy(by).agg(
        sum_na(p, na_rm).alias("present"),
        sum_na(1 - p, na_rm).alias("absent"),
        F.count("*").alias("total"),
        mean_na(p, na_rm).alias("pct_present"),
        mean_na(1 - p, na_rm).alias("pct_absent"),
    )


def all_missing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Number of rows on which every listed column is missing."""
    empty = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])
    return df.agg(F.count_if(empty).alias("n_all_missing"))


def moments(df: DataFrame, by: Iterable[str], value: str) -> DataFrame:
    """Mean, standard deviation and rows per group; ``n`` counts missing values too."""
    x = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.count("*").alias("n"),
        F.count(x).alias("n_known"),
    )


def group_moments(df: DataFrame, by: Iterable[str], value: str) -> DataFrame:
    """Mean, median, standard deviation, rows per group."""
    by = list(by)
    median = exact_quantiles(df, value, [0.5], by).withColumnRenamed("q50", "median")
    return attach(moments(df, by, value), median, by)


def numeric_summary(df: DataFrame, value: str) -> DataFrame:
    x = F.col(value).cast("double")
    return df.agg(
        F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_missing"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
    )


def _quantile_name(p: float) -> str:
    return "q" + f"{p * 100:g}".replace(".", "_")


def order_bits(x: Column) -> Column:
    """The ordered bits of a double as a long: exponent and mantissa of its size, with its sign. Both zeros are 0.

    Powers of two are exact, and so is dividing by them, so no bit is lost. x must not be NaN.
    """
    size = F.abs(x)
    normal = (size >= 2.0**-1022) & (size < float("inf"))
    safe = F.when(normal, size).otherwise(1.0)
    guess = F.floor(F.log2(safe)).cast("double")
    # The logarithm may be off by one next to a power of two.
    power = F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(safe < power, -1).when(safe / power >= 2, 1).otherwise(0)
    mantissa = (safe / F.pow(F.lit(2.0), exponent) - 1) * 2.0**52
    bits = (exponent + 1023).cast("bigint") * F.lit(2**52) + mantissa.cast("bigint")
    small = (F.when(size < 2.0**-1022, size).otherwise(0.0) * 2.0**537 * 2.0**537).cast("bigint")
    bits = F.when(normal, bits).when(size < 1, small).otherwise(F.lit(2047 * 2**52))
    return F.when(x < 0, -bits).otherwise(bits)


#: Bits left out by each round of the selection.
ROUNDS = (48, 32, 16, 0)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Iterable[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics, by radix selection.

    Rows are counted by the top 16 bits of their ordered bits, the bins that hold a wanted order statistic are kept, and
    their rows are counted by the next 16 bits, until each such bin holds one value: four rounds at most, two or three for
    most data. Values are never sorted or gathered; what is ordered are at most 65,536 counts of a bin. Each round is
    one job, run when the operator is called, and leaves a few rows a group.
    """
    by = list(by)
    x = F.col("__x")
    data = df.select(*by, F.col(value).cast("double").alias("__x")).where(x.isNotNull() & ~F.isnan(x)).withColumn("__key", order_bits(x))
    one = F.col("__one")
    wanted = [(F.col("__n") - 1) * F.lit(float(p)) for p in probs]
    done: list[DataFrame] = []
    rows = data.withColumns({"__p": F.lit(0).cast("bigint"), "__before": F.lit(0).cast("bigint"), "__n": F.lit(None).cast("bigint")})
    for left_out in ROUNDS:
        fixed = [*by, "__p", "__before", "__n"]
        bins = rows.groupBy(*fixed, F.shiftright("__key", left_out).alias("__q")).agg(F.count("*").alias("__c"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
        inside = Window.partitionBy(*by, "__p")
        earlier = F.sum("__c").over(inside.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumns({"__start": F.col("__before") + F.coalesce(earlier, F.lit(0)), "__n": F.coalesce("__n", F.sum("__c").over(inside))})
        needed = F.lit(False)
        for h in wanted:
            for k in (F.floor(h), F.ceil(h)):
                needed = needed | ((k >= F.col("__start")) & (k < F.col("__start") + F.col("__c")))
        bins = bins.where(needed).select(*by, F.col("__q").alias("__p"), F.col("__start").alias("__before"), "__n", "__c", "__lo", "__hi", (F.col("__lo") == F.col("__hi")).alias("__one"))
        bins = written(bins, "quantiles")
        done.append(bins.where(one))
        if left_out == 0 or bins.where(~one).isEmpty():
            break
        rows = _match(data.withColumn("__p", F.shiftright("__key", left_out)), bins.where(~one).drop("__c", "__lo", "__hi", "__one"), [*by, "__p"])
    cells = reduce(DataFrame.unionByName, done)

    def at(k: Column) -> Column:
        return F.max(F.when((k >= F.col("__before")) & (k < F.col("__before") + F.col("__c")), F.col("__lo")))

    aggs = []
    for p, h in zip(probs, wanted):
        frac = F.max(h - F.floor(h))
        lo, hi = at(F.floor(h)), at(F.ceil(h))
        # Equal ends are taken as they are, so that infinities stay.
        aggs.append(F.when(lo == hi, lo).otherwise((1 - frac) * lo + frac * hi).alias(_quantile_name(p)))
    return cells.groupBy(*by).agg(*aggs)


def _match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, cond, "inner").drop(*[f"__r_{k}" for k in keys])


def iqr(df: DataFrame, value: str, by: Iterable[str] = ()) -> DataFrame:
    by = list(by)
    q = exact_quantiles(df, value, [0.25, 0.75], by)
    return q.select(*by, (F.col("q75") - F.col("q25")).alias("iqr"))


def share_by_group(df: DataFrame, by: Iterable[str], flag: Column, na_rm: bool = True) -> DataFrame:
    """Share, numerator and known rows of a 0/1 column per group."""
    return df.groupBy(*by).agg(
        mean_na(flag.cast("double"), na_rm).alias("pct"),
        F.sum(flag).alias("numerator"),
        F.count(flag).alias("n"),
    )


def positives_over_visits(df: DataFrame, visit: str, value: str, positive) -> DataFrame:
    """Samples, positives and share per visit with a score interval."""
    from panelwise.functions.intervals import bind_wilson

    hit = ind(F.col(value) == positive)
    per = df.groupBy(visit).agg(
        F.count("*").alias("num_swabs"), sum_na(hit).alias("num_swabs_pos"), mean_na(hit).alias("pct_swabs_pos")
    )
    return bind_wilson(per, "num_swabs_pos", "num_swabs")


def repeat_distribution(df: DataFrame, key: str) -> DataFrame:
    """How many participants gave 1, 2, ... samples."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return with_share(per.groupBy("n").agg(F.count("*").alias("count")), "count")


class Item(NamedTuple):
    """A table variable: its level expression and the rows it applies to."""

    name: str
    level: Column
    keep: Column | None = None


def stack_levels(df: DataFrame, items: Sequence[Item], carry: Sequence[str] = ()) -> DataFrame:
    """Rows of (variable, level) for all items in one narrow pass."""
    cells = []
    for item in items:
        cell = F.struct(F.lit(item.name).alias("variable"), item.level.cast("string").alias("level"))
        cells.append(cell if item.keep is None else F.when(item.keep, cell))
    exploded = df.select(*carry, F.explode(F.array(*cells)).alias("__cell")).where(F.col("__cell").isNotNull())
    return exploded.select(*carry, "__cell.variable", "__cell.level")


def table_one(df: DataFrame, items: Sequence[Item]) -> DataFrame:
    """Frequency block of a cohort: every variable from one scan and one shuffle.

    ``pct_all`` divides by the rows the variable applies to, ``pct_known`` by
    those with an answer; the row with a NULL level is the missing count.
    """
    counts = stack_levels(df, items).groupBy("variable", "level").agg(F.count("*").alias("n"))
    totals = counts.groupBy("variable").agg(
        F.sum("n").alias("__all"), F.sum(F.when(F.col("level").isNotNull(), F.col("n"))).alias("__known")
    )
    return attach(counts, totals, ["variable"]).withColumns({
        "pct_all": ratio(F.col("n"), F.col("__all")),
        "pct_known": F.when(F.col("level").isNotNull(), ratio(F.col("n"), F.col("__known"))),
    }).drop("__all", "__known")


def table_two(df: DataFrame, items: Sequence[Item], outcome: str, known_levels: bool = False) -> DataFrame:
    """Outcome by level for many variables: one scan, one shuffle, row percentages."""
    counts = stack_levels(df, items, [outcome]).groupBy("variable", "level", outcome).agg(F.count("*").alias("n"))
    if known_levels:
        counts = counts.where(F.col("level").isNotNull())
    return share_within(counts, ["variable", "level"])


def period_prevalence(df: DataFrame, tests: Mapping[str, str], at_baseline: Column, positive) -> DataFrame:
    """Known, positive and share per test: overall, at baseline, after baseline."""
    pairs = []
    for name, column in tests.items():
        v = F.col(column)
        for period in (F.lit("overall"), F.when(at_baseline, "baseline").when(~at_baseline, "post")):
            pairs.append(F.struct(F.lit(name).alias("test"), period.alias("period"), v.alias("value")))
    rows = df.select(F.inline(F.array(*pairs))).where("period IS NOT NULL")
    return rows.groupBy("test", "period").agg(
        F.count("*").alias("n_rows"),
        F.count("value").alias("n_known"),
        F.count_if(F.col("value") == positive).alias("num_pos"),
        F.avg(ind(F.col("value") == positive)).alias("pct_pos"),
    )


def companion_table(df: DataFrame, tests: Mapping[str, str], outcome: str) -> DataFrame:
    """Result by outcome counts of several companion tests, missing results kept."""
    items = [Item(name, _col(c)) for name, c in tests.items()]
    rows = stack_levels(df, items, [outcome])
    return rows.groupBy("variable", "level", outcome).agg(F.count("*").alias("n"))
