"""Repeated tests of one participant in visit order.

First-result and any-result questions are plain aggregates. Only running numbers
and previous results need ordered rows; for those, participants with too many
rows for one task are cut into ordered segments first (``number_within``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.nulls import _col, all_true, ind, mean_na, sum_na
from panelwise.operators.joins import attach, checked_small
from panelwise.session import ensure_checkpoint_dir

MAX_ROWS_PER_KEY = 2_000_000


def order_key(columns: Iterable[str | Column]) -> Column:
    """Composite sort key with missing values last."""
    parts = []
    for c in columns:
        parts += [_col(c).isNull(), _col(c)]
    return F.struct(*parts)


def add_count(df: DataFrame, keys: Iterable[str], name: str = "n") -> DataFrame:
    """Group size on every row: aggregate, then join back."""
    keys = list(keys)
    return attach(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)


def first_known(value: Column | str, order: Iterable[str | Column], of: Column | str | None = None) -> Column:
    """Aggregate: ``value`` (or ``of``) on the earliest row where ``value`` is known."""
    value = _col(value)
    key = F.when(value.isNotNull(), order_key(order))
    return F.min_by(value if of is None else _col(of), key)


def average_rank(df: DataFrame, keys: Iterable[str], order: str, name: str = "rank") -> DataFrame:
    """Rank in the group with ties sharing their mean rank.

    The window runs over distinct order values per key (visits), never over raw
    rows, so its partitions are as long as the visit list.
    """
    keys = list(keys)
    per_visit = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last())
    before = F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranks = per_visit.withColumn(name, F.coalesce(before, F.lit(0)) + (F.col("__c") + 1) / 2).drop("__c")
    return attach(df, ranks, [*keys, order])


def _heavy_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return a.join(b, cond, how)


def number_within(df: DataFrame, keys: Iterable[str], order: Iterable[str | Column], value: str,
                  number: str = "test_num", previous: str = "prev",
                  max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """Running number and previous ``value`` within each key, in the given order.

    Keys with at most ``max_rows`` rows use an ordinary window. A key with more
    is range-partitioned by (key, order) into segments; windows run inside the
    segments and a small carry table (one row per segment) continues the
    numbering and hands over the last value. The segment assignment is written
    with ``checkpoint()``, so a lost executor cannot change it.
    """
    keys, order = list(keys), list(order)
    sort = "__sort"
    rows = df.withColumn(sort, order_key(order))
    w = Window.partitionBy(*keys).orderBy(sort)
    plain = {number: F.row_number().over(w), previous: F.lag(value).over(w)}

    heavy = checked_small(_heavy_keys(df, keys, max_rows))
    total = heavy.agg(F.sum("__n")).first()[0]
    if not total:
        return rows.withColumns(plain).drop(sort)

    ensure_checkpoint_dir(df.sparkSession)
    light = _null_safe(rows, heavy, keys, "left_anti").withColumns(plain)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_segments = max(partitions, int(total // max_rows) + 1)
    seg = (
        _null_safe(rows, heavy, keys, "left_semi")
        .repartitionByRange(n_segments, *keys, sort)
        .drop(sort)
        .withColumn("__seg", F.spark_partition_id())
        .checkpoint()
        .withColumn(sort, order_key(order))
    )
    inside = Window.partitionBy(*keys, "__seg").orderBy(sort)
    across = Window.partitionBy(*keys).orderBy("__seg")
    carry = (
        seg.groupBy(*keys, "__seg")
        .agg(F.count(F.lit(1)).alias("__c"), F.max_by(value, sort).alias("__last"))
        .withColumns({
            "__done": F.coalesce(F.sum("__c").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "__prev": F.lag("__last").over(across),
        })
        .select(*keys, "__seg", "__done", "__prev")
    )
    numbered = attach(
        seg.withColumns({"__i": F.row_number().over(inside), "__lag": F.lag(value).over(inside)}),
        checked_small(carry), [*keys, "__seg"],
    ).withColumns({
        number: (F.col("__i") + F.col("__done")).cast("int"),
        previous: F.when(F.col("__i") == 1, F.col("__prev")).otherwise(F.col("__lag")),
    })
    return light.unionByName(numbered.select(*light.columns)).drop(sort)


def first_in_group(df: DataFrame, keys: Iterable[str], order: Iterable[str | Column], value: str,
                   name: str = "first_result") -> DataFrame:
    """Value of the earliest row on every row of the group (may be NULL)."""
    keys = list(keys)
    first = df.groupBy(*keys).agg(F.min_by(F.col(value), order_key(order)).alias(name))
    return attach(df, first, keys)


def result_summary(value: Column | str, positive, negative) -> list[Column]:
    """n known, positives, negatives, share positive."""
    v = _col(value)
    return [
        F.count(v).alias("n"),
        F.count_if(v == positive).alias("num_pos"),
        F.count_if(v == negative).alias("num_neg"),
        F.avg(ind(v == positive)).alias("pct_pos"),
    ]


def first_results(df: DataFrame, key: str, order: Iterable[str | Column], value: str,
                  companion: str | None = None) -> DataFrame:
    """First known result per participant, with another column of the same row."""
    aggs = [first_known(value, order).alias("first_result")]
    if companion:
        aggs.append(first_known(value, order, of=companion).alias("companion"))
    return df.groupBy(key).agg(*aggs)


def first_test_summary(df: DataFrame, key: str, order, value: str, positive, negative) -> DataFrame:
    firsts = first_results(df, key, order, value)
    return firsts.agg(*result_summary("first_result", positive, negative))


def companion_at_first_positive(df: DataFrame, key: str, order, value: str, companion: str,
                                positive, negative) -> DataFrame:
    """Second test on the row of the first known result, among first-positives."""
    firsts = first_results(df, key, order, value, companion).where(F.col("first_result") == positive)
    return firsts.agg(*result_summary("companion", positive, negative))


def incident_rows(df: DataFrame, key: str, order, value: str, negative,
                  max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """Known tests whose previous known test was negative."""
    known = df.where(F.col(value).isNotNull())
    return number_within(known, [key], order, value, max_rows=max_rows).where(F.col("prev") == negative)


def _narrow(df: DataFrame, *columns) -> DataFrame:
    """Only the named columns, so that ordering moves nothing else."""
    if not all(isinstance(c, str) for c in columns):
        return df
    return df.select(*dict.fromkeys(columns))


def incident_tests(df: DataFrame, key: str, order, value: str, positive, negative,
                   max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    rows = incident_rows(_narrow(df, key, value, *order), key, order, value, negative, max_rows)
    return rows.agg(*result_summary(value, positive, negative))


def incident_with_companion(df: DataFrame, key: str, order, value: str, companion: str, positive, negative,
                            max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """Second test among new positives."""
    rows = _narrow(df, key, value, companion, *order)
    rows = incident_rows(rows, key, order, value, negative, max_rows).where(F.col(value) == positive)
    return rows.agg(*result_summary(companion, positive, negative))


def _baseline_ids(df: DataFrame, key: str, at_baseline: Column, value: str, result) -> DataFrame:
    return df.where(at_baseline & (F.col(value) == result) & F.col(key).isNotNull()).select(key).distinct()


def followup_rows(df: DataFrame, key: str, at_baseline: Column, value: str, negative) -> DataFrame:
    """Later rows of participants who were negative at baseline."""
    ids = _baseline_ids(df, key, at_baseline, value, negative)
    return df.where(~at_baseline).join(ids, key, "left_semi")


def followup_summary(df: DataFrame, key: str, at_baseline: Column, value: str, positive, negative) -> DataFrame:
    """Baseline-negative cohort: later tests, rate, persons tested and positive.

    Rows are first reduced to one partial record per participant, so the person
    counts need no distinct over raw rows.
    """
    v = F.col(value)
    later = ~at_baseline
    per_person = df.groupBy(key).agg(
        F.bool_or(at_baseline & (v == negative)).alias("cohort"),
        F.count_if(later & v.isNotNull()).alias("tests"),
        F.count_if(later & (v == positive)).alias("pos"),
        F.count_if(later & (v == negative)).alias("neg"),
    ).where(F.col("cohort") & F.col(key).isNotNull())
    return per_person.agg(
        F.count(F.lit(1)).alias("n_cohort"),
        F.sum("tests").alias("n_tests"),
        F.sum("pos").alias("num_pos"),
        F.sum("neg").alias("num_neg"),
        F.try_divide(F.sum("pos").cast("double"), F.sum("tests").cast("double")).alias("pct_pos"),
        F.count_if(F.col("pos") + F.col("neg") > 0).alias("persons_tested"),
        F.count_if(F.col("pos") > 0).alias("persons_positive"),
    )


def exclude_baseline_positive(df: DataFrame, key: str, at_baseline: Column, value: str, positive) -> DataFrame:
    """Drop every row of participants who were positive at baseline."""
    ids = _baseline_ids(df, key, at_baseline, value, positive).withColumnRenamed(key, "__id")
    return df.join(ids, df[key] == ids["__id"], "left_anti")


def always_never(df: DataFrame, key: str, value: str, positive, negative) -> DataFrame:
    """Among repeatedly sampled participants: always positive, never positive."""
    v = F.col(value)
    per = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        all_true(v == positive).alias("always"),
        all_true(v == negative).alias("never"),
    ).where("n > 1")
    return per.agg(
        F.count(F.lit(1)).alias("n_persons"),
        sum_na(ind(F.col("always"))).alias("n_always"),
        mean_na(ind(F.col("always"))).alias("pct_always"),
        sum_na(ind(F.col("never"))).alias("n_never"),
        mean_na(ind(F.col("never"))).alias("pct_never"),
    )


def initial_vs_later(df: DataFrame, key: str, order: str, value: str, positive, negative) -> DataFrame:
    """Discordant participants by their result at the earliest visit.

    Shares are of all repeatedly sampled participants. ``n_tied`` counts the
    participants with several rows at their earliest visit, for whom "initial"
    is not defined; they are left out of the discordant counts.
    """
    v = F.col(value)
    per_visit = df.groupBy(key, order).agg(
        F.count(F.lit(1)).alias("c"),
        F.count(v).alias("k"),
        F.count_if(v == positive).alias("p"),
        F.count_if(v == negative).alias("q"),
    )
    first = F.min_by(F.struct("c", "k", "p"), order_key([order]))
    per = per_visit.groupBy(key).agg(
        *[F.sum(x).alias(y) for x, y in (("c", "n"), ("k", "k"), ("p", "p"), ("q", "q"))], first.alias("f")
    ).where("n > 1")
    # Known results differ from all-positive and from all-negative.
    discordant = (F.col("p") < F.col("k")) & (F.col("q") < F.col("k")) & (F.col("f.c") == 1) & (F.col("f.k") == 1)
    neg_pos = F.count_if(discordant & (F.col("f.p") == 0))
    pos_neg = F.count_if(discordant & (F.col("f.p") == 1))
    n = F.count(F.lit(1))
    return per.agg(
        neg_pos.alias("n_init_neg_later_pos"),
        F.try_divide(neg_pos.cast("double"), n.cast("double")).alias("pct_init_neg_later_pos"),
        pos_neg.alias("n_init_pos_later_neg"),
        F.try_divide(pos_neg.cast("double"), n.cast("double")).alias("pct_init_pos_later_neg"),
        F.count_if(F.col("f.c") > 1).alias("n_tied"),
        n.alias("n_persons"),
    )


def pivot_repeat(df: DataFrame, key: str, order: Sequence[str], value: str, repeats: int = 2,
                 prefix: str = "swab_") -> DataFrame:
    """One row per participant with exactly ``repeats`` samples, one column each.

    Two samples are the earliest and the latest row of one aggregation. For more,
    samples are collected only after the count filter, so an array never holds
    more than ``repeats`` entries.
    """
    if repeats == 2:
        place = order_key(order)
        per = df.groupBy(key).agg(
            F.count(F.lit(1)).alias("__n"),
            F.min_by(F.struct(F.col(value).alias("v")), place).alias("a"),
            F.max_by(F.struct(F.col(value).alias("v")), place).alias("b"),
        )
        return per.where("__n = 2").select(key, F.col("a.v").alias(f"{prefix}1"), F.col("b.v").alias(f"{prefix}2"))
    exact = add_count(df, [key], "__n").where(F.col("__n") == repeats)
    cells = F.sort_array(F.collect_list(F.struct(order_key(order).alias("k"), F.col(value).alias("v"))))
    per = exact.groupBy(key).agg(cells.alias("cells"))
    return per.select(key, *[F.col("cells")[i]["v"].alias(f"{prefix}{i + 1}") for i in range(repeats)])


def paired_agreement(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """First against second sample of participants with exactly two."""
    pairs = pivot_repeat(df, key, order, value)
    return pairs.where("swab_1 IS NOT NULL AND swab_2 IS NOT NULL").groupBy("swab_1", "swab_2").agg(
        F.count(F.lit(1)).alias("n")
    )


def one_random_row(df: DataFrame, key: str, unique: Sequence[str], seed: int = 0) -> DataFrame:
    """One row per participant, chosen by a seeded digest of the row's unique key.

    A minimum over (digest, row) is an aggregate with map-side combining, so a
    participant with very many rows never lands in one task.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (key, *unique)]))
    row = F.struct(digest.alias("d"), F.struct(*df.columns).alias("r"))
    return df.groupBy(F.col(key).alias("__k")).agg(F.min(row).alias("m")).select("m.r.*")


def repeated_rows(df: DataFrame, keys: Iterable[str], order: str) -> DataFrame:
    """Second and later occurrences of a key combination.

    The first occurrence is the smallest by (order, all columns), missing values last. Keys are counted as 128-bit digests
    with their order value, so a key without repeats moves nothing else. Rows of repeated keys are told apart by order; only
    rows that tie with the first one are compared in all columns, equal ones as counts. No key's rows meet in one task.
    """
    keys, columns = list(keys), df.columns
    parts = [*[F.col(c) for c in keys], *[F.col(c).isNull() for c in keys]]
    marked = df.withColumns({f"__d{i}": F.xxhash64(F.lit(i), *parts) for i in (0, 1)})
    digest, at = ["__d0", "__d1"], F.col(order)
    per_value = marked.groupBy(*digest, at.alias("__o")).agg(F.count(F.lit(1)).alias("__c"))
    known = F.col("__o").isNotNull()
    firsts = per_value.groupBy(*digest).agg(
        F.sum("__c").alias("__n"), F.min("__o").alias("__least"), F.coalesce(F.min_by(F.when(known, F.col("__c")), "__o"), F.max("__c")).alias("__tied")
    ).where("__n > 1")
    later = F.col("__least").isNotNull() & (at.isNull() | (at > F.col("__least")))
    out = marked.join(firsts, digest).where(later).select(*columns)

    tied = marked.join(firsts.where("__tied > 1"), digest).where(~later)
    same = tied.groupBy(*digest, *columns).agg(F.count(F.lit(1)).alias("__times"))
    row = order_key(columns)
    same = attach(same, same.groupBy(*digest).agg(F.min(row).alias("__first")), digest)
    left = F.col("__times") - F.when(row.eqNullSafe(F.col("__first")), 1).otherwise(0)
    again = same.where(left > 0).select(*columns, F.explode(F.sequence(F.lit(1).cast("bigint"), left)).alias("__i")).drop("__i")
    return out.unionByName(again)
