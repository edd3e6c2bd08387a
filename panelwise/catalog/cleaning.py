"""Sources, projection, filters, corrections, recoding, joins, sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwise.catalog.base import (
    A, C, MISSING_VISIT, POS, S, UNSURE, VISITS, answers, people, query, r, samples, shared_folder, table,
)
from panelwise.functions import nulls, recode
from panelwise.operators import clean, joins, sequence
from panelwise.operators.describe import count_rows
from panelwise.sources import tables as src

# ---------------------------------------------------------------- sources


@query("scan_wide", """SELECT c_custkey AS id, c_mktsegment AS site, c_acctbal AS age, CAST(c_nationkey AS INT) AS code FROM customer""")
def _(spark, d):
    wide = src.read_sheet(spark, f"{d}/customer.parquet")
    text = wide.select(*[F.col(c).cast("string").alias(c) for c in wide.columns])
    return text.select(
        F.col("c_custkey").cast("bigint").alias("id"), F.col("c_mktsegment").alias("site"),
        nulls.safe_double("c_acctbal").alias("age"), nulls.safe_int("c_nationkey").alias("code"),
    )


@query("scan_lookup", "SELECT DISTINCT s_nationkey FROM supplier")
def _(spark, d):
    return src.read_lookup(spark, f"{d}/supplier.parquet", ["s_nationkey"])


@query("select_by_pattern", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    return src.select_by_pattern(table(spark, d, "customer"), ["c_custkey"], ["acct", "^c_mkt"])


@query("list_columns", """SELECT 'l_extendedprice' AS column_name, count(l_extendedprice) AS n_known FROM lineitem
 UNION ALL SELECT 'l_shipdate', count(l_shipdate) FROM lineitem""")
def _(spark, d):
    df = table(spark, d, "lineitem")
    names = src.list_columns(df, "date|price")
    found = src.matching(df.columns, "date|price")
    known = df.agg(*[F.count(c).alias(c) for c in found]).unpivot([], found, "column_name", "n_known")
    return names.join(known, "column_name")


@query("write_tables", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    (path,) = src.write_tables({"priority_counts": counts}, shared_folder(spark))
    return spark.read.parquet(path)


# ---------------------------------------------------------------- projection and filters


@query("project_rename", "SELECT o_custkey AS id, o_orderstatus AS value FROM orders")
def _(spark, d):
    return table(spark, d, "orders").withColumnRenamed("o_custkey", "id").select("id", F.col("o_orderstatus").alias("value"))


@query("derive_column", S + "SELECT k, CAST(known = 'P' AS INT) AS result, round(x / 1000, 6) AS x_thousand FROM s")
def _(spark, d):
    return samples(spark, d).withColumns({
        "result": nulls.ind(F.col("known") == POS), "x_thousand": r(F.col("x") / 1000, 6),
    }).select("k", "result", "x_thousand")


@query("filter_rows", S + "SELECT k, visit, value FROM s WHERE ord > 1 AND value = 'P'")
def _(spark, d):
    return samples(spark, d).where("ord > 1").where(F.col("value") == POS).select("k", "visit", "value")


@query("filter_keep_null", S + "SELECT k, ord FROM s WHERE ord > 2 OR ord IS NULL")
def _(spark, d):
    return clean.keep_or_unknown(samples(spark, d), F.col("ord") > 2).select("k", "ord")


@query("subset_base", S + """SELECT count(*) FILTER (WHERE ord > 2) AS n_kept, count(*) FILTER (WHERE NOT ord > 2) AS n_dropped,
 count(*) FILTER (WHERE (ord > 2) IS NULL) AS n_unknown FROM s""")
def _(spark, d):
    return clean.subset_counts(samples(spark, d), F.col("ord") > 2)


@query("correct_cell", S + """, f AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0)
 SELECT s.k, CASE WHEN f.id IS NOT NULL AND s.visit = '1-URGENT' THEN 'P' ELSE s.value END AS value,
  CASE WHEN s.id = 7 THEN 'P' ELSE s.known END AS known FROM s LEFT JOIN f ON f.id = s.id""")
def _(spark, d):
    fixes = people(spark, d).where("bal < 0").select("id", F.lit("1-URGENT").alias("visit"), F.lit(POS).alias("right"))
    fixed = clean.correct_from_table(samples(spark, d), "value", fixes, ["id", "visit"], "right")
    return clean.correct_cell(fixed, "known", "id", {7: POS}).select("k", "value", "known")


@query("remap_key", S + """, f AS (SELECT c_custkey AS id, c_custkey + 1000000 AS new_id FROM customer WHERE c_acctbal < 0)
 SELECT s.k, CASE WHEN coalesce(f.new_id, s.id) = 8 THEN 9 ELSE coalesce(f.new_id, s.id) END AS id FROM s LEFT JOIN f ON f.id = s.id""")
def _(spark, d):
    remaps = people(spark, d).where("bal < 0").select(F.col("id").alias("old"), (F.col("id") + 1000000).alias("new"))
    moved = clean.remap_from_table(samples(spark, d), "id", remaps, "old", "new")
    return clean.remap_key(moved, "id", {8: 9}).select("k", "id")


@query("drop_uncertain", S + "SELECT k, value FROM s WHERE value <> 'O'")
def _(spark, d):
    return clean.drop_value(samples(spark, d), "value", UNSURE).select("k", "value")


@query("complete_cases", S + "SELECT k, visit, known, second FROM s WHERE visit IS NOT NULL AND known IS NOT NULL AND second IS NOT NULL")
def _(spark, d):
    return src.not_null_or_all(samples(spark, d), ["k", "visit", "known", "second"])


@query("na_omit_vector", S + "SELECT DISTINCT visit, known FROM s WHERE known IS NOT NULL AND visit IS NOT NULL")
def _(spark, d):
    return samples(spark, d).where("known IS NOT NULL AND visit IS NOT NULL").select("visit", "known").distinct()


# ---------------------------------------------------------------- recoding

SITE_NAMES = {"2": "two", "3": "three", "4": "four", "5": "five"}
CODE_LABELS = {0: "zero", 1: "one", 2: "two", 3: "three", 4: "four", 99: "other"}
GROUPS = {"zero": "low", "one": "low", "two": "mid", "three": "high", "four": "high", "other": "other"}
CUT_BREAKS = (float("-inf"), 0.0, 2500.0, 5000.0, 7500.0)
CUT_LABELS = ("<=0", "0-2500", "2500-5000", "5000-7500")
CODE_SQL = "CASE code WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' WHEN 4 THEN 'four' WHEN 99 THEN 'other' END"


@query("derive_site", C + """SELECT id, CASE substr(CAST(id AS VARCHAR), 1, 1) WHEN '2' THEN 'two' WHEN '3' THEN 'three' WHEN '4' THEN 'four'
 WHEN '5' THEN 'five' ELSE substr(CAST(id AS VARCHAR), 1, 1) END AS site FROM c""")
def _(spark, d):
    return people(spark, d).select("id", recode.leading_digit_label("id", SITE_NAMES).alias("site"))


@query("bin_cut", C + """SELECT id, CASE WHEN bal <= 0 THEN '<=0' WHEN bal <= 2500 THEN '0-2500' WHEN bal <= 5000 THEN '2500-5000'
 WHEN bal <= 7500 THEN '5000-7500' END AS bin FROM c""")
def _(spark, d):
    return people(spark, d).select("id", recode.cut("bal", CUT_BREAKS, CUT_LABELS).alias("bin"))


@query("code_to_label", C + f"SELECT id, {CODE_SQL} AS label FROM c")
def _(spark, d):
    return people(spark, d).select("id", recode.code_labels("code", CODE_LABELS).alias("label"))


@query("order_levels", S + "SELECT k, ord, CASE WHEN ord IS NOT NULL THEN visit END AS visit FROM s ")
def _(spark, d):
    s = samples(spark, d)
    return s.select("k", recode.ordinal("visit", VISITS).alias("ord"), recode.within_levels("visit", VISITS).alias("visit"))


@query("collapse_levels", C + f"""SELECT id, CASE {CODE_SQL} WHEN 'zero' THEN 'low' WHEN 'one' THEN 'low' WHEN 'two' THEN 'mid'
 WHEN 'three' THEN 'high' WHEN 'four' THEN 'high' WHEN 'other' THEN 'other' END AS grp FROM c""")
def _(spark, d):
    return people(spark, d).select("id", recode.lookup(recode.code_labels("code", CODE_LABELS), GROUPS).alias("grp"))


@query("collapse_visits", S + """SELECT k, CASE WHEN visit IN ('2-HIGH', '3-MEDIUM') THEN 'middle' ELSE visit END AS visit_group,
 CASE WHEN visit IS NULL THEN NULL WHEN visit = '1-URGENT' THEN 'pre' ELSE 'post' END AS period FROM s""")
def _(spark, d):
    s = samples(spark, d)
    return s.select(
        "k", recode.replace_any("visit", ["2-HIGH", "3-MEDIUM"], "middle").alias("visit_group"),
        F.when(F.col("visit") == "1-URGENT", "pre").when(F.col("visit") != "1-URGENT", "post").alias("period"),
    )


@query("override_by_text", C + "SELECT id, CASE WHEN \"group\" = 'FURNITURE' THEN 'wood' ELSE site END AS site FROM c")
def _(spark, d):
    return people(spark, d).select("id", recode.override("site", F.col("group") == "FURNITURE", "wood").alias("site"))


@query("recode_value", S + "SELECT k, CASE value WHEN 'P' THEN 'positive' WHEN 'F' THEN 'negative' ELSE value END AS value FROM s")
def _(spark, d):
    return samples(spark, d).select("k", recode.recode("value", {"P": "positive", "F": "negative"}).alias("value"))


@query("default_missing", S + "SELECT k, coalesce(ord, 0) AS ord, coalesce(visit, 'none') AS visit FROM s")
def _(spark, d):
    return samples(spark, d).select(
        "k", recode.default_missing("ord", 0).alias("ord"), recode.default_missing("visit", "none").alias("visit"))


@query("sentinel_to_null", "SELECT o_orderkey AS k, CASE WHEN o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') THEN o_orderpriority END AS visit FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), recode.blank_out("o_orderpriority", [MISSING_VISIT, "5-LOW"]).alias("visit"))


@query("typo_to_value", S + "SELECT k, CASE WHEN known IN ('F', 'FF') THEN '0' ELSE known END AS value FROM s")
def _(spark, d):
    return samples(spark, d).select("k", recode.replace_any("known", ["F", "FF"], "0").alias("value"))


@query("safe_cast", A + """SELECT k, CAST(trunc(try_cast(t AS DOUBLE)) AS INT) AS as_int, try_cast(t AS DOUBLE) AS as_double
 FROM (SELECT k, CASE variable WHEN 'error' THEN 'REFUS' WHEN 'view' THEN value || '.7' WHEN 'click' THEN NULL ELSE value END AS t FROM a)""")
def _(spark, d):
    v = F.col("variable")
    dirty = (
        F.when(v == "error", "REFUS").when(v == "view", F.concat("value", F.lit(".7")))
        .when(v == "click", F.lit(None)).otherwise(F.col("value"))
    )
    return answers(spark, d).withColumn("t", dirty).select(
        "k", nulls.safe_int("t").alias("as_int"), nulls.safe_double("t").alias("as_double"))


@query("indicator", S + "SELECT k, CAST(known = 'P' AS INT) AS pos, CAST(ord > 2 AS INT) AS late FROM s")
def _(spark, d):
    return samples(spark, d).select(
        "k", nulls.ind(F.col("known") == POS).alias("pos"), nulls.ind(F.col("ord") > 2).alias("late"))


@query("indicator_compl", S + "SELECT k, 1 - CAST(known = 'P' AS INT) AS not_pos FROM s")
def _(spark, d):
    return samples(spark, d).select("k", nulls.complement(nulls.ind(F.col("known") == POS)).alias("not_pos"))


@query("indicator_both", S + "SELECT k, CAST(known = 'P' AND second = 'P' AS INT) AS both_pos FROM s")
def _(spark, d):
    a, b = (nulls.ind(F.col(c) == POS) for c in ("known", "second"))
    return samples(spark, d).select("k", nulls.both(a, b).alias("both_pos"))


@query("indicator_either", S + "SELECT k, CAST(known = 'P' OR second = 'P' AS INT) AS any_pos FROM s")
def _(spark, d):
    a, b = (nulls.ind(F.col(c) == POS) for c in ("known", "second"))
    return samples(spark, d).select("k", nulls.either(a, b).alias("any_pos"))


@query("indicator_override", S + "SELECT k, CASE WHEN second = 'F' THEN 0 ELSE CAST(known = 'P' AS INT) END AS pos FROM s")
def _(spark, d):
    flag = nulls.ind(F.col("known") == POS)
    return samples(spark, d).select("k", recode.gate_zero(flag, F.col("second") == "F").alias("pos"))


MONTHS = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 3, "5-LOW": 6}
MONTH_SQL = "CASE visit WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 6 END"


@query("map_visit_month", S + f"SELECT k, {MONTH_SQL} AS visit_num FROM s")
def _(spark, d):
    return samples(spark, d).select("k", recode.lookup("visit", MONTHS).alias("visit_num"))


# ---------------------------------------------------------------- joins


@query("left_join_visit", S + """, g AS (SELECT id, visit, count(*) AS n_high, max(x) AS top FROM s WHERE second = 'P' GROUP BY id, visit)
 SELECT s.k, s.id, s.visit, g.n_high, g.top FROM s LEFT JOIN g ON s.id = g.id AND s.visit IS NOT DISTINCT FROM g.visit""")
def _(spark, d):
    s = samples(spark, d)
    high = s.where(F.col("second") == POS).groupBy("id", "visit").agg(
        F.count(F.lit(1)).alias("n_high"), F.max("x").alias("top"))
    return joins.attach(s.select("k", "id", "visit"), high, ["id", "visit"])


@query("left_join_baseline", S + """SELECT s.k, s.id, p.c_mktsegment AS site, p.c_acctbal AS bal FROM s
 LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) p ON s.id = p.c_custkey""")
def _(spark, d):
    base = people(spark, d).where("bal >= 0").select("id", "site", "bal")
    return joins.attach(samples(spark, d).select("k", "id"), base, ["id"])


@query("semi_join_ids", S + "SELECT k, id FROM s WHERE id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def _(spark, d):
    return joins.keep_ids(samples(spark, d).select("k", "id"), people(spark, d).where("bal >= 0"), "id")


@query("anti_join_ids", S + "SELECT k, id FROM s WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal >= 0 AND c_custkey = s.id)")
def _(spark, d):
    return joins.drop_ids(samples(spark, d).select("k", "id"), people(spark, d).where("bal >= 0"), "id")


@query("semi_join_derived", S + """SELECT k, id, visit, known FROM s WHERE visit <> '1-URGENT' AND EXISTS
 (SELECT 1 FROM s b WHERE b.id = s.id AND b.visit = '1-URGENT' AND b.known = 'F')""")
def _(spark, d):
    rows = sequence.followup_rows(samples(spark, d), "id", F.col("visit") == "1-URGENT", "known", "F")
    return rows.select("k", "id", "visit", "known")


# ---------------------------------------------------------------- sort, first, sets, binding


@query("sort_visits", S + """SELECT k, id, visit, ROW_NUMBER() OVER (PARTITION BY id ORDER BY ord ASC NULLS LAST, k) AS place FROM s
 ORDER BY id, ord ASC NULLS LAST, k""")
def _(spark, d):
    s = samples(spark, d)
    ranked = sequence.number_within(s, ["id"], ["ord", "k"], "known", number="place")
    return ranked.orderBy("id", F.col("ord").asc_nulls_last(), "k").select("k", "id", "visit", "place")


@query("first_match", S + "SELECT id, arg_min(k, (day, k)) FILTER (WHERE known IS NOT NULL) AS first_key FROM s GROUP BY id")
def _(spark, d):
    s = samples(spark, d)
    return s.groupBy("id").agg(sequence.first_known("known", ["day", "k"], of="k").alias("first_key"))


@query("set_difference", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    return joins.ids_only_in(people(spark, d), samples(spark, d).where(F.col("value") == POS), "id")


@query("bind_columns", S + """, g AS (SELECT visit, count(*) AS n, count(*) FILTER (WHERE value = 'P') AS num FROM s GROUP BY visit)
 SELECT visit, n, num, round((p + z2 / (2 * n)) / (1 + z2 / n) - z * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 9) AS lower,
  round((p + z2 / (2 * n)) / (1 + z2 / n) + z * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 9) AS upper
 FROM (SELECT *, num::DOUBLE / n AS p, 1.959963984540054 AS z, CAST(1.959963984540054 AS DOUBLE) * CAST(1.959963984540054 AS DOUBLE) AS z2 FROM
  (SELECT visit, n::DOUBLE AS nd, n, num FROM g))""")
def _(spark, d):
    from panelwise.functions.intervals import bind_wilson

    g = samples(spark, d).groupBy("visit").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == POS).alias("num"))
    out = bind_wilson(g, "num", "n")
    return out.select("visit", "n", "num", r("lower").alias("lower"), r("upper").alias("upper"))


@query("count_rows", "SELECT count(*) AS n FROM orders")
def _(spark, d):
    return count_rows(samples(spark, d))
