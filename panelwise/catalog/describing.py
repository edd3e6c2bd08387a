"""Counts, shares, quantiles, descriptive tables, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwise.catalog.base import BASELINE, C, NEG, POS, S, VISITS, people, query, r, rounded, samples
from panelwise.functions import intervals, nulls, recode
from panelwise.functions.nulls import ind
from panelwise.operators import describe, joins, reshape, sequence
from panelwise.operators.describe import Item


@query("count_distinct", S + "SELECT count(DISTINCT visit) + max(CAST(visit IS NULL AS INT)) AS n_distinct FROM s")
def _(spark, d):
    return describe.count_distinct(samples(spark, d), "visit")


@query("distinct_rows", S + "SELECT DISTINCT id, visit FROM s")
def _(spark, d):
    return samples(spark, d).select("id", "visit").distinct()


@query("count_missing", S + "SELECT count(*) FILTER (WHERE visit IS NULL) AS n_missing FROM s")
def _(spark, d):
    from panelwise.sources.tables import missing_count

    return missing_count(samples(spark, d), "visit")


@query("count_true", S + "SELECT count(*) FILTER (WHERE known = 'P') AS n_true FROM s")
def _(spark, d):
    return samples(spark, d).agg(F.count_if(F.col("known") == POS).alias("n_true"))


@query("prop_true", S + """SELECT CASE WHEN count(*) = count(known) THEN avg(CAST(known = 'P' AS INT)) END AS strict,
 round(avg(CAST(known = 'P' AS INT)), 9) AS known_only, round(count(*) FILTER (WHERE known = 'P') / count(*), 9) AS of_all FROM s""")
def _(spark, d):
    hit = F.col("known") == POS
    return samples(spark, d).agg(
        nulls.share_true(hit).alias("strict"), r(nulls.share_true(hit, na_rm=True)).alias("known_only"),
        r(nulls.ratio(F.count_if(hit), F.count(F.lit(1)))).alias("of_all"))


@query("freq_1way", S + """SELECT l.visit, count(s.k) AS n FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('5-LOW'), ('9-UNUSED'), (NULL)) l(visit)
 LEFT JOIN s ON s.visit IS NOT DISTINCT FROM l.visit GROUP BY l.visit""")
def _(spark, d):
    return describe.freq(samples(spark, d), "visit", [*VISITS, "9-UNUSED"], include_na=True)


@query("freq_1way_pct", S + """SELECT visit, n, round(n / sum(n) OVER (), 9) AS pct_all,
 CASE WHEN visit IS NOT NULL THEN round(n / sum(n) FILTER (WHERE visit IS NOT NULL) OVER (), 9) END AS pct_known
 FROM (SELECT visit, count(*) AS n FROM s GROUP BY visit)""")
def _(spark, d):
    return rounded(describe.freq_pct(samples(spark, d), "visit", include_na=True), "pct_all", "pct_known")


@query("freq_2way", S + "SELECT known, second, count(*) AS n FROM s GROUP BY known, second")
def _(spark, d):
    return describe.freq_2way(samples(spark, d), "known", "second", include_na=True)


@query("freq_filtered", S + """SELECT known, count(*) AS n FROM (SELECT CASE WHEN ord > 1 THEN known END AS known FROM s
 WHERE ord > 1 OR ord IS NULL) GROUP BY known""")
def _(spark, d):
    return describe.freq_filtered(samples(spark, d), "known", F.col("ord") > 1, na_rows="count")


@query("group_count", C + "SELECT site, count(*) AS n FROM c GROUP BY site")
def _(spark, d):
    return people(spark, d).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query("group_count_pct", S + "SELECT visit, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS pct FROM s GROUP BY visit")
def _(spark, d):
    return rounded(describe.group_share(samples(spark, d), "visit"), "pct")


@query("group_count_pct_within", S + """SELECT visit, known, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY visit), 9) AS pct
 FROM s GROUP BY visit, known""")
def _(spark, d):
    return rounded(describe.group_share_within(samples(spark, d), "visit", "known"), "pct")


@query("group_count_pct_nonnull", S + """SELECT visit, known, n, round(n / sum(n) OVER (PARTITION BY visit), 9) AS pct
 FROM (SELECT visit, known, count(*) AS n FROM s GROUP BY visit, known) WHERE known IS NOT NULL""")
def _(spark, d):
    return rounded(describe.group_share_within(samples(spark, d), "visit", "known", known_only=True), "pct")


BIN = "CASE WHEN x <= 100000 THEN 'low' WHEN x <= 300000 THEN 'mid' ELSE 'high' END"
BIN_BREAKS, BIN_LABELS = (float("-inf"), 100000.0, 300000.0, float("inf")), ("low", "mid", "high")


@query("group_pos_rate", S + f""", u AS (SELECT 'visit' AS variable, visit AS level, value FROM s UNION ALL SELECT 'second', second, value FROM s
 UNION ALL SELECT 'amount', {BIN}, value FROM s WHERE ord > 1)
 SELECT variable, level, CAST(sum(CAST(value = 'P' AS INT)) AS BIGINT) AS num_pos, count(*) AS n,
  round(sum(CAST(value = 'P' AS INT)) / count(*), 9) AS pct FROM u GROUP BY variable, level""")
def _(spark, d):
    s = samples(spark, d).withColumn("pos", ind(F.col("value") == POS))
    amount = recode.cut("x", BIN_BREAKS, BIN_LABELS)
    rates = describe.level_rates(
        s, {"visit": F.col("visit"), "second": F.col("second"), "amount": amount}, "pos", {"amount": F.col("ord") > 1})
    return rounded(rates, "pct")


@query("group_pos_neg", S + """SELECT visit, count(*) AS n, count(*) FILTER (WHERE known = 'P') AS num_pos, count(*) FILTER (WHERE known = 'F') AS num_neg,
 round(count(*) FILTER (WHERE known = 'P') / count(*), 9) AS pct_pos FROM s GROUP BY visit""")
def _(spark, d):
    return rounded(describe.group_pos_neg(samples(spark, d), "visit", "known", POS, NEG), "pct_pos")


ANY = "CASE WHEN bool_or({c}) THEN true WHEN count(*) = count({c}) THEN false END"


@query("collapse_any", S + "SELECT id, " + ANY.format(c="(known = 'P')") + " AS any_pos FROM s GROUP BY id")
def _(spark, d):
    return describe.collapse_any(samples(spark, d), "id", {"any_pos": F.col("known") == POS})


@query("collapse_any_multi", S + """, g AS (SELECT id, coalesce(bool_or(known = 'P'), false) AS a, bool_or(known IS NOT NULL) AS b,
 coalesce(bool_or(second = 'P'), false) AS c, bool_or(second IS NOT NULL) AS d FROM s GROUP BY id)
 SELECT count(*) FILTER (WHERE a) AS pos_first, count(*) FILTER (WHERE b) AS tested_first,
  count(*) FILTER (WHERE c) AS pos_second, count(*) FILTER (WHERE d) AS tested_second FROM g""")
def _(spark, d):
    return describe.any_totals(samples(spark, d), "id", {"first": ("known", POS), "second": ("second", POS)})


@query("overall_rate", S + """SELECT CAST(sum(CAST(value = 'P' AS INT)) AS BIGINT) AS num_positive, round(avg(CAST(value = 'P' AS INT)), 9) AS pct,
 count(*) AS n FROM s""")
def _(spark, d):
    return rounded(describe.overall_rate(samples(spark, d), F.col("value") == POS), "pct")


@query("availability", S + """SELECT visit, count(known) AS n_first, count(second) AS n_second,
 count(*) FILTER (WHERE known IS NOT NULL AND second IS NOT NULL) AS n_both,
 round(count(known) / (SELECT count(*) FROM customer), 9) AS pct_first, round(count(second) / (SELECT count(*) FROM customer), 9) AS pct_second,
 round(count(*) FILTER (WHERE known IS NOT NULL AND second IS NOT NULL) / (SELECT count(*) FROM customer), 9) AS pct_both FROM s GROUP BY visit""")
def _(spark, d):
    total = describe.count_rows(people(spark, d)).scalar()
    out = describe.availability(
        samples(spark, d), "visit", {"first": "known", "second": "second"}, ("first", "second"), total)
    return rounded(out, "pct_first", "pct_second", "pct_both")


@query("quantiles", S + """SELECT visit, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50,
 round(quantile_cont(x, 0.75), 6) AS q75 FROM s GROUP BY visit""")
def _(spark, d):
    q = describe.exact_quantiles(samples(spark, d), "x", [0.25, 0.5, 0.75], ["visit"])
    return rounded(q, "q25", "q50", "q75", digits=6)


@query("iqr", C + "SELECT round(quantile_cont(bal_known, 0.75) - quantile_cont(bal_known, 0.25), 6) AS iqr FROM c")
def _(spark, d):
    return rounded(describe.iqr(people(spark, d), "bal_known"), "iqr", digits=6)


@query("min_max_mean", C + """SELECT count(*) AS n, count(*) FILTER (WHERE bal_known IS NULL) AS n_missing, min(bal_known) AS min,
 max(bal_known) AS max, round(avg(bal_known), 6) AS mean FROM c""")
def _(spark, d):
    return rounded(describe.numeric_summary(people(spark, d), "bal_known"), "mean", digits=6)


@query("group_moments", C + """SELECT site, round(avg(bal_known), 6) AS mean, round(stddev_samp(bal_known), 6) AS sd, count(*) AS n,
 count(bal_known) AS n_known, round(quantile_cont(bal_known, 0.5), 6) AS median FROM c GROUP BY site""")
def _(spark, d):
    out = describe.group_moments(people(spark, d), ["site"], "bal_known")
    return rounded(out, "mean", "sd", "median", digits=6)


@query("share_by_group", S + """, u AS (SELECT visit, 'known' AS measure, CAST(known = 'P' AS INT) AS v FROM s
 UNION ALL SELECT visit, 'second', CAST(second = 'P' AS INT) FROM s)
 SELECT measure, visit, round(avg(1 - v), 9) AS pct, CAST(sum(1 - v) AS BIGINT) AS numerator, count(v) AS n FROM u GROUP BY measure, visit""")
def _(spark, d):
    flags = samples(spark, d).select("visit", *[ind(F.col(c) == POS).alias(c) for c in ("known", "second")])
    long = reshape.unpivot_measures(flags, ["visit"], ["known", "second"])
    return rounded(describe.share_by_group(long, ["measure", "visit"], 1 - F.col("value")), "pct")


WILSON = """round(({x} / {n} + z2 / (2 * {n})) / (1 + z2 / {n}) - z * sqrt({x} / {n} * (1 - {x} / {n}) / {n} + z2 / (4 * {n} * {n})) / (1 + z2 / {n}), 9) AS lower,
 round(({x} / {n} + z2 / (2 * {n})) / (1 + z2 / {n}) + z * sqrt({x} / {n} * (1 - {x} / {n}) / {n} + z2 / (4 * {n} * {n})) / (1 + z2 / {n}), 9) AS upper"""
Z = "(SELECT 1.959963984540054::DOUBLE AS z, 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE AS z2) zz"


@query("swab_time", S + f""", g AS (SELECT visit, count(*)::DOUBLE AS n, count(*) FILTER (WHERE value = 'P') AS x FROM s GROUP BY visit)
 SELECT visit, CAST(n AS BIGINT) AS num_swabs, x AS num_swabs_pos, round(x / n, 9) AS pct_swabs_pos, {WILSON.format(x='x', n='n')} FROM g, {Z}""")
def _(spark, d):
    out = describe.positives_over_visits(samples(spark, d), "visit", "value", POS)
    return rounded(out, "pct_swabs_pos", "lower", "upper")


@query("repeat_distribution", S + """SELECT n, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 9) AS pct
 FROM (SELECT id, count(*) AS n FROM s GROUP BY id) GROUP BY n""")
def _(spark, d):
    return rounded(describe.repeat_distribution(samples(spark, d), "id"), "pct")


@query("univariate_table_one", C + """, e AS (SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.id AND o_orderstatus <> 'O')),
 u AS (SELECT 'site' AS variable, site AS level FROM e UNION ALL SELECT 'group', "group" FROM e
  UNION ALL SELECT 'balance', CASE WHEN bal_known <= 2500 THEN 'small' WHEN bal_known <= 99999 THEN 'large' END FROM e
  UNION ALL SELECT 'group_rich', "group" FROM e WHERE bal_known > 2500),
 g AS (SELECT variable, level, count(*) AS n FROM u GROUP BY variable, level)
 SELECT variable, level, n, round(n / sum(n) OVER (PARTITION BY variable), 9) AS pct_all,
  CASE WHEN level IS NOT NULL THEN round(n / sum(n) FILTER (WHERE level IS NOT NULL) OVER (PARTITION BY variable), 9) END AS pct_known FROM g""")
def _(spark, d):
    cohort = joins.keep_ids(people(spark, d), samples(spark, d).where("value <> 'O'").select("id"), "id")
    items = [
        Item("site", F.col("site")), Item("group", F.col("group")),
        Item("balance", recode.cut("bal_known", (float("-inf"), 2500.0, 99999.0), ("small", "large"))),
        Item("group_rich", F.col("group"), F.coalesce(F.col("bal_known") > 2500, F.lit(False))),
    ]
    return rounded(describe.table_one(cohort, items), "pct_all", "pct_known")


@query("multi_table_two", S + f""", u AS (SELECT 'visit' AS variable, visit AS level, known FROM s WHERE known IS NOT NULL
 UNION ALL SELECT 'second', second, known FROM s WHERE known IS NOT NULL
 UNION ALL SELECT 'second_late', second, known FROM s WHERE known IS NOT NULL AND ord > 1
 UNION ALL SELECT 'amount', {BIN}, known FROM s WHERE known IS NOT NULL)
 SELECT variable, level, known, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY variable, level), 9) AS pct
 FROM u GROUP BY variable, level, known""")
def _(spark, d):
    items = [
        Item("visit", F.col("visit")), Item("second", F.col("second")),
        Item("second_late", F.col("second"), F.coalesce(F.col("ord") > 1, F.lit(False))),
        Item("amount", recode.cut("x", BIN_BREAKS, BIN_LABELS)),
    ]
    return rounded(describe.table_two(samples(spark, d).where("known IS NOT NULL"), items, "known"), "pct")


# ---------------------------------------------------------------- intervals


@query("wilson_ci", S + f""", p AS (SELECT id, bool_or(value = 'P') AS pos FROM s WHERE value <> 'O' GROUP BY id),
 g AS (SELECT count(*) FILTER (WHERE pos) AS num_positive, count(*)::DOUBLE AS nd FROM p)
 SELECT num_positive, round(num_positive / nd, 9) AS pct, CAST(nd AS BIGINT) AS n, {WILSON.format(x='num_positive', n='nd')} FROM g, {Z}""")
def ever_positive_share(spark, d):
    """Share of participants with any positive sample and its score interval."""
    from panelwise.operators.clean import drop_value

    known = drop_value(samples(spark, d), "value", "O")
    out = intervals.bind_wilson(describe.ever_positive(known, "id", "value", POS), "num_positive", "n")
    return rounded(out, "pct", "lower", "upper")


@query("wald_prop_ci", S + """, g AS (SELECT visit, count(*) AS n, avg(CAST(value = 'P' AS INT)) AS pct FROM s GROUP BY visit)
 SELECT visit, n, round(pct, 9) AS pct, round(sqrt(pct * (1 - pct) / n), 9) AS se, round(pct - 1.96::DOUBLE * sqrt(pct * (1 - pct) / n), 9) AS lower,
  round(pct + 1.96::DOUBLE * sqrt(pct * (1 - pct) / n), 9) AS upper FROM g""")
def _(spark, d):
    g = samples(spark, d).groupBy("visit").agg(
        F.count(F.lit(1)).alias("n"), F.avg(ind(F.col("value") == POS)).alias("pct"))
    se, lo, hi = intervals.wald("pct", "n")
    return rounded(g.withColumns({"se": se, "lower": lo, "upper": hi}), "pct", "se", "lower", "upper")


@query("mean_ci", C + """, g AS (SELECT site, avg(bal_known) AS m, stddev_samp(bal_known) AS sd, count(*)::DOUBLE AS n FROM c GROUP BY site)
 SELECT site, round(m, 6) AS mean, round(m - 1.96::DOUBLE * sd / sqrt(n), 6) AS lower, round(m + 1.96::DOUBLE * sd / sqrt(n), 6) AS upper FROM g""")
def _(spark, d):
    lo, hi = intervals.mean_interval("mean", "sd", "n")
    g = describe.moments(people(spark, d), ["site"], "bal_known").withColumns({"lower": lo, "upper": hi})
    return rounded(g.select("site", "mean", "lower", "upper"), "mean", "lower", "upper", digits=6)


# ---------------------------------------------------------------- prevalence by period


@query("baseline_vs_post", S + """, u AS (SELECT 'first' AS test, known AS value, visit FROM s UNION ALL SELECT 'second', second, visit FROM s),
 t AS (SELECT test, 'overall' AS period, value FROM u UNION ALL
  SELECT test, CASE WHEN visit = '1-URGENT' THEN 'baseline' ELSE 'post' END, value FROM u WHERE visit IS NOT NULL)
 SELECT test, period, count(*) AS n_rows, count(value) AS n_known, count(*) FILTER (WHERE value = 'P') AS num_pos,
  round(avg(CAST(value = 'P' AS INT)), 9) AS pct_pos FROM t GROUP BY test, period""")
def _(spark, d):
    out = describe.period_prevalence(
        samples(spark, d), {"first": "known", "second": "second"}, F.col("visit") == BASELINE, POS)
    return rounded(out, "pct_pos")


@query("companion_results", S + """, m AS (SELECT id, visit, max(second) AS lab FROM s GROUP BY id, visit),
 j AS (SELECT s.value, s.second, m.lab FROM s LEFT JOIN m ON m.id = s.id AND m.visit IS NOT DISTINCT FROM s.visit)
 SELECT 'lab' AS variable, lab AS level, value, count(*) AS n FROM j GROUP BY lab, value
 UNION ALL SELECT 'own', second, value, count(*) FROM j GROUP BY second, value""")
def _(spark, d):
    s = samples(spark, d)
    lab = s.groupBy("id", "visit").agg(F.max("second").alias("lab"))
    joined = joins.attach(s.select("id", "visit", "value", "second"), lab, ["id", "visit"])
    return describe.companion_table(joined, {"lab": "lab", "own": "second"}, "value")


@query("add_count", S + "SELECT k, n FROM (SELECT k, count(*) OVER (PARTITION BY id) AS n FROM s) WHERE n > 1")
def _(spark, d):
    return sequence.add_count(samples(spark, d), ["id"]).where("n > 1").select("k", "n")
