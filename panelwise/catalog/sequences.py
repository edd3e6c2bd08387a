"""Repeated tests in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwise.catalog.base import BASELINE, NEG, POS, S, query, rounded, samples
from panelwise.operators import describe, sequence

ORDER = ["day", "k"]
SUMMARY = """count({v}) AS n, count(*) FILTER (WHERE {v} = 'P') AS num_pos, count(*) FILTER (WHERE {v} = 'F') AS num_neg,
 round(avg(CAST({v} = 'P' AS INT)), 9) AS pct_pos"""
KNOWN = """, t AS (SELECT *, ROW_NUMBER() OVER w AS test_num, lag(known) OVER w AS prev FROM s WHERE known IS NOT NULL
 WINDOW w AS (PARTITION BY id ORDER BY day, k)) """


@query("avg_rank", S + """SELECT k, rank() OVER (PARTITION BY id ORDER BY ord ASC NULLS LAST) + (count(*) OVER (PARTITION BY id, ord) - 1) / 2 AS rank FROM s""")
def _(spark, d):
    return sequence.average_rank(samples(spark, d), ["id"], "ord").select("k", "rank")


@query("test_number", S + KNOWN + "SELECT k, CAST(test_num AS INT) AS test_num FROM t")
def _(spark, d):
    known = samples(spark, d).where("known IS NOT NULL")
    return sequence.number_within(known, ["id"], ORDER, "known").select("k", "test_num")


@query("first_in_group", S + "SELECT k, first_value(second) OVER (PARTITION BY id ORDER BY day, k) AS first_result FROM s")
def _(spark, d):
    return sequence.first_in_group(samples(spark, d), ["id"], ORDER, "second").select("k", "first_result")


@query("lag_value", S + "SELECT k, lag(known) OVER (PARTITION BY id ORDER BY day, k) AS prev FROM s")
def _(spark, d):
    return sequence.number_within(samples(spark, d), ["id"], ORDER, "known").select("k", "prev")


@query("first_nonnull", S + "SELECT id, arg_min(known, (day, k)) FILTER (WHERE known IS NOT NULL) AS first_result FROM s GROUP BY id")
def _(spark, d):
    return sequence.first_results(samples(spark, d), "id", ORDER, "known")


@query("companion_at_first", S + """, t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY day, k) AS i FROM s WHERE known IS NOT NULL)
 SELECT p.id, t.known AS first_result, t.second AS companion FROM (SELECT DISTINCT id FROM s) p LEFT JOIN t ON t.id = p.id AND t.i = 1""")
def _(spark, d):
    return sequence.first_results(samples(spark, d), "id", ORDER, "known", "second")


@query("first_test_summary", S + """, t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY day, k) AS i FROM s WHERE known IS NOT NULL)
 SELECT """ + SUMMARY.format(v="known") + " FROM t WHERE i = 1")
def _(spark, d):
    return rounded(sequence.first_test_summary(samples(spark, d), "id", ORDER, "known", POS, NEG), "pct_pos")


@query("companion_at_first_positive", S + """, t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY day, k) AS i FROM s WHERE known IS NOT NULL)
 SELECT """ + SUMMARY.format(v="second") + " FROM t WHERE i = 1 AND known = 'P'")
def _(spark, d):
    out = sequence.companion_at_first_positive(samples(spark, d), "id", ORDER, "known", "second", POS, NEG)
    return rounded(out, "pct_pos")


@query("incident_tests", S + KNOWN + "SELECT " + SUMMARY.format(v="known") + " FROM t WHERE prev = 'F'")
def _(spark, d):
    return rounded(sequence.incident_tests(samples(spark, d), "id", ORDER, "known", POS, NEG), "pct_pos")


@query("incident_with_companion", S + KNOWN + "SELECT " + SUMMARY.format(v="second") + " FROM t WHERE prev = 'F' AND known = 'P'")
def _(spark, d):
    out = sequence.incident_with_companion(samples(spark, d), "id", ORDER, "known", "second", POS, NEG)
    return rounded(out, "pct_pos")


@query("baseline_negative_followup", S + """, ids AS (SELECT DISTINCT id FROM s WHERE visit = '1-URGENT' AND known = 'F'),
 f AS (SELECT * FROM s WHERE visit <> '1-URGENT' AND id IN (SELECT id FROM ids))
 SELECT (SELECT count(*) FROM ids) AS n_cohort, count(known) AS n_tests, count(*) FILTER (WHERE known = 'P') AS num_pos,
  count(*) FILTER (WHERE known = 'F') AS num_neg, round(avg(CAST(known = 'P' AS INT)), 9) AS pct_pos,
  count(DISTINCT id) FILTER (WHERE known IS NOT NULL) AS persons_tested, count(DISTINCT id) FILTER (WHERE known = 'P') AS persons_positive FROM f""")
def _(spark, d):
    out = sequence.followup_summary(samples(spark, d), "id", F.col("visit") == BASELINE, "known", POS, NEG)
    return rounded(out, "pct_pos")


@query("baseline_positive_exclusion", S + """SELECT second, count(*) AS n FROM s WHERE known = 'P' AND NOT EXISTS
 (SELECT 1 FROM s b WHERE b.id = s.id AND b.visit = '1-URGENT' AND b.known = 'P') GROUP BY second""")
def _(spark, d):
    rest = sequence.exclude_baseline_positive(samples(spark, d), "id", F.col("visit") == BASELINE, "known", POS)
    return describe.freq_filtered(rest, "second", F.col("known") == POS)


@query("always_never", S + """, g AS (SELECT id, count(*) AS n, bool_and(value = 'P') AS a, bool_and(value = 'F') AS b FROM s GROUP BY id)
 SELECT count(*) AS n_persons, count(*) FILTER (WHERE a) AS n_always, round(avg(a::INT), 9) AS pct_always,
  count(*) FILTER (WHERE b) AS n_never, round(avg(b::INT), 9) AS pct_never FROM g WHERE n > 1""")
def _(spark, d):
    out = sequence.always_never(samples(spark, d), "id", "value", POS, NEG)
    return rounded(out, "pct_always", "pct_never")


@query("initial_vs_later", S + """, r AS (SELECT * FROM s WHERE known IS NOT NULL AND ord IS NOT NULL),
 m AS (SELECT id, count(*) AS n, min(ord) AS first_ord, bool_and(known = 'P') OR bool_and(known = 'F') AS same FROM r GROUP BY id),
 f AS (SELECT m.id, m.n, m.same, count(*) AS tied, bool_or(r.known = 'P') AS initial FROM m JOIN r ON r.id = m.id AND r.ord = m.first_ord
  WHERE m.n > 1 GROUP BY ALL)
 SELECT count(*) FILTER (WHERE NOT same AND tied = 1 AND NOT initial) AS n_init_neg_later_pos,
  round(count(*) FILTER (WHERE NOT same AND tied = 1 AND NOT initial) / count(*), 9) AS pct_init_neg_later_pos,
  count(*) FILTER (WHERE NOT same AND tied = 1 AND initial) AS n_init_pos_later_neg,
  round(count(*) FILTER (WHERE NOT same AND tied = 1 AND initial) / count(*), 9) AS pct_init_pos_later_neg,
  count(*) FILTER (WHERE tied > 1) AS n_tied, count(*) AS n_persons FROM f""")
def _(spark, d):
    known = samples(spark, d).where("known IS NOT NULL AND ord IS NOT NULL")
    out = sequence.initial_vs_later(known, "id", "ord", "known", POS, NEG)
    return rounded(out, "pct_init_neg_later_pos", "pct_init_pos_later_neg")


@query("paired_agreement", S + """, t AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, ROW_NUMBER() OVER (PARTITION BY id ORDER BY day, k) AS i FROM s),
 p AS (SELECT id, max(known) FILTER (WHERE i = 1) AS swab_1, max(known) FILTER (WHERE i = 2) AS swab_2 FROM t WHERE n = 2 GROUP BY id)
 SELECT swab_1, swab_2, count(*) AS n FROM p WHERE swab_1 IS NOT NULL AND swab_2 IS NOT NULL GROUP BY swab_1, swab_2""")
def _(spark, d):
    return sequence.paired_agreement(samples(spark, d), "id", ORDER, "known")


@query("first_per_id_random", S + """SELECT id, k, value FROM (SELECT id, k, value, ROW_NUMBER() OVER (PARTITION BY id
 ORDER BY md5('0|' || CAST(id AS VARCHAR) || '|' || CAST(k AS VARCHAR))) AS i FROM s) WHERE i = 1""")
def _(spark, d):
    return sequence.one_random_row(samples(spark, d).select("id", "k", "value"), "id", ["k"], seed=0)


@query("duplicate_rows", S + "SELECT id, visit, k FROM (SELECT id, visit, k, ROW_NUMBER() OVER (PARTITION BY id, visit ORDER BY k) AS i FROM s) WHERE i > 1")
def _(spark, d):
    return sequence.repeated_rows(samples(spark, d), ["id", "visit"], "k").select("id", "visit", "k")
