"""Wide to long and back, presence audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwise.catalog.base import CELLS, C, S, QUESTIONS, WEEKS, answers, people, query, rounded, samples, sheet
from panelwise.operators import describe, reshape, sequence

ANSWER_COLUMNS = [f"F01_{w}_{q}" for w in WEEKS for q in QUESTIONS]


@query("unpivot_wide", CELLS + "SELECT id, key, value FROM long")
def _(spark, d):
    return reshape.unpivot_wide(sheet(spark, d), ["id"], ANSWER_COLUMNS)


@query("unpivot_measures", S + """SELECT k, 'known' AS measure, CAST(known = 'P' AS INT) AS value FROM s
 UNION ALL SELECT k, 'second', CAST(second = 'P' AS INT) FROM s""")
def _(spark, d):
    flags = samples(spark, d).select("k", *[(F.col(c) == "P").cast("int").alias(c) for c in ("known", "second")])
    return reshape.unpivot_measures(flags, ["k"], ["known", "second"])


@query("unpivot_summary", C + """, g AS (SELECT site, avg(bal_known) AS mean, quantile_cont(bal_known, 0.5) AS median FROM c GROUP BY site)
 SELECT site, 'mean' AS measure, round(mean, 6) AS value FROM g UNION ALL SELECT site, 'median', round(median, 6) FROM g""")
def _(spark, d):
    g = describe.group_moments(people(spark, d), ["site"], "bal_known").drop("sd", "n_known")
    g = g.withColumn("n", F.col("n").cast("double"))
    long = reshape.unpivot_measures(g, ["site"], ["mean", "median", "n"]).where("measure <> 'n'")
    return rounded(long, "value", digits=6)


@query("parse_key_visit", CELLS + "SELECT id, key, regexp_replace(key, '.*_(.*)_.*', '\\1') AS visit FROM long")
def _(spark, d):
    long = reshape.unpivot_wide(sheet(spark, d), ["id"], ANSWER_COLUMNS)
    return long.select("id", "key", reshape.visit_token("key").alias("visit"))


@query("parse_key_variable", CELLS + "SELECT id, key, regexp_replace(key, '.*([0-9]{2})', '') AS variable FROM long")
def _(spark, d):
    long = reshape.unpivot_wide(sheet(spark, d), ["id"], ANSWER_COLUMNS)
    return long.select("id", "key", reshape.variable_name("key").alias("variable"))


@query("parse_lab_key", S + """, w AS (SELECT id, 'ychromo' || lower(substr(visit, 3)) || t AS key FROM s, (VALUES (''), ('date')) v(t) WHERE visit IS NOT NULL)
 SELECT key, CASE WHEN contains(key, 'date') THEN 'date' ELSE 'value' END AS kind,
  regexp_replace(key, '^ychromo(.*?)(date)?$', '\\1') AS visit, count(*) AS n FROM w GROUP BY 1, 2, 3""")
def _(spark, d):
    stem = F.concat(F.lit("ychromo"), F.lower(F.substring("visit", 3, 99)))
    keys = samples(spark, d).where("visit IS NOT NULL").select(
        F.explode(F.array(stem, F.concat(stem, F.lit("date")))).alias("key"))
    return keys.groupBy("key", reshape.lab_kind("key").alias("kind"), reshape.lab_visit("key").alias("visit")).agg(
        F.count(F.lit(1)).alias("n"))


@query("strip_prefix", CELLS + "SELECT id, replace(key, 'F01_', '') AS key FROM long")
def _(spark, d):
    long = reshape.unpivot_wide(sheet(spark, d), ["id"], ANSWER_COLUMNS)
    return long.select("id", reshape.strip_prefix("key", "F01_").alias("key"))


PIVOT = CELLS + """SELECT id, visit, max(value) FILTER (WHERE variable = 'signup') AS signup, max(value) FILTER (WHERE variable = 'error') AS error,
 max(value) FILTER (WHERE variable = 'purchase') AS purchase, max(value) FILTER (WHERE variable = 'click') AS click,
 max(value) FILTER (WHERE variable = 'view') AS view FROM long GROUP BY id, visit"""


@query("pivot_long", PIVOT)
def _(spark, d):
    long = reshape.unpivot_wide(sheet(spark, d), ["id"], ANSWER_COLUMNS).select(
        "id", reshape.visit_token("key").alias("visit"), reshape.variable_name("key").alias("variable"), "value")
    return reshape.pivot_long(long, ["id", "visit"], list(QUESTIONS.values()))


@query("visits_from_wide", PIVOT)
def _(spark, d):
    wide = sheet(spark, d)
    return reshape.visits_from_wide(wide, ["id"], reshape.question_grid(ANSWER_COLUMNS))


@query("assert_unique_cells", CELLS + "SELECT id, visit, variable, count(*) AS n FROM a GROUP BY id, visit, variable HAVING count(*) > 1")
def _(spark, d):
    return reshape.duplicate_cells(answers(spark, d), ["id", "visit"])


@query("pivot_repeat", S + """, t AS (SELECT *, count(*) OVER (PARTITION BY id) AS n,
  ROW_NUMBER() OVER (PARTITION BY id ORDER BY day, k) AS i FROM s)
 SELECT id, max(value) FILTER (WHERE i = 1) AS swab_1, max(value) FILTER (WHERE i = 2) AS swab_2 FROM t WHERE n = 2 GROUP BY id""")
def _(spark, d):
    return sequence.pivot_repeat(samples(spark, d), "id", ["day", "k"], "value")


PRESENCE = CELLS + ", p AS (SELECT id, visit, CAST(count(value) > 0 AS INT) AS presence FROM long WHERE variable = 'view' GROUP BY id, visit) "


@query("presence_flags", PRESENCE + """SELECT id, max(presence) FILTER (WHERE visit = 'w1') AS presence_w1, max(presence) FILTER (WHERE visit = 'w2') AS presence_w2,
 max(presence) FILTER (WHERE visit = 'w3') AS presence_w3, max(presence) FILTER (WHERE visit = 'w4') AS presence_w4,
 max(presence) FILTER (WHERE visit = 'w5') AS presence_w5 FROM p GROUP BY id""")
def _(spark, d):
    wide = sheet(spark, d)
    dates = reshape.presence_columns(wide.columns, WEEKS, stem="view")
    return reshape.presence_flags(wide, dates).select("id", *[f"presence_{w}" for w in WEEKS])


@query("presence_summary", PRESENCE + """SELECT visit, CAST(sum(presence) AS BIGINT) AS present, CAST(sum(1 - presence) AS BIGINT) AS absent,
 count(*) AS total, round(avg(presence), 9) AS pct_present, round(avg(1 - presence), 9) AS pct_absent FROM p GROUP BY visit""")
def _(spark, d):
    wide = sheet(spark, d)
    rows = reshape.presence_long(wide, ["id"], reshape.presence_columns(wide.columns, WEEKS, stem="view"))
    return rounded(describe.presence_summary(rows, "visit"), "pct_present", "pct_absent")


@query("all_missing_rows", CELLS + "SELECT count(*) AS n_all_missing FROM (SELECT id, visit FROM long GROUP BY id, visit HAVING count(value) = 0)")
def _(spark, d):
    rows = reshape.visits_from_wide(sheet(spark, d), ["id"], reshape.question_grid(ANSWER_COLUMNS))
    return describe.all_missing(rows, list(QUESTIONS.values()))
