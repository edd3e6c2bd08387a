"""The study plans on a sheet that Spark derives from customers and orders.

A customer is a participant; its orders of one priority are the answers of one
visit, and the lowest priority serves for two visits by parity of the order key.
Every order counts. The derived sheet has the study's own column names, so preparation and
reports run exactly as on a real sheet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.catalog.base import query, rounded, table
from panelwise.catalog.describing import WILSON, Z
from panelwise.plans import prep, reports
from panelwise.plans import values as v

RAW = {"j0": "scr", "m1": "m1", "m3": "m3", "m6": "m6", "m9": "m9", "m12": "m12"}
LAB = {visit: visit for visit in RAW.values()}


def study_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer, study columns as text; one aggregation and one join."""
    orders, price = table(spark, folder, "orders"), F.col("o_totalprice")
    aggs = []
    code, even = F.col("o_orderpriority"), F.col("o_orderkey") % 2 == 0
    visit_of = (
        F.when(code == "1-URGENT", "scr").when(code == "2-HIGH", "m1").when(code == "3-MEDIUM", "m3")
        .when(code == "4-NOT SPECIFIED", "m6").when(even, "m9").otherwise("m12")
    )
    orders = orders.withColumn("visit", visit_of)
    for visit in RAW.values():
        hit = F.col("visit") == visit
        aggs += [
            F.count_if(hit).alias(f"n {visit}"),
            F.max(F.when(hit, price)).alias(f"mx {visit}"),
            F.max(F.when(hit, F.ascii("o_orderstatus"))).alias(f"st {visit}"),
        ]
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(*aggs)
    people = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    wide = people.join(per, "c_custkey", "left")
    cols = [
        F.col("c_custkey").alias(v.ID),
        (18 + (F.col("c_acctbal") + 1000) / 250).cast("int").cast("string").alias(v.AGE),
        F.col("c_nationkey").cast("string").alias(v.ETHNIC),
        F.when(F.col("c_nationkey") == 20, v.ETHNIC_OVERRIDE[0]).alias(v.ETHNIC_OTHER),
        F.when(F.col("c_nationkey") < 9, "1").when(F.col("c_nationkey") < 18, "2").alias(v.REGISTERED),
        F.when(F.col("c_nationkey") % 4 < 3, (F.col("c_nationkey") % 4).cast("string")).alias(v.SCHOOLING),
        F.when(F.col("c_acctbal") >= 0, "d").alias(v.ENROLMENT_DATE),
    ]
    for token, visit in RAW.items():
        n, mx, st = (F.col(f"{p} {visit}") for p in ("n", "mx", "st"))
        none = F.lit(None).cast("string")
        cols += [
            F.when(n >= 4, "REFUS").when(n == 1, "OO").when(n > 0, n.cast("string")).alias(f"F14_{token}_q03NbreClieDernSemaine"),
            F.when(mx >= 300000, v.ALWAYS).when(mx >= 100000, "parfois").alias(f"F14_{token}_q05FreqUtilPreservatif"),
            F.when(mx < 150000, v.NO).when(mx >= 150000, v.YES).alias(f"F14_{token}_q11PartenaireSexPrinc"),
            F.when(n > 0, (n - 1).cast("string")).otherwise(none).alias(f"F14_{token}_q13NbrePartMoisDernier"),
            F.when(st == ord("P"), v.ALWAYS).when(st == ord("F"), v.NEVER).alias(f"F14_{token}_q15FreqUtilervatifPart"),
            F.when(n > 1, F.when(mx >= 200000, v.YES).otherwise(v.NO)).alias(f"F14_{token}_q04UtiliseUnPresevatif"),
            F.when(st == ord("O"), v.STI_POSITIVE).when(st == ord("F"), v.STI_NEGATIVE).alias(f"F20_{token}_q06aResultatRPR"),
        ]
    for token, visit in LAB.items():
        st = F.col(f"st {visit}")
        cols.append(F.when(st == ord("P"), "P").when(st == ord("F"), "N").when(st == ord("O"), "U").alias(f"ychromo{token}"))
    return wide.select(*cols)


STUDY = """WITH g AS (SELECT o_custkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'scr' WHEN '2-HIGH' THEN 'm1' WHEN '3-MEDIUM' THEN 'm3'
   WHEN '4-NOT SPECIFIED' THEN 'm6' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'm9' ELSE 'm12' END END AS visit,
  count(*) AS n, max(o_totalprice) AS mx, max(o_orderstatus) AS st FROM orders GROUP BY 1, 2),
 p AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0),
 b AS (SELECT p.id, t.visit, g.n, g.mx, CASE g.st WHEN 'P' THEN 'P' WHEN 'F' THEN 'N' END AS value,
  CASE WHEN n < 4 THEN CASE n WHEN 1 THEN 0 ELSE n END END AS clients, g.n - 1 > 0 AS has_partner,
  CASE WHEN mx >= 100000 THEN CAST(mx >= 300000 AS INT) END AS always_client,
  CASE g.st WHEN 'P' THEN 1 WHEN 'F' THEN 0 END AS always_main, CASE WHEN n > 1 THEN CAST(mx >= 200000 AS INT) END AS used_client,
  CASE g.st WHEN 'O' THEN 'positif' WHEN 'F' THEN 'negatif' END AS rpr
  FROM p CROSS JOIN (VALUES ('scr'), ('m1'), ('m3'), ('m6'), ('m9'), ('m12')) t(visit) LEFT JOIN g ON g.id = p.id AND g.visit = t.visit),
 f AS (SELECT *, CAST(clients > 0 AS INT) AS reports_client, CASE WHEN mx < 150000 THEN 0 ELSE CAST(has_partner AS INT) END AS reports_main FROM b)
"""


@query("study_visits", STUDY + """SELECT id, visit, CAST(clients AS INT) AS clients, value, CAST(value = 'P' AS INT) AS yc_result, always_client, always_main,
 CAST(always_client = 1 AND always_main = 1 AS INT) AS always_both, reports_client, reports_main,
 CAST(reports_client = 1 OR reports_main = 1 AS INT) AS reports_either FROM f""")
def _(spark, d):
    rows = prep.prepare(study_sheet(spark, d)).behaviour
    names = {
        "NbreClieDernSemaine": "clients", "always_condom_client": "always_client", "always_condom_main": "always_main",
        "always_condom_both": "always_both", "reports_main_partner": "reports_main",
    }
    keep = ["id", "visit", "value", "yc_result", "reports_client", "reports_either"]
    return rows.select(*keep, *[F.col(c).alias(a) for c, a in names.items()])


TWO = {
    "reports_client": ("reports_client", ""), "reports_main_partner": ("reports_main", ""),
    "reports_either": ("CAST(reports_client = 1 OR reports_main = 1 AS INT)", ""), "always_condom_client": ("always_client", ""),
    "always_condom_main": ("always_main", " AND has_partner"),
    "always_condom_both": ("CAST(always_client = 1 AND always_main = 1 AS INT)", " AND has_partner"),
    "used_condom_recent_client": ("used_client", ""), "used_condom_recent_main": ("NULL", " AND has_partner"),
    "used_condom_recent_both": ("CASE WHEN used_client = 0 THEN 0 END", " AND has_partner"),
}


@query("study_table_two", STUDY + ", u AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS variable, CAST({e} AS VARCHAR) AS level, value FROM f WHERE value IS NOT NULL{w}" for k, (e, w) in TWO.items()
) + """) SELECT variable, level, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY variable, level), 9) AS pct
 FROM u GROUP BY variable, level, value""")
def _(spark, d):
    return rounded(reports.table_two(prep.prepare(study_sheet(spark, d))), "pct")


@query("study_persons", STUDY + f""", q AS (SELECT id, bool_or(value = 'P') AS pos FROM b WHERE value IS NOT NULL GROUP BY id),
 w AS (SELECT count(*) FILTER (WHERE pos) AS num_positive, count(*)::DOUBLE AS nd FROM q)
 SELECT num_positive, round(num_positive / nd, 9) AS pct, CAST(nd AS BIGINT) AS n, {WILSON.format(x='num_positive', n='nd')} FROM w, {Z}""")
def _(spark, d):
    out = reports.text_results(prep.prepare(study_sheet(spark, d)))["persons"]
    return rounded(out.select("num_positive", "pct", "n", "lower", "upper"), "pct", "lower", "upper")


@query("study_figure_clients", STUDY + """SELECT visit, round(avg(clients), 9) AS mean, round(quantile_cont(clients::DOUBLE, 0.5), 9) AS median,
 round(stddev_samp(clients), 9) AS sd, count(*) AS n, round(avg(clients) - 1.96::DOUBLE * stddev_samp(clients) / sqrt(count(*)), 9) AS lower,
 round(avg(clients) + 1.96::DOUBLE * stddev_samp(clients) / sqrt(count(*)), 9) AS upper FROM f GROUP BY visit""")
def _(spark, d):
    out = reports.figure_clients(prep.prepare(study_sheet(spark, d)))
    return rounded(out.select("visit", "mean", "median", "sd", "n", "lower", "upper"), "mean", "median", "sd", "lower", "upper")


@query("study_incident_rpr", STUDY + """, t AS (SELECT *, lag(rpr) OVER (PARTITION BY id ORDER BY CASE visit WHEN 'scr' THEN 1 WHEN 'm1' THEN 2 WHEN 'm3' THEN 3 WHEN 'm6' THEN 4 WHEN 'm9' THEN 5 ELSE 6 END) AS prev
  FROM b WHERE rpr IS NOT NULL)
 SELECT count(*) AS n, count(*) FILTER (WHERE rpr = 'positif') AS num_pos, count(*) FILTER (WHERE rpr = 'negatif') AS num_neg,
  round(avg(CAST(rpr = 'positif' AS INT)), 9) AS pct_pos FROM t WHERE prev = 'negatif'""")
def _(spark, d):
    from panelwise.operators import sequence

    sti = prep.prepare(study_sheet(spark, d)).sti
    out = sequence.incident_tests(sti, "id", ["visit_ord", "visit"], "aResultatRPR", v.STI_POSITIVE, v.STI_NEGATIVE)
    return rounded(out, "pct_pos")


SAMPLES = STUDY + ", sw AS (SELECT *, count(*) OVER (PARTITION BY id) AS k FROM b WHERE value IS NOT NULL) "


@query("study_pairs_by_visit", SAMPLES + """SELECT visit, count(*) AS n, count(*) FILTER (WHERE value = 'P') AS num_pos, count(*) FILTER (WHERE value = 'N') AS num_neg
 FROM sw WHERE k = 2 GROUP BY visit""")
def _(spark, d):
    return reports.repeated_samples(prep.prepare(study_sheet(spark, d)))["pairs_by_visit"]


@query("study_three_samples", SAMPLES + """SELECT id, CAST(ROW_NUMBER() OVER (PARTITION BY id ORDER BY CASE visit WHEN 'scr' THEN 1 WHEN 'm1' THEN 2 WHEN 'm3' THEN 3
 WHEN 'm6' THEN 4 WHEN 'm9' THEN 5 ELSE 6 END) AS DOUBLE) AS swab_num, value FROM sw WHERE k = 3""")
def _(spark, d):
    return reports.repeated_samples(prep.prepare(study_sheet(spark, d)))["three_samples"]


@query("study_demographics", """SELECT c_custkey AS id, CASE substr(CAST(c_custkey AS VARCHAR), 1, 1) WHEN '2' THEN 'Pikine' WHEN '3' THEN 'Mbao' WHEN '4' THEN 'Rifisque'
  WHEN '5' THEN 'Diamniado' ELSE substr(CAST(c_custkey AS VARCHAR), 1, 1) END AS site,
 CASE WHEN age > 17 AND age <= 29 THEN '<30' WHEN age > 29 AND age <= 39 THEN '30-39' WHEN age > 39 AND age <= 49 THEN '40-49' WHEN age > 49 THEN '50+' END AS age_cat,
 CASE WHEN c_nationkey < 9 THEN 'Yes' WHEN c_nationkey < 18 THEN 'No' END AS registered,
 CASE c_nationkey WHEN 1 THEN 'Wolof' WHEN 2 THEN 'Poulaar' WHEN 3 THEN 'Serere' WHEN 4 THEN 'Mandingue' WHEN 5 THEN 'Other' WHEN 6 THEN 'Other'
  WHEN 7 THEN 'Other' WHEN 8 THEN 'Other' WHEN 20 THEN 'Other' END AS ethnic_group_cat,
 CASE c_nationkey % 4 WHEN 1 THEN 'Primary' WHEN 2 THEN 'Secondary' ELSE 'None' END AS edu
 FROM (SELECT *, trunc(18 + (c_acctbal + 1000) / 250) AS age FROM customer) WHERE c_acctbal >= 0""")
def _(spark, d):
    base = prep.prepare(study_sheet(spark, d)).baseline
    return base.select(F.col(v.ID).alias("id"), "site", "age_cat", "registered", "ethnic_group_cat", "edu")
