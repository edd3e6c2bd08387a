"""The study's regression models and its one-row screen on the derived sheet.

Models with one or two columns have SQL with their iterations unrolled. Adjusted models and those of factors with several
levels have none: tests compare them with the matrix form of the estimating equations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwise.catalog.base import query, rounded, tail_sql
from panelwise.catalog.models import OUT, coef_rows, gee_sql
from panelwise.catalog.whole import STUDY, study_sheet
from panelwise.plans import prep, reports
from panelwise.session import shared_folder, written
from panelwise.sources.tables import read_tables, write_tables

MONTH = "CASE visit WHEN 'scr' THEN 0 WHEN 'm1' THEN 1 WHEN 'm3' THEN 3 WHEN 'm6' THEN 6 WHEN 'm9' THEN 9 ELSE 12 END"
ROWS = STUDY + f""", l AS (SELECT *, id AS cl, {MONTH} AS month, CAST(value = 'P' AS INT) AS yc, 1 - always_client AS not_client, 1 - always_main AS not_main,
  1 - used_client AS not_used, CAST(reports_client = 1 OR reports_main = 1 AS INT) AS reports_either FROM f) """
NOTHING = "SELECT '{m}', t, NULL, NULL, NULL, 0, 0, NULL, NULL FROM (VALUES ('(Intercept)'), ('{t}')) x(t)"


def _study(spark, d) -> prep.Study:
    """The four analysis tables, written once: a fit reads them in every pass."""
    study, folder = prep.prepare(study_sheet(spark, d)), shared_folder(spark)
    names = ("baseline", "behaviour", "sti", "swab")
    write_tables({n: getattr(study, n) for n in names}, folder)
    return prep.Study(*(read_tables(spark, folder)[n] for n in names))


def _rounded(df):
    return rounded(df.select(*OUT), "estimate", "std_error", "p_value", "alpha", "phi", digits=6)


def _trend(name: str, y: str | None, link: str) -> str:
    if y is None:
        return NOTHING.format(m=f"trend:{name}", t="visit_num")
    return coef_rows(gee_sql(y, "month", link), f"trend:{name}", "visit_num")


@query("study_trends_unadjusted", ROWS + " UNION ALL ".join([
    _trend("NbreClieDernSemaine", "clients", "gaussian"), _trend("not_always_condom_client", "not_client", "logit"),
    _trend("not_always_condom_main", "not_main", "logit"), _trend("not_used_condom_recent_client", "not_used", "logit"),
    _trend("yc_result", "yc", "logit"), _trend("not_used_condom_recent_main", None, "logit"),
]))
def _(spark, d):
    return _rounded(reports.trends(_study(spark, d), adjusted=False, tol=1e-10))


@query("study_trends")
def _(spark, d):
    """Six adjusted trends: month, age, ethnic group and schooling."""
    return _rounded(reports.trends(_study(spark, d), tol=1e-10))


@query("study_log_trends", ROWS + coef_rows(gee_sql("yc", "month", "log", where="value IS NOT NULL"), "visit_num", "visit_num"))
def _(spark, d):
    return _rounded(reports.log_trends(_study(spark, d), only=("gee",), tol=1e-10)["gee"])


@query("study_log_partner", ROWS + coef_rows(gee_sql("yc", "reports_main", "log", where="value IS NOT NULL"), "reports_main_partner", "reports_main_partner"))
def _(spark, d):
    return _rounded(reports.log_trends(_study(spark, d), only=("gee_partner",), tol=1e-10)["gee_partner"])


#: The derived sheet answers the other questions from the result itself, so their models have no finite coefficients.
BEHAVIOUR = {
    "reports_client": ("reports_client", "logit"), "reports_main_partner": ("reports_main", "logit"), "reports_either": ("reports_either", "logit"),
    "not_always_condom_client": ("not_client", "logit"), "not_used_condom_recent_client": ("not_used", "logit"), "NbreClieDernSemaine": ("clients", "gaussian"),
}


@query("study_behaviour_predictors", ROWS + " UNION ALL ".join(coef_rows(gee_sql("yc", x, link), m, m) for m, (x, link) in BEHAVIOUR.items()))
def _(spark, d):
    out = reports.behaviour_predictors(_study(spark, d), tol=1e-10)
    return _rounded(out.where(F.col("model").isin(*BEHAVIOUR)))


@query("study_masked_predictor", ROWS + coef_rows(gee_sql("yc", "not_client", "logit", where="has_partner"), "not_always_condom_client", "not_always_condom_client"))
def _(spark, d):
    """A predictor among those with a main partner only."""
    from panelwise.operators import gee

    rows = _study(spark, d).behaviour
    return _rounded(gee.predictor_screen(rows, "yc_result", ["not_always_condom_client"], "id", {"not_always_condom_client": F.col("has_partner")}, tol=1e-10))


@query("study_baseline_predictors")
def _(spark, d):
    """Univariate clustered models of detection on age, registration, ethnic group, schooling and site."""
    return _rounded(reports.baseline_predictors(_study(spark, d), tol=1e-10))


# ---------------------------------------------------------------- one random row a person

SITE = "CASE substr(CAST(id AS VARCHAR), 1, 1) WHEN '2' THEN 'Pikine' WHEN '3' THEN 'Mbao' WHEN '4' THEN 'Rifisque' WHEN '5' THEN 'Diamniado' ELSE substr(CAST(id AS VARCHAR), 1, 1) END"
ONE = STUDY + f""", q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY md5('0|' || CAST(id AS VARCHAR) || '|' || visit || '|' || {SITE})) AS i FROM b WHERE value IS NOT NULL),
 one AS (SELECT q.id, {SITE.replace('(id AS', '(q.id AS')} AS site, CAST(q.value = 'P' AS INT) AS pos, q.clients, q.always_client,
  CASE WHEN q.mx < 150000 THEN 0 ELSE CAST(q.has_partner AS INT) END AS reports_main,
  CASE WHEN age > 17 AND age <= 29 THEN '<30' WHEN age > 29 AND age <= 39 THEN '30-39' WHEN age > 39 AND age <= 49 THEN '40-49' WHEN age > 49 THEN '50+' END AS age_cat,
  CASE WHEN c_nationkey < 9 THEN 'Yes' WHEN c_nationkey < 18 THEN 'No' END AS registered,
  CASE c_nationkey % 4 WHEN 1 THEN 'Primary' WHEN 2 THEN 'Secondary' ELSE 'None' END AS edu
  FROM q JOIN (SELECT c_custkey, c_nationkey, trunc(18 + (c_acctbal + 1000) / 250) AS age FROM customer) c ON c.c_custkey = q.id WHERE i = 1),
 u AS (SELECT 'site' AS variable, site AS level, pos FROM one UNION ALL SELECT 'age_cat', age_cat, pos FROM one UNION ALL SELECT 'registered', registered, pos FROM one
  UNION ALL SELECT 'edu', edu, pos FROM one UNION ALL SELECT 'reports_main_partner', CAST(reports_main AS VARCHAR), pos FROM one) """
ONE_ROW = ("site", "age_cat", "registered", "edu", "reports_main_partner")


def _one_row(spark, d):
    """The rows of the one-row screen. The sheet and they are written once: a test or a pass of a fit reads few columns and repeats no join."""
    return written(reports.one_row_frame(prep.prepare(written(study_sheet(spark, d)))))


@query("study_one_row_rates", ONE + "SELECT variable, level, sum(pos) AS num_pos, count(*) AS n, round(sum(pos) / count(*), 9) AS pct FROM u GROUP BY variable, level")
def _(spark, d):
    out = reports.screen_rows(_one_row(spark, d), ("rates",))["rates"]
    return rounded(out.where(F.col("variable").isin(*ONE_ROW)).select("variable", "level", F.col("num_pos").cast("bigint").alias("num_pos"), "n", "pct"), "pct")


CHI = """, c AS (SELECT variable AS test, level AS row, pos AS col, count(*)::DOUBLE AS n FROM u WHERE level IS NOT NULL AND variable IN ('site', 'age_cat', 'registered') GROUP BY ALL),
 r AS (SELECT test, row, sum(n) AS r FROM c GROUP BY ALL), k AS (SELECT test, col, sum(n) AS k FROM c GROUP BY ALL), t AS (SELECT test, sum(n) AS t, count(DISTINCT row) AS nr FROM c GROUP BY test),
 e AS (SELECT r.test, nr, t, r * k / t AS e, coalesce(c.n, 0) AS n FROM r JOIN k USING (test) JOIN t USING (test) LEFT JOIN c ON c.test = r.test AND c.row = r.row AND c.col = k.col),
 s AS (SELECT test, max(nr) - 1 AS df, CAST(max(t) AS BIGINT) AS n, sum(pow(CASE WHEN nr = 2 THEN greatest(abs(n - e) - 0.5, 0) ELSE abs(n - e) END, 2) / e) AS st FROM e GROUP BY test)
 SELECT test, round(st, 6) AS statistic, CAST(df AS INT) AS df, n, round(""" + tail_sql("st / 2", "df / 2.0") + ", 9) AS p_value FROM s"


@query("study_one_row_chisq", ONE + CHI)
def _(spark, d):
    out = reports.screen_rows(_one_row(spark, d), ("chisq",))["chisq"]
    return rounded(rounded(out.where("test IN ('site', 'age_cat', 'registered')"), "statistic", digits=6), "p_value")


@query("study_one_row_fisher")
def _(spark, d):
    return rounded(reports.screen_rows(_one_row(spark, d), ("fisher",))["fisher"], "p_value")


GROUPS = """SELECT variable AS model, level, count(*)::DOUBLE AS n, sum(pos)::DOUBLE AS y FROM u WHERE level IS NOT NULL AND variable IN ('registered', 'edu') GROUP BY ALL"""


@query("study_one_row_glm", ONE + f""", gr AS ({GROUPS}), z AS (SELECT model, n AS n0, y AS y0 FROM gr WHERE level IN ('No', 'None')),
 o AS (SELECT model, '(Intercept)' AS term, ln(y0 / (n0 - y0)) AS est, sqrt(1 / y0 + 1 / (n0 - y0)) AS se FROM z
  UNION ALL SELECT model, model || level, ln(y / (n - y)) - ln(y0 / (n0 - y0)), sqrt(1 / y + 1 / (n - y) + 1 / y0 + 1 / (n0 - y0)) FROM gr JOIN z USING (model) WHERE level NOT IN ('No', 'None'))
 SELECT model, term, round(est, 6) AS estimate, round(se, 6) AS std_error FROM o""")
def _(spark, d):
    out = reports.screen_rows(_one_row(spark, d), ("glm",), tol=1e-13)["glm"].where("model IN ('registered', 'edu')")
    return rounded(out.select("model", "term", "estimate", "std_error"), "estimate", "std_error", digits=6)
