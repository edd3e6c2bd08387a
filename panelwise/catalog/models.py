"""Regression models on clustered rows, with iterations unrolled in SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.catalog.base import L, lines, query, rounded, tail_sql
from panelwise.functions.intervals import coef_interval
from panelwise.operators import design, gee, glm
from panelwise.operators.design import Factor, Model, WideFactor
from panelwise.operators.joins import keep_ids

# Mean, row scale and residual scale of a cell, given the linear predictor.
LINKS = {
    "gaussian": ("e", "1.0::DOUBLE", "1.0::DOUBLE"),
    "logit": ("1 / (1 + exp(-e))", "sqrt(m * (1 - m))", "1 / sqrt(m * (1 - m))"),
    "log": ("exp(e)", "sqrt(m / (1 - m))", "1 / sqrt(m * (1 - m))"),
}
START = {"gaussian": "sum(y) / sum(n)", "logit": "ln((sum(y) / sum(n)) / (1 - sum(y) / sum(n)))", "log": "ln(sum(y) / sum(n))"}


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(p) for b in range(a, p)]


def _inverse(p: int) -> str:
    """Columns ``i<a><b>`` of the inverse of the symmetric matrix ``g<a><b>`` (two or three rows)."""
    def g(a, b):
        return f"g{min(a, b)}{max(a, b)}"

    def cofactor(a, b):
        rows, cols = [x for x in range(p) if x != a], [x for x in range(p) if x != b]
        sign = "" if (a + b) % 2 == 0 else "-"
        if p == 2:
            return f"{sign}({g(rows[0], cols[0])})"
        return f"{sign}({g(rows[0], cols[0])} * {g(rows[1], cols[1])} - {g(rows[0], cols[1])} * {g(rows[1], cols[0])})"

    det = " + ".join(f"{g(0, b)} * ({cofactor(0, b)})" for b in range(p))
    return ", ".join(f"({cofactor(a, b)}) / ({det}) AS i{a}{b}" for a, b in _pairs(p))


def _dot(p: int, a: int, vec: str) -> str:
    return " + ".join(f"i{min(a, b)}{max(a, b)} * {vec}{b}" for b in range(p))


def _cluster_sums(link: str, source: str, p: int) -> str:
    """Sums per cluster at the coefficients that ``source`` carries."""
    mean, z, ef = LINKS[link]
    bs = ", ".join(f"b{j}" for j in range(p))
    eta = " + ".join(f"b{j} * x{j}" for j in range(p))
    sums = ", ".join(
        [f"sum(n * z * z * x{a} * x{b}) AS h{a}{b}" for a, b in _pairs(p)]
        + [f"sum(n * z * x{a}) AS s{a}, sum(z * f * (y - n * m) * x{a}) AS t{a}" for a in range(p)]
    )
    return f"""(SELECT i, {bs}, al, c, sum(n) AS n, {sums},
   sum(f * (y - n * m)) AS se, sum(f * f * (q - 2 * m * y + n * m * m)) AS ee
  FROM (SELECT *, {z} AS z, {ef} AS f FROM (SELECT *, {mean} AS m FROM (SELECT *, {eta} AS e FROM {source}, k))) GROUP BY i, {bs}, al, c)"""


def _equation_sums(link: str, source: str, p: int) -> str:
    bs = ", ".join(f"b{j}" for j in range(p))
    sums = ", ".join(
        [f"sum(h{a}{b} - w * s{a} * s{b}) AS g{a}{b}" for a, b in _pairs(p)]
        + [f"sum((t{a} - w * s{a} * se) * (t{b} - w * s{b} * se)) AS m{a}{b}" for a, b in _pairs(p)]
        + [f"sum(t{a} - w * s{a} * se) AS u{a}" for a in range(p)]
    )
    return f"""(SELECT *, {_inverse(p)} FROM (SELECT i, {bs}, al, {sums},
  sum(ee) / sum(n) AS phi, sum((se * se - ee) / 2) / (sum(ee) / sum(n) * sum(n * (n - 1) / 2)) AS new_al, sum(n) AS n, count(*) AS nc
 FROM (SELECT *, al / (1 + (n - 1) * al) AS w FROM {_cluster_sums(link, source, p)}) GROUP BY i, {bs}, al))"""


def gee_sql(y: str, xs: str | tuple, link: str, where: str = "true", cluster: str = "cl", steps: int = 25) -> str:
    """Exchangeable fit with one or two predictors as a recursive query; coefficients b and errors se."""
    xs = (xs,) if isinstance(xs, str) else xs
    p = len(xs) + 1
    cols = ", ".join(f"({x})::DOUBLE AS x{j}" for j, x in enumerate(xs, 1))
    known = " AND ".join(f"({x}) IS NOT NULL" for x in (*xs, y))
    bs = ", ".join(f"b{j}" for j in range(p))
    update = ", ".join(f"b{a} + {_dot(p, a, 'u')}" for a in range(p))

    def variance(a: int) -> str:
        def inv(r, c):
            return f"i{min(r, c)}{max(r, c)}"

        return " + ".join(
            f"{inv(a, r)} * m{min(r, c)}{max(r, c)} * {inv(c, a)}" for r in range(p) for c in range(p)
        )

    ses = ", ".join(f"sqrt({variance(a)}) AS se{a}" for a in range(p))
    return f"""(WITH RECURSIVE k AS (SELECT {cluster} AS c, 1.0::DOUBLE AS x0, {cols}, count(*)::DOUBLE AS n, sum(({y})::DOUBLE) AS y,
   sum(({y})::DOUBLE * ({y})::DOUBLE) AS q FROM l WHERE ({where}) AND {known} GROUP BY ALL),
  it(i, {bs}, al) AS (SELECT 0, {START[link]}, {", ".join(["0.0::DOUBLE"] * p)} FROM k
   UNION ALL SELECT i + 1, {update}, new_al FROM {_equation_sums(link, 'it', p)} WHERE i < {steps}),
  done AS (SELECT * FROM it WHERE i = {steps})
  SELECT *, {ses} FROM {_equation_sums(link, 'done', p)})"""


def coef_rows(fit: str, model: str, terms: str | tuple) -> str:
    """One row per coefficient of a fitted model."""
    terms = ("(Intercept)", *((terms,) if isinstance(terms, str) else terms))
    est = "CASE t.j " + " ".join(f"WHEN {j} THEN b{j}" for j in range(len(terms))) + " END"
    se = "CASE t.j " + " ".join(f"WHEN {j} THEN se{j}" for j in range(len(terms))) + " END"
    names = ", ".join(f"({j}, '{t}')" for j, t in enumerate(terms))
    return f"""SELECT '{model}' AS model, t.term, round({est}, 6) AS estimate, round({se}, 6) AS std_error,
  round({tail_sql(f'pow(({est}) / ({se}), 2) / 2')}, 6) AS p_value,
  CAST(n AS BIGINT) AS n, nc AS n_clusters, round(al, 6) AS alpha, round(phi, 6) AS phi
 FROM {fit} f, (VALUES {names}) t(j, term)"""


HEAD = f"WITH l AS ({L}) "
OUT = ("model", "term", "estimate", "std_error", "p_value", "n", "n_clusters", "alpha", "phi")


def _gee_out(df: DataFrame) -> DataFrame:
    return rounded(df.select(*OUT), "estimate", "std_error", "p_value", "alpha", "phi", digits=6)


@query("gee_gaussian", HEAD + coef_rows(gee_sql("qty", "o", "gaussian"), "qty", "o"))
def _(spark, d):
    return _gee_out(gee.fit_gee(lines(spark, d), Model("qty", "qty", ("o",), "gaussian", "identity"), "cl", tol=1e-10))


_PLAIN = coef_rows(gee_sql("qty", "o", "gaussian"), "qty", "o")


@query("gee_gaussian_shifted", HEAD + f"SELECT 'shifted' AS model, 'x' AS term, estimate, std_error, p_value, n, n_clusters, alpha, phi FROM ({_PLAIN}) WHERE term = 'o'")
def _(spark, d):
    moved = lines(spark, d).withColumns({"x": F.col("o") + 202000, "z": F.col("qty") + 1e9})
    return _gee_out(gee.fit_gee(moved, Model("shifted", "z", ("x",), "gaussian", "identity"), "cl", tol=1e-10).where("term = 'x'"))


@query("gee_logit", HEAD + coef_rows(gee_sql("y", "o", "logit"), "y", "o"))
def _(spark, d):
    return _gee_out(gee.fit_gee(lines(spark, d), Model("y", "y", ("o",)), "cl", tol=1e-10))


@query("gee_log", HEAD + coef_rows(gee_sql("y", "o", "log"), "y", "o"))
def _(spark, d):
    return _gee_out(gee.fit_gee(lines(spark, d), Model("y", "y", ("o",), "binomial", "log"), "cl", tol=1e-10))


@query("trend_test", HEAD + " UNION ALL ".join(
    f"SELECT * FROM ({coef_rows(gee_sql(y, 'no', link, cluster='ok'), 'trend:' + y, 'no')}) WHERE term = 'no'"
    for y, link in (("y", "logit"), ("qty", "gaussian"))))
def _(spark, d):
    out = gee.trend_test(lines(spark, d), [("y", "binomial"), ("qty", "gaussian")], "no", "ok", tol=1e-10)
    return _gee_out(out)


@query("trend_test_adjusted", HEAD + " UNION ALL ".join(
    f"SELECT * FROM ({coef_rows(gee_sql(y, ('no', 'o'), link), 'trend:' + y, ('no', 'statusO'))}) WHERE term = 'no'"
    for y, link in (("y", "logit"), ("qty", "gaussian"))))
def _(spark, d):
    adjust = (Factor("status", ("F", "O")),)
    out = gee.trend_test(lines(spark, d), [("y", "binomial"), ("qty", "gaussian")], "no", "cl", adjust, tol=1e-10)
    return _gee_out(out)


@query("predictor_screen", HEAD + " UNION ALL ".join([
    coef_rows(gee_sql("y", "o", "logit"), "o", "o"),
    coef_rows(gee_sql("y", "disc", "logit"), "disc", "disc"),
    coef_rows(gee_sql("y", "qty", "logit", where="disc > 2"), "qty", "qty"),
]))
def _(spark, d):
    out = gee.predictor_screen(lines(spark, d), "y", ["o", "disc", "qty"], "cl", {"qty": F.col("disc") > 2}, tol=1e-10)
    return _gee_out(out)


# ---------------------------------------------------------------- independent rows

G = HEAD + """, g AS (SELECT flag, count(*)::DOUBLE AS n, sum(o)::DOUBLE AS y FROM l GROUP BY flag),
 b AS (SELECT max(n) FILTER (WHERE flag = 'A') AS n0, max(y) FILTER (WHERE flag = 'A') AS y0 FROM g),
 logit AS (SELECT '(Intercept)' AS term, ln(y0 / (n0 - y0)) AS est, sqrt(1 / y0 + 1 / (n0 - y0)) AS se FROM b
  UNION ALL SELECT 'flag' || flag, ln(y / (n - y)) - ln(y0 / (n0 - y0)), sqrt(1 / y + 1 / (n - y) + 1 / y0 + 1 / (n0 - y0)) FROM g, b WHERE flag <> 'A'),
 lg AS (SELECT '(Intercept)' AS term, ln(y0 / n0) AS est, sqrt((1 - y0 / n0) / y0) AS se FROM b
  UNION ALL SELECT 'flag' || flag, ln(y / n) - ln(y0 / n0), sqrt((1 - y / n) / y + (1 - y0 / n0) / y0) FROM g, b WHERE flag <> 'A') """
FLAG = Factor("flag", ("A", "N", "R"))


@query("design_matrix", HEAD + """SELECT 1.0::DOUBLE AS x0, qty AS x1, CAST(flag = 'N' AS DOUBLE) AS x2, CAST(flag = 'R' AS DOUBLE) AS x3,
 count(*)::DOUBLE AS n, sum(o)::DOUBLE AS sy FROM l GROUP BY ALL""")
def _(spark, d):
    cells = design.cells(lines(spark, d), [Model("m", "o", ("qty", FLAG))])
    return cells.select("x0", "x1", "x2", "x3", "n", "sy")


@query("glm_logit", G + f"""SELECT term, round(est, 6) AS estimate, round(se, 6) AS std_error, round(est / se, 6) AS statistic,
 round({tail_sql('pow(est / se, 2) / 2')}, 6) AS p_value FROM logit""")
def _(spark, d):
    out = glm.fit_glm(lines(spark, d), Model("m", "o", (FLAG,)), tol=1e-13)
    return rounded(out.select("term", "estimate", "std_error", "statistic", "p_value"),
                   "estimate", "std_error", "statistic", "p_value", digits=6)


@query("glm_log", G + "SELECT term, round(est, 6) AS estimate, round(se, 6) AS std_error FROM lg")
def _(spark, d):
    out = glm.fit_glm(lines(spark, d), Model("m", "o", (FLAG,), "binomial", "log"), tol=1e-13)
    return rounded(out.select("term", "estimate", "std_error"), "estimate", "std_error", digits=6)


# One coefficient a level: log odds of every supplier against the least one; suppliers without both outcomes are left out.
@query("glm_wide_factor", HEAD + """, g AS (SELECT lpad(cl::VARCHAR, 8, '0') AS level, count(*)::DOUBLE AS n, sum(o)::DOUBLE AS y FROM l GROUP BY cl HAVING sum(o) > 0 AND sum(o) < count(*)),
 b AS (SELECT n AS n0, y AS y0 FROM g ORDER BY level LIMIT 1),
 c AS (SELECT 'cl' || level AS term, ln(y / (n - y)) - ln(y0 / (n0 - y0)) AS est, sqrt(1 / y + 1 / (n - y) + 1 / y0 + 1 / (n0 - y0)) AS se FROM g, b WHERE level <> (SELECT min(level) FROM g)
  UNION ALL SELECT '(Intercept)', ln(y0 / (n0 - y0)), sqrt(1 / y0 + 1 / (n0 - y0)) FROM b)
 SELECT term, round(est, 6) AS estimate, round(se, 6) AS std_error, (SELECT CAST(sum(n) AS BIGINT) FROM g) AS n FROM c""")
def _(spark, d):
    rows = lines(spark, d)
    both = rows.groupBy("cl").agg(F.min("o").alias("a"), F.max("o").alias("b")).where("a < b").select("cl")
    rows = keep_ids(rows, both, "cl").withColumn("cl", F.lpad(F.col("cl").cast("string"), 8, "0"))
    out = glm.fit_glm(rows, Model("m", "o", (WideFactor("cl"),)), tol=1e-13)
    return rounded(out.select("term", "estimate", "std_error", "n"), "estimate", "std_error", digits=6)


@query("glm_coef_exp", G + "SELECT term, round(exp(est), 6) AS odds_ratio FROM logit")
def _(spark, d):
    out = glm.fit_glm(lines(spark, d), Model("m", "o", (FLAG,)), tol=1e-13)
    return out.select("term", F.round(F.exp("estimate"), 6).alias("odds_ratio"))


@query("coef_ci", G + "SELECT term, round(est, 6) AS est, round(est - 1.96::DOUBLE * se, 6) AS lwr, round(est + 1.96::DOUBLE * se, 6) AS upr FROM logit")
def _(spark, d):
    out = glm.fit_glm(lines(spark, d), Model("m", "o", (FLAG,)), tol=1e-13)
    e, lo, hi = coef_interval("estimate", "std_error")
    return out.select("term", *[F.round(c, 6).alias(n) for c, n in ((e, "est"), (lo, "lwr"), (hi, "upr"))])


@query("coef_ci_exp", G + "SELECT term, round(exp(est), 6) AS est, round(exp(est - 1.96::DOUBLE * se), 6) AS lwr, round(exp(est + 1.96::DOUBLE * se), 6) AS upr FROM logit")
def _(spark, d):
    out = glm.fit_glm(lines(spark, d), Model("m", "o", (FLAG,)), tol=1e-13)
    e, lo, hi = coef_interval("estimate", "std_error", exponentiate=True)
    return out.select("term", *[F.round(c, 6).alias(n) for c, n in ((e, "est"), (lo, "lwr"), (hi, "upr"))])


NEWTON = """(WITH RECURSIVE k AS (SELECT ({x})::DOUBLE AS x, count(*)::DOUBLE AS n, sum(({y})::DOUBLE) AS y FROM l GROUP BY 1),
  it(i, b0, b1) AS (SELECT 0, ln((sum(y) / sum(n)) / (1 - sum(y) / sum(n))), 0.0::DOUBLE FROM k
   UNION ALL SELECT i + 1, b0 + (h11 * u0 - h01 * u1) / (h00 * h11 - h01 * h01), b1 + (h00 * u1 - h01 * u0) / (h00 * h11 - h01 * h01) FROM
    (SELECT i, b0, b1, sum(n * m * (1 - m)) AS h00, sum(n * m * (1 - m) * x) AS h01, sum(n * m * (1 - m) * x * x) AS h11,
      sum(y - n * m) AS u0, sum((y - n * m) * x) AS u1 FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS m FROM it, k) WHERE i < 15 GROUP BY i, b0, b1))
  SELECT b0, b1, sqrt(h11 / (h00 * h11 - h01 * h01)) AS se0, sqrt(h00 / (h00 * h11 - h01 * h01)) AS se1, n FROM
   (SELECT b0, b1, sum(n) AS n, sum(n * m * (1 - m)) AS h00, sum(n * m * (1 - m) * x) AS h01, sum(n * m * (1 - m) * x * x) AS h11
    FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS m FROM it, k WHERE i = 15) GROUP BY b0, b1))"""


@query("model_summary", HEAD + " UNION ALL ".join(
    f"""SELECT '{m}' AS model, t.term, round(CASE t.j WHEN 0 THEN b0 ELSE b1 END, 6) AS estimate, round(CASE t.j WHEN 0 THEN se0 ELSE se1 END, 6) AS std_error,
 round({tail_sql('pow(CASE t.j WHEN 0 THEN b0 / se0 ELSE b1 / se1 END, 2) / 2')}, 6) AS p_value, CAST(n AS BIGINT) AS n
 FROM {NEWTON.format(x=m, y='y')} f, (VALUES (0, '(Intercept)'), (1, '{m}')) t(j, term)""" for m in ("qty", "disc", "o")))
def _(spark, d):
    out = glm.fit_glm(lines(spark, d), [Model(m, "y", (m,)) for m in ("qty", "disc", "o")], tol=1e-13)
    return rounded(out.select("model", "term", "estimate", "std_error", "p_value", "n"),
                   "estimate", "std_error", "p_value", digits=6)


# Profile of a 0/1 predictor: with the intercept fixed the other group fits freely;
# with the log odds ratio t fixed the fitted total equals the observed total, which
# gives a quadratic for the first group's fitted count.
PROFILE = HEAD.replace("WITH l", "WITH RECURSIVE l") + """, g AS (SELECT sum(1 - o)::DOUBLE AS n0, sum(o)::DOUBLE AS n1, sum(y * (1 - o))::DOUBLE AS y0, sum(y * o)::DOUBLE AS y1 FROM l),
 f AS (SELECT *, y0 / n0 AS p0, y1 / n1 AS p1, ln(y0 / (n0 - y0)) AS b0, ln(y1 / (n1 - y1)) - ln(y0 / (n0 - y0)) AS b1 FROM g),
 b(i, j, side, a, z) AS (SELECT 0, j, side, 0.0::DOUBLE, 2.0::DOUBLE FROM f, (VALUES (0), (1)) t(j), (VALUES (-1), (1)) u(side)
  UNION ALL SELECT i + 1, j, side, CASE WHEN dev < 3.841458820694124 THEN mid ELSE a END, CASE WHEN dev < 3.841458820694124 THEN z ELSE mid END FROM
   (SELECT *, 2 * (y0 * ln(p0 / q0) + (n0 - y0) * ln((1 - p0) / (1 - q0)) + y1 * ln(p1 / q1) + (n1 - y1) * ln((1 - p1) / (1 - q1))) AS dev FROM
    (SELECT *, CASE j WHEN 0 THEN p1 ELSE (y0 + y1 - n0 * q0) / n1 END AS q1 FROM
     (SELECT *, CASE j WHEN 0 THEN 1 / (1 + exp(-(b0 + side * mid)))
       ELSE CASE WHEN abs(th - 1) < 1e-12 THEN (y0 + y1) / (n0 + n1) ELSE
        (-(n1 - y0 - y1 + th * (n0 + y0 + y1)) + sqrt(pow(n1 - y0 - y1 + th * (n0 + y0 + y1), 2) - 4 * (1 - th) * n0 * -(th * (y0 + y1)))) / (2 * (1 - th)) / n0 END END AS q0 FROM
      (SELECT b.*, f.*, (a + z) / 2 AS mid, exp(-(f.b1 + side * (a + z) / 2)) AS th FROM b, f WHERE i < 50)))))
 SELECT CASE j WHEN 0 THEN '(Intercept)' ELSE 'o' END AS term, round(CASE j WHEN 0 THEN b0 ELSE b1 END, 6) AS estimate,
  round(max(CASE j WHEN 0 THEN b0 ELSE b1 END - a) FILTER (WHERE side = -1), 6) AS lower, round(max(CASE j WHEN 0 THEN b0 ELSE b1 END + a) FILTER (WHERE side = 1), 6) AS upper
 FROM b, f WHERE i = 50 GROUP BY j, b0, b1"""


@query("profile_ci", PROFILE)
def _(spark, d):
    out = glm.profile_interval(lines(spark, d), Model("m", "y", ("o",)))
    return rounded(out.select("term", "estimate", "lower", "upper"), "estimate", "lower", "upper", digits=6)


# A numeric predictor: bounds by Newton steps on "the other score is zero" and "the deviance is the least one plus 3.84".
PROFILE_NUMERIC = HEAD.replace("WITH l", "WITH RECURSIVE l") + f""", k AS (SELECT disc::DOUBLE AS x, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS y FROM l GROUP BY 1),
 f AS (SELECT b0, b1, se0, se1 FROM {NEWTON.format(x='disc', y='y')}),
 h AS (SELECT b0, b1, se0, se1, sum(n * m * (1 - m)) AS h00, sum(n * m * (1 - m) * x) AS h01, sum(n * m * (1 - m) * x * x) AS h11,
   -2 * sum(y * ln(m) + (n - y) * ln(1 - m)) AS least FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS m FROM f, k) GROUP BY ALL),
 it(i, j, side, c0, c1) AS (
  SELECT 0, j, side, b0 + CASE j WHEN 0 THEN side * 1.96 * se0 ELSE -side * 1.96 * se1 * h01 / h00 END,
   b1 + CASE j WHEN 1 THEN side * 1.96 * se1 ELSE -side * 1.96 * se0 * h01 / h11 END FROM h, (VALUES (0), (1)) t(j), (VALUES (-1), (1)) u(side)
  UNION ALL SELECT i + 1, j, side, c0 + (r1 * a22 - r2 * a12) / (a11 * a22 - a12 * a21), c1 + (a11 * r2 - a21 * r1) / (a11 * a22 - a12 * a21) FROM
   (SELECT i, j, side, c0, c1, CASE j WHEN 1 THEN g00 ELSE g01 END AS a11, CASE j WHEN 1 THEN g01 ELSE g11 END AS a12, CASE j WHEN 1 THEN u0 ELSE u1 END AS r1,
     2 * u0 AS a21, 2 * u1 AS a22, dev - least - 3.841458820694124 AS r2 FROM
    (SELECT i, j, side, c0, c1, least, sum(n * m * (1 - m)) AS g00, sum(n * m * (1 - m) * x) AS g01, sum(n * m * (1 - m) * x * x) AS g11,
      sum(y - n * m) AS u0, sum((y - n * m) * x) AS u1, -2 * sum(y * ln(m) + (n - y) * ln(1 - m)) AS dev
     FROM (SELECT *, 1 / (1 + exp(-(c0 + c1 * x))) AS m FROM it, k, h WHERE i < 20) GROUP BY ALL)))
 SELECT CASE j WHEN 0 THEN '(Intercept)' ELSE 'disc' END AS term, round(CASE j WHEN 0 THEN any_value(b0) ELSE any_value(b1) END, 6) AS estimate,
  round(max(CASE j WHEN 0 THEN c0 ELSE c1 END) FILTER (WHERE side = -1), 6) AS lower, round(max(CASE j WHEN 0 THEN c0 ELSE c1 END) FILTER (WHERE side = 1), 6) AS upper
 FROM it, h WHERE i = 20 GROUP BY j"""


@query("profile_ci_numeric", PROFILE_NUMERIC)
def _(spark, d):
    out = glm.profile_interval(lines(spark, d), Model("m", "y", ("disc",)))
    return rounded(out.select("term", "estimate", "lower", "upper"), "estimate", "lower", "upper", digits=6)
