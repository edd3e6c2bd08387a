"""Contingency tests, many per job."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwise.catalog.base import L, NEG, POS, S, lines, query, rounded, samples, table, tail_sql
from panelwise.operators import contingency
from panelwise.operators.contingency import Pair

CELLS = S + """, u AS (SELECT 'visit' AS test, visit AS row, value AS col FROM s UNION ALL SELECT 'late', CAST(ord > 2 AS INT)::VARCHAR, known FROM s
 UNION ALL SELECT 'second_late', second, value FROM s WHERE ord > 2),
 cells AS (SELECT test, row, col, count(*) AS n FROM u WHERE row IS NOT NULL AND col IS NOT NULL GROUP BY test, row, col) """


def _pairs():
    return [
        Pair("visit", F.col("visit"), F.col("value")),
        Pair("late", (F.col("ord") > 2).cast("int"), F.col("known")),
        Pair("second_late", F.col("second"), F.col("value"), F.coalesce(F.col("ord") > 2, F.lit(False))),
    ]


@query("contingency_counts", CELLS + "SELECT test, row, col, n FROM cells")
def _(spark, d):
    return contingency.contingency_counts(samples(spark, d), _pairs())


CHI = """, rs AS (SELECT test, row, sum(n)::DOUBLE AS r FROM cells GROUP BY ALL), cs AS (SELECT test, col, sum(n)::DOUBLE AS k FROM cells GROUP BY ALL),
 ts AS (SELECT test, sum(n)::DOUBLE AS t FROM cells GROUP BY ALL),
 e AS (SELECT rs.test, rs.row, cs.col, r * k / t AS e, coalesce(c.n, 0) AS n FROM rs JOIN cs USING (test) JOIN ts USING (test)
  LEFT JOIN cells c ON c.test = rs.test AND c.row = rs.row AND c.col = cs.col),
 d AS (SELECT test, count(DISTINCT row) AS nr, count(DISTINCT col) AS nc FROM e GROUP BY test),
 q AS (SELECT e.test, max((nr - 1) * (nc - 1)) AS df, CAST(sum(n) AS BIGINT) AS n,
  sum(pow(CASE WHEN nr = 2 AND nc = 2 THEN greatest(abs(n - e) - 0.5, 0) ELSE abs(n - e) END, 2) / e) AS st FROM e JOIN d USING (test) GROUP BY e.test)
 SELECT test, round(st, 6) AS statistic, CAST(df AS INT) AS df, n, round(""" + tail_sql("st / 2", "df / 2.0") + ", 9) AS p_value FROM q WHERE df > 0"


@query("chisq_test", CELLS + CHI)
def _(spark, d):
    out = contingency.chisq_test(contingency.contingency_counts(samples(spark, d), _pairs()))
    return rounded(rounded(out, "statistic", digits=6), "p_value")


T22 = "WITH l AS (" + L + """), b AS (SELECT cl AS test, count(*) FILTER (WHERE status = 'F' AND y = 0) AS a, count(*) FILTER (WHERE status = 'F') AS r1,
  count(*) FILTER (WHERE status = 'O') AS r2, count(*) FILTER (WHERE y = 0) AS k FROM l GROUP BY cl HAVING r1 > 0 AND r2 > 0 AND k > 0 AND k < r1 + r2),
 w AS (SELECT test, a, r1 + r2 AS n, x, lgamma(r1 + 1) - lgamma(x + 1) - lgamma(r1 - x + 1) + lgamma(r2 + 1) - lgamma(k - x + 1) - lgamma(r2 - k + x + 1)
   - lgamma(r1 + r2 + 1) + lgamma(k + 1) + lgamma(r1 + r2 - k + 1) AS lw
  FROM (SELECT *, unnest(range(greatest(0, k - r2), least(r1, k) + 1)) AS x FROM b)) """


ALL = ", every AS (SELECT cl AS test, count(*) AS n FROM l GROUP BY cl) "
NOTE = ", CASE WHEN b.test IS NULL THEN 'not a 2x2 table' END AS note "


@query("fisher_2x2", T22 + ALL + """, o AS (SELECT test, lw AS lo FROM w WHERE x = a),
 p AS (SELECT test, round(sum(CASE WHEN exp(lw) <= exp(lo) * (1 + 1e-7) THEN exp(lw) ELSE 0 END) / sum(exp(lw)), 9) AS p_value
  FROM w JOIN o USING (test) GROUP BY test)
 SELECT every.test, every.n, p.p_value""" + NOTE + "FROM every LEFT JOIN b ON b.test = every.test LEFT JOIN p ON p.test = every.test")
def _(spark, d):
    cells = contingency.keyed_counts(lines(spark, d), "cl", "status", "y")
    return rounded(contingency.fisher_2x2(cells).select("test", "n", "p_value", "note"), "p_value")


def _bisect(name: str, stat: str, target: str) -> str:
    """Root of an increasing statistic of the noncentral weights, per test."""
    return f""", {name}(i, test, lo, hi) AS (SELECT 0, test, -8.0::DOUBLE, 8.0::DOUBLE FROM b
  UNION ALL SELECT i + 1, z.test, CASE WHEN st < {target} THEN mid ELSE lo END, CASE WHEN st < {target} THEN hi ELSE mid END FROM
   (SELECT q.i, q.test, q.lo, q.hi, (q.lo + q.hi) / 2 AS mid, max(w.a) AS a,
     sum({stat} * exp(w.lw - w.top + (w.x - w.a) * (q.lo + q.hi) / 2)) / sum(exp(w.lw - w.top + (w.x - w.a) * (q.lo + q.hi) / 2)) AS st
    FROM {name} q JOIN wt w ON w.test = q.test WHERE q.i < 52 GROUP BY q.i, q.test, q.lo, q.hi) z)"""


ODDS = (
    T22.replace("WITH l AS", "WITH RECURSIVE l AS", 1)
    + ", wt AS (SELECT *, max(lw) OVER (PARTITION BY test) AS top FROM w)"
    + _bisect("m", "w.x", "a")
    + _bisect("f", "CAST(w.x >= w.a AS INT)", "0.025")
    + _bisect("g", "-CAST(w.x <= w.a AS INT)", "-0.025")
    + ALL
    + "SELECT every.test, round(exp((m.lo + m.hi) / 2), 6) AS odds_ratio, round(exp((f.lo + f.hi) / 2), 6) AS ci_lower, round(exp((g.lo + g.hi) / 2), 6) AS ci_upper"
    + NOTE
    + """FROM every LEFT JOIN b ON b.test = every.test
 LEFT JOIN m ON m.test = b.test AND m.i = 52 LEFT JOIN f ON f.test = b.test AND f.i = 52 LEFT JOIN g ON g.test = b.test AND g.i = 52"""
)


@query("fisher_2x2_odds_ratio", ODDS)
def _(spark, d):
    cells = contingency.keyed_counts(lines(spark, d), "cl", "status", "y")
    out = contingency.fisher_2x2(cells).select("test", "odds_ratio", "ci_lower", "ci_upper", "note")
    return rounded(out, "odds_ratio", "ci_lower", "ci_upper", digits=6)


RX2 = "WITH l AS (" + L + """), b AS (SELECT cl AS test,
  count(*) FILTER (WHERE flag = 'A') AS r1, count(*) FILTER (WHERE flag = 'N') AS r2, count(*) FILTER (WHERE flag = 'R') AS r3,
  count(*) FILTER (WHERE flag = 'A' AND status = 'F') AS a1, count(*) FILTER (WHERE flag = 'N' AND status = 'F') AS a2,
  count(*) FILTER (WHERE status = 'F') AS k FROM l GROUP BY cl),
 u AS (SELECT *, unnest(range(0, least(r1, k) + 1)) AS x FROM b),
 v AS (SELECT *, unnest(range(greatest(0, k - x - r3), least(r2, k - x) + 1)) AS y FROM u),
 w AS (SELECT test, r1 + r2 + r3 AS n, x = a1 AND y = a2 AS obs, lgamma(r1 + 1) - lgamma(x + 1) - lgamma(r1 - x + 1) + lgamma(r2 + 1) - lgamma(y + 1)
   - lgamma(r2 - y + 1) + lgamma(r3 + 1) - lgamma(k - x - y + 1) - lgamma(r3 - k + x + y + 1)
   - lgamma(r1 + r2 + r3 + 1) + lgamma(k + 1) + lgamma(r1 + r2 + r3 - k + 1) AS lw FROM v),
 o AS (SELECT test, lw AS lo FROM w WHERE obs)
 SELECT test, any_value(n) AS n, round(sum(CASE WHEN exp(lw) <= exp(lo) * (1 + 1e-7) THEN exp(lw) ELSE 0 END), 9) AS p_value FROM w JOIN o USING (test) GROUP BY test"""


@query("fisher_rx2", RX2)
def _(spark, d):
    cells = contingency.keyed_counts(lines(spark, d), "cl", "flag", "status")
    return rounded(contingency.fisher_rx2(cells).select("test", "n", "p_value"), "p_value")


def _five() -> str:
    """All tables of five rows and two columns with the observed margins."""
    sizes = ", ".join(f"count(*) FILTER (WHERE row = {i}) AS r{i}, count(*) FILTER (WHERE row = {i} AND hit) AS a{i}" for i in range(1, 6))
    steps = "u0 AS (SELECT *, k AS left0 FROM b WHERE k > 0 AND k < n)"
    for i in range(1, 5):
        others = " + ".join(f"r{j}" for j in range(i + 1, 6))
        steps += (
            f", u{i} AS (SELECT *, left{i - 1} - x{i} AS left{i} FROM (SELECT *, unnest(range(greatest(0, left{i - 1} - ({others})), least(r{i}, left{i - 1}) + 1)) AS x{i} FROM u{i - 1}))"
        )
    xs = ["x1", "x2", "x3", "x4", "left4"]
    weight = " + ".join(f"lgamma(r{i} + 1) - lgamma({x} + 1) - lgamma(r{i} - {x} + 1)" for i, x in enumerate(xs, 1))
    same = " AND ".join(f"{x} = a{i}" for i, x in enumerate(xs, 1))
    return f"""WITH s AS (SELECT o_custkey AS test, CAST(substr(o_orderpriority, 1, 1) AS INT) AS row, o_orderstatus = 'F' AS hit FROM orders),
 b AS (SELECT test, {sizes}, count(*) FILTER (WHERE hit) AS k, count(*) AS n FROM s GROUP BY test), {steps},
 w AS (SELECT test, {same} AS obs, {weight} - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1) AS lw FROM u4),
 o AS (SELECT test, lw AS lo FROM w WHERE obs),
 p AS (SELECT test, round(least(1, sum(CASE WHEN exp(lw) <= exp(lo) * (1 + 1e-7) THEN exp(lw) ELSE 0 END)), 9) AS p_value FROM w JOIN o USING (test) GROUP BY test)
 SELECT b.test, b.n, p.p_value, CASE WHEN p.test IS NULL THEN 'not two columns' END AS note FROM b LEFT JOIN p ON p.test = b.test"""


@query("fisher_rx2_five_levels", _five())
def _(spark, d):
    codes = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("row"), (F.col("o_orderstatus") == NEG).alias("hit"))
    return rounded(contingency.fisher_rx2(contingency.keyed_counts(codes, "id", "row", "hit")), "p_value")


@query("before_after_table", S + """SELECT 'before_after' AS test, CASE WHEN visit = '1-URGENT' THEN 'before' ELSE 'after' END AS row, known AS col, count(*) AS n
 FROM s WHERE known IS NOT NULL AND visit IS NOT NULL GROUP BY 2, 3""")
def _(spark, d):
    period = F.when(F.col("visit") == "1-URGENT", "before").when(F.col("visit").isNotNull(), "after")
    known = samples(spark, d).where(F.col("known").isin(POS, NEG))
    return contingency.contingency_counts(known, [Pair("before_after", period, F.col("known"))])
