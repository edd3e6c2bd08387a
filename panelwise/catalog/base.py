"""Registration and the shared views of the given tables.

Participants are customers; a laboratory visit is an order: the customer is the
id, the priority the visit (one label stands for "missing"), the status the
result (P positive, F negative, O uncertain). Survey answers are events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.functions import recode
from panelwise.session import shared_folder, tune  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

POS, NEG, UNSURE = "P", "F", "O"
MISSING_VISIT = "4-NOT SPECIFIED"
VISITS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
BASELINE = "1-URGENT"
WEEKS = ("w1", "w2", "w3", "w4", "w5")
QUESTIONS = {"q01signup": "signup", "q02error": "error", "q03purchase": "purchase", "q04click": "click", "q05view": "view"}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r(c: Column | str, digits: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def samples(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderkey").alias("k"),
        recode.blank_out("o_orderpriority", [MISSING_VISIT]).alias("visit"),
        recode.ordinal("o_orderpriority", VISITS).alias("ord"),
        F.col("o_orderstatus").alias("value"),
        recode.blank_out("o_orderstatus", [UNSURE]).alias("known"),
        F.when(x >= 300000, POS).when(x >= 100000, NEG).alias("second"),
        x.alias("x"),
        F.to_date("o_orderdate").alias("day"),
    )


S = """WITH s AS (
 SELECT o_custkey AS id, o_orderkey AS k, NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS visit,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 4 END AS ord,
  o_orderstatus AS value, NULLIF(o_orderstatus, 'O') AS known,
  CASE WHEN o_totalprice >= 300000 THEN 'P' WHEN o_totalprice >= 100000 THEN 'F' END AS second,
  o_totalprice AS x, CAST(o_orderdate AS DATE) AS day FROM orders)
"""


def people(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("site"),
        F.col("c_nationkey").alias("code"),
        F.col("c_acctbal").alias("bal"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal_known"),
        recode.blank_out("c_mktsegment", ["HOUSEHOLD"]).alias("group"),
    )


C = """WITH c AS (
 SELECT c_custkey AS id, c_mktsegment AS site, c_nationkey AS code, c_acctbal AS bal,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal_known, NULLIF(c_mktsegment, 'HOUSEHOLD') AS "group" FROM customer)
"""


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Events as long answers: week token, question name, value in cents as text."""
    week = F.concat(F.lit("w"), F.ceil(F.dayofmonth("ts") / 7).cast("string"))
    return table(spark, folder, "events").select(
        F.col("user_id").alias("id"),
        week.alias("visit"),
        F.col("event_type").alias("variable"),
        F.round(F.col("value") * 100).cast("bigint").cast("string").alias("value"),
        F.col("event_id").alias("k"),
    )


A = """WITH a AS (
 SELECT user_id AS id, 'w' || CAST(CAST(ceil(day(ts) / 7.0) AS INT) AS VARCHAR) AS visit, event_type AS variable,
  CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS value, event_id AS k FROM events)
"""


def sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Wide answer sheet: one row per user, columns ``F01_<week>_<question>`` (highest answer as text)."""
    cols = []
    for w in WEEKS:
        for q, kind in QUESTIONS.items():
            hit = (F.col("visit") == w) & (F.col("variable") == kind)
            cols.append(F.max(F.when(hit, F.col("value").cast("bigint"))).cast("string").alias(f"F01_{w}_{q}"))
    return answers(spark, folder).groupBy("id").agg(*cols)


CELLS = A + """, cells AS (
 SELECT id, visit, variable, CAST(max(CAST(value AS BIGINT)) AS VARCHAR) AS value FROM a GROUP BY id, visit, variable),
 users AS (SELECT DISTINCT id FROM a),
 grid AS (SELECT u.id, w.visit, q.variable, q.q FROM users u,
  (VALUES ('w1'), ('w2'), ('w3'), ('w4'), ('w5')) w(visit),
  (VALUES ('signup', 'q01'), ('error', 'q02'), ('purchase', 'q03'), ('click', 'q04'), ('view', 'q05')) q(variable, q)),
 long AS (SELECT g.id, g.visit, g.variable, 'F01_' || g.visit || '_' || g.q || g.variable AS key, c.value
  FROM grid g LEFT JOIN cells c ON c.id = g.id AND c.visit = g.visit AND c.variable = g.variable)
"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Clustered rows: supplier is the cluster, a returned line the outcome."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("cl"),
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("no"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_linestatus") == "O").cast("int").alias("o"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_quantity").alias("qty"),
        F.round(F.col("l_discount") * 100).alias("disc"),
    )


L = """SELECT l_suppkey AS cl, l_orderkey AS ok, l_linenumber AS no, CAST(l_returnflag = 'R' AS INT) AS y,
 CAST(l_linestatus = 'O' AS INT) AS o, l_returnflag AS flag, l_linestatus AS status, l_quantity AS qty,
 round(l_discount * 100) AS disc FROM lineitem"""


def tail_sql(h: str, a: str = "0.5") -> str:
    """Upper regularised gamma Q(a, h) by its series; 0 where it is below 1e-100."""
    return (
        f"(CASE WHEN {h} > 250 THEN 0.0 WHEN {h} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - "
        f"(SELECT sum(exp(-({h}) + ({a} + n) * ln({h}) - lgamma({a} + n + 1))) FROM range(0, 1200) t(n))) END)"
    )
