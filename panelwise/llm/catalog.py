"""Registered queries of the corpus operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm import bpe, decontam, jaccard, licences, linecrf, linefreq, mainpath, minmax, toxicity, turnrepair, urlrules, warc, whitening
from panelwise.llm.common import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op10_bpe")
def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), vocabulary_path())


# The rules to apply, (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query(
    "op2_urlrules",
    r"""
WITH rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (
 SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
 SELECT page_id, rh || rp AS rule, rv AS verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
 FROM cut JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND substr(path, 1, length(rp)) = rp)
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM cut c LEFT JOIN fits f ON f.page_id = c.page_id AND f.k = 1
""",
)
def op2_urlrules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, folder, "pages"), urlrules.build(rules))


@query("op9_linefreq", linefreq.SQL)
def op9_linefreq(spark: SparkSession, folder: str) -> DataFrame:
    return linefreq.judged(table(spark, folder, "documents"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query("op5_linecrf")
def op5_linecrf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return linecrf.score(docs, linecrf.fit(docs, table(spark, folder, "labels")))


@query("op6_jaccard")
def op6_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(table(spark, folder, "documents"))


@query("op8_decontam")
def op8_decontam(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op4_warc", warc.SQL)
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    files = warc.write(table(spark, folder, "pages"))
    return warc.read(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_mainpath")
def op7_mainpath(spark: SparkSession, folder: str) -> DataFrame:
    return mainpath.extract(table(spark, folder, "pages"))


@query("op3_licences")
def op3_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: a source is a tree of directories of 400 and of 20 ids; the first document of each is its LICENSE file."""
    docs = table(spark, folder, "documents")
    d, number = F.col("doc_id"), lambda n: F.floor(F.col("doc_id") / n).cast("string")
    upper = F.concat_ws("/", F.col("source"), F.concat(F.lit("d"), number(400)))
    lower = F.concat_ws("/", upper, F.concat(F.lit("d"), number(20)))
    path = F.when(d % 400 == 0, F.concat(upper, F.lit("/LICENSE"))).when(d % 20 == 0, F.concat(lower, F.lit("/LICENSE")))
    files = docs.select(d.alias("id"), F.coalesce(path, F.concat(lower, F.lit("/"), d.cast("string"), F.lit(".txt"))).alias("path"), "text")
    own = licences.own_licences(files)
    return licences.licences(written(own, "licences")).withColumnRenamed("id", "doc_id")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.report(table(spark, folder, "embeddings"))


@query("op12_minmax")
def op12_minmax(spark: SparkSession, folder: str) -> DataFrame:
    return minmax.classes(table(spark, folder, "documents"))


@query("op13_turnrepair")
def op13_turnrepair(spark: SparkSession, folder: str) -> DataFrame:
    return turnrepair.report(table(spark, folder, "conversations"))
