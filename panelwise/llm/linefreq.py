"""Quality rules with the frequency of lines across documents, in DataFrame functions only.

Lines are normalised (lower case, white space to one blank), hashed, and counted per host in distinct documents, each row being
one. A line in more than `max_documents` documents of its host is boilerplate and is removed; a document that keeps too little
is depleted and rejected. So a text that one host has more often than that is rejected as well, in all its copies.

The first pass writes one row for each document with its measures and line hashes, without a shuffle. Counting combines on
the map side, so neither a hot host nor a hot line meets in one task. Frequent lines are joined back by key; only removed lines go on from there.

Null text: no words. Null host: a host of its own. Repeated rows are judged each for themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import written

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, BLANKS, " ")))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    For the last one, every window of three words becomes a number whose low bits are its position and whose high bits a
    hash. Sorted, equal windows are neighbours; their positions, sorted again, give the number of words that they cover.
    With n words the hash keeps 64 - log2(n) bits, so a false equality is expected in less than n^3 / 2^65 of such texts.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    same = "shiftright(x, _bits) = shiftright(get(_windows, {0}), _bits)"
    return (
        docs.withColumn("_text", body)
        .withColumn("_words", F.array_remove(F.split("_text", BLANKS), ""))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0))
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("word_chars", F.length(F.translate("_text", WHITE, "")).cast("bigint"))
        .withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
        .withColumn("_bits", F.length(F.bin("n_words")))
        .withColumn(
            "_windows",
            F.expr(
                "sort_array(transform(if(n_words >= 3, sequence(0, cast(n_words AS INT) - 3), array()),"
                " i -> shiftleft(xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)), _bits) | cast(i AS BIGINT)))"
            ),
        )
        .withColumn(
            "_places",
            F.expr(
                f"sort_array(transform(filter(_windows, (x, k) -> coalesce({same.format('k - 1')}, false) OR coalesce({same.format('k + 1')}, false)),"
                " x -> x & (shiftleft(1L, _bits) - 1)))"
            ),
        )
        .withColumn(
            "n_repeat_words",
            F.expr("aggregate(transform(_places, (p, k) -> least(3L, get(_places, k + 1) - p)), 0L, (a, x) -> a + x)"),
        )
        .drop("_text", "_bits", "_windows", "_places")
    )


def prepared(docs: DataFrame, host: str = "source") -> DataFrame:
    """One written row per document: row number, id, host, measures, and (hash, words) of its lines."""
    line = F.transform(
        "_lines", lambda x: F.struct(F.xxhash64(normal(x)).alias("h"), F.size(F.array_remove(F.split(x, BLANKS), "")).alias("n"))
    )
    rows = measures(docs.select("doc_id", F.col(host).alias("host"), "text"))
    return written(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
            "n_repeat_words", line.alias("lines"),
        ),
        "linefreq",
    )


def frequent_lines(rows: DataFrame, max_documents: int) -> DataFrame:
    """(host, h) of lines that more than max_documents documents of a host have."""
    lines = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x.h))).alias("h"))
    return lines.groupBy("host", "h").agg(F.count("*").alias("documents")).where(F.col("documents") > max_documents)


def removed_words(rows: DataFrame, max_documents: int) -> DataFrame:
    """(row, n_removed, hashes): words of boilerplate in each document that has any, and the hashes of those lines."""
    often = frequent_lines(rows, max_documents).select(F.col("host").alias("often_host"), F.col("h").alias("often_h"))
    lines = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.n")
    hit = lines.join(often, F.col("host").eqNullSafe(F.col("often_host")) & (F.col("h") == F.col("often_h")))
    return hit.groupBy("row").agg(F.sum("n").alias("n_removed"), F.collect_set("h").alias("hashes"))


def judged(
    docs: DataFrame, host: str = "source", max_documents: int = 50, min_left: int = 20, min_share: float = 0.3
) -> DataFrame:
    """(doc_id, measures, base_failed, n_removed, kept) of every document.

    base_failed: under 50 words, or over half of the words in repeated three-word windows. kept: not base_failed, and if
    lines were removed at least min_left words and min_share of all words remain.
    """
    rows = prepared(docs, host)
    out = rows.join(removed_words(rows, max_documents).select("row", "n_removed"), "row", "left")
    n, gone = F.col("n_words"), F.coalesce("n_removed", F.lit(0)).cast("bigint")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    left = n - gone
    depleted = (gone > 0) & ((left < min_left) | (left < min_share * n))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        gone.alias("n_removed"), (~failed & ~depleted).alias("kept"),
    )


def cleaned(docs: DataFrame, host: str = "source", max_documents: int = 50) -> DataFrame:
    """docs (doc_id, host, text) with boilerplate lines taken out of the texts. The hashes of one document's lines meet, no more."""
    base = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(host).alias("host"), "text"), "linefreq-texts")
    rows = base.select(
        "row", "host",
        F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(normal(x)).alias("h"), F.size(F.array_remove(F.split(x, BLANKS), "")).alias("n"))).alias("lines"),
    ).withColumn("lines", F.filter("lines", lambda x: x.n > 0))
    out = base.join(removed_words(rows, max_documents).select("row", "hashes"), "row", "left")
    keep = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("hashes", F.xxhash64(normal(x))))
    return out.select("doc_id", "host", F.when(F.col("hashes").isNull(), F.col("text")).otherwise(F.array_join(keep, "\n")).alias("text"))


SQL = r"""
WITH base AS (
 SELECT row_number() OVER () AS row, doc_id, source, text AS raw, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT row, doc_id, source, text, unnest(ls) AS line FROM base),
worded AS (
 SELECT row, doc_id, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
 FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
often AS (SELECT source, norm FROM worded GROUP BY source, norm HAVING count(DISTINCT row) > 50),
gone AS (
 SELECT d.doc_id, sum(d.n) AS n_removed FROM worded d JOIN often o ON d.norm = o.norm AND d.source IS NOT DISTINCT FROM o.source
 GROUP BY d.doc_id),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM base WHERE len(w) >= 3),
windows AS (SELECT doc_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM places),
marked AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM windows),
spaced AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM marked WHERE times >= 2),
repeats AS (SELECT doc_id, sum(CASE WHEN nxt - p < 3 THEN nxt - p ELSE 3 END) AS n_repeat_words FROM spaced GROUP BY doc_id),
m AS (
 SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(d.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed
 FROM base b LEFT JOIN dups d ON d.doc_id = b.doc_id LEFT JOIN repeats r ON r.doc_id = b.doc_id LEFT JOIN gone g ON g.doc_id = b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, n_removed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
  AND NOT (n_removed > 0 AND (n_words - n_removed < 20 OR n_words - n_removed < 0.3 * n_words)) AS kept
FROM m
"""
