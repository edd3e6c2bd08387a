"""Documents through five stages: toxicity, line quality, near duplicates, benchmark decontamination, token ids.

Every stage works on all rows that the one before it kept. run() writes each stage's rows to the shared folder and reads
them again, so a lost executor costs a stage at most, and no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwise.llm import bpe, decontam, jaccard, linecrf, toxicity
from panelwise.llm.catalog import vocabulary_path
from panelwise.llm.common import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier does not flag; trained on the labelled ones among docs that are not held out."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field takes for good; trained likewise."""
    return linecrf.accepted(docs, linecrf.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near duplicates."""
    table(spark, sf_dir, "documents")
    return jaccard.without_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document."""
    table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, vocabulary_path())


STAGES = [
    ("toxicity", without_toxic),
    ("quality", good_quality),
    ("near duplicates", one_of_each_class),
    ("decontamination", without_benchmark),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


#: The classifiers' fits and the numpy operators have no SQL equivalent; tests compare stages with brute force.
ORACLE_SQL = None
