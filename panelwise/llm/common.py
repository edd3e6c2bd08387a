"""Helpers shared by the corpus operators: tables, shared folder, held-out split, bounded text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one Arrow batch. Texts can be long, so batches are kept short.
BATCH_ROWS = 256
#: Characters that the numpy operators work on at once.
CHUNK_CHARS = 300_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Only a local session may go without that setting; a folder of this machine is used then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: cuts lineage and is not computed again."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves remainder 0 when divided by 5."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 5 == 0


def training_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """Up to per_class texts of each label, chosen by the hash of their id, none of them held out: (doc_id, lang, text, y).

    per_class bounds what is broadcast here and what a fit collects. A document with several labels takes the largest;
    unlabelled rows, null texts and null labels are left out.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", lang, "text")
    return rows.join(F.broadcast(ids), "doc_id")


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of a list of texts that hold about `most` characters each; a longer text makes a slice of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is taken as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and where each text begins (one more entry than texts)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    return flat, np.concatenate([[0], ends]).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not use."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def add_from_text(docs: DataFrame, fields: str, make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """docs with further columns (DDL `fields`) that `make` computes for each Arrow batch; all other columns pass through."""
    added = StructType.fromDDL(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], [*batch.schema.names, *added.names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))
