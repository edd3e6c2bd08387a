"""Reading study sheets and look-ups, choosing columns by name, writing results."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sheet(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Wide study sheet. CSV cells stay text; types come from explicit casts later."""
    if fmt == "csv":
        return spark.read.csv(path, header=True, inferSchema=False)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported sheet format: {fmt}")


def read_lookup(spark: SparkSession, path: str, keys: Iterable[str], fmt: str = "parquet") -> DataFrame:
    """Key list. Only the key columns are read and duplicates are dropped.

    The list carries no broadcast hint: Spark broadcasts it when its size is
    below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    return read_sheet(spark, path, fmt).select(*keys).distinct()


def matching(columns: Iterable[str], patterns: str | Iterable[str]) -> list[str]:
    """Column names in which one of the patterns occurs. Metadata only."""
    parts = [patterns] if isinstance(patterns, str) else list(patterns)
    rx = re.compile("|".join(parts))
    return [c for c in columns if rx.search(c)]


def select_by_pattern(df: DataFrame, ids: Iterable[str], patterns: str | Iterable[str]) -> DataFrame:
    ids = list(ids)
    return df.select(*ids, *[c for c in matching(df.columns, patterns) if c not in ids])


def ensure_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Add absent columns as missing text, so that a smaller sheet runs through the same plan."""
    absent = [n for n in names if n not in df.columns]
    return df.withColumns({n: F.lit(None).cast("string") for n in absent}) if absent else df


def list_columns(df: DataFrame, pattern: str) -> DataFrame:
    """Matching column names as a one-column frame."""
    spark = df.sparkSession
    names = matching(df.columns, pattern)
    return spark.createDataFrame([(c,) for c in names], "column_name string")


MANIFEST = "tables.json"


def write_tables(frames: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """Write a set of named result frames below ``folder``; returns their paths.

    All frames go below a new version folder first. One manifest, put in place by renaming it over the former one, then names
    the version's paths, so readers see the former set whole until the new one is whole. A run that fails leaves the former
    manifest, and what it had written is removed. Versions that no manifest names any more are removed after the change.
    """
    spark = next(iter(frames.values())).sparkSession if frames else SparkSession.getActiveSession()
    folder = folder.rstrip("/")
    version = f"{folder}/version-{uuid.uuid4().hex}"
    former = _manifest(spark, folder)
    paths = {}
    try:
        for name, frame in frames.items():
            writer = frame.write.mode("errorifexists").format(fmt)
            if fmt == "csv":
                writer = writer.option("header", True)
            paths[name] = f"{version}/{name}"
            writer.save(paths[name])
        _put(spark, f"{folder}/{MANIFEST}", json.dumps({"version": version, "format": fmt, "tables": paths}))
    except BaseException:
        _remove(spark, version)
        raise
    if former and former["version"] != version:
        _remove(spark, former["version"])
    return list(paths.values())


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The set of frames that the manifest of ``folder`` names; empty without one."""
    found = _manifest(spark, folder.rstrip("/"))
    if not found:
        return {}
    reader = spark.read.format(found["format"])
    if found["format"] == "csv":
        reader = reader.option("header", True)
    return {name: reader.load(path) for name, path in found["tables"].items()}


# The manifest lies in the same store as the tables, so it is read and put in place by Hadoop's file system.


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    _, store, at = _store(spark, f"{folder}/{MANIFEST}")
    if not store.exists(at):
        return None
    return json.loads("".join(r.value for r in spark.read.option("wholetext", True).text(f"{folder}/{MANIFEST}").collect()))


def _put(spark: SparkSession, path: str, text: str) -> None:
    jvm, store, at = _store(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = store.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(store.makeQualified(new), store.makeQualified(at), options)


def _remove(spark: SparkSession, path: str) -> None:
    _, store, at = _store(spark, path)
    store.delete(at, True)


def not_null_or_all(df: DataFrame, columns: Iterable[str], how: str = "any") -> DataFrame:
    """Complete cases of the given columns only."""
    cols = list(columns)
    return df.select(*cols).na.drop(how)


def missing_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("n_missing"))
