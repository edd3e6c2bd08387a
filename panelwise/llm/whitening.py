"""Whitening of embeddings with distributed block matrices.

1. Rows with a usable vector get whole numbers x = floor(SCALE * c) + SHIFT and are written with a running number: their place in
   the partition plus the rows of the partitions before it, so numbers have no gaps.
2. Sums give the mean S / n. A row's centred vector is (n * x - S) / n: the difference is exact in whole numbers, so nothing
   is lost to the size of the entries.
3. Centred rows, by number, become an MLlib BlockMatrix; its transpose times itself is the scatter matrix. The inner dimension of
   that product is split over tasks, as all of it goes into few blocks. MLlib plans a product by collecting the places of all
   blocks, so rows are taken in slabs of at most SLAB_BLOCKS blocks and the scatters added; what the driver gathers stays bounded.
4. eigh of scatter / n on the driver, dimension x dimension numbers.
5. Each slab times the whitening matrix (eigenvectors over the roots of their eigenvalues) projects its rows.
6. The covariance of what came out is measured again, centred and multiplied the same way, and compared with the identity.

Rows go from DataFrame to matrix and back within the JVM. Everything is read again from written tables if an executor is lost.

Defined results: vectors that are null, empty or hold null or non-finite entries are left out; of the others those of the most frequent
length count (of equally frequent ones the longest). Entries beyond 2^53 / SCALE in size are taken as that. deviation is null where it
exceeds a long. Components whose variance is zero in double precision cannot be whitened: their whitened is null, explained 0, and
identity_error leaves them out (null if none is left). Repeated rows count as often as they occur, ties of eigenvalues go by position,
an empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
ROWS_PER_BLOCK = 1024
#: Blocks of rows that one product takes; the driver holds their places.
SLAB_BLOCKS = 16_384


def usable(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector can be used; x is an array of longs."""
    c = F.col(vector).cast("array<double>")
    fine = F.forall(c, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))) & (F.size(c) > 0)
    rows = rows.select(F.col(id_column).cast("bigint").alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & fine)
    counts = rows.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("rows"))
    length = counts.agg(F.max_by("d", F.struct("rows", "d"))).first()[0]
    most = float(2**53)
    whole = lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(most)), F.lit(-most))) + SHIFT
    return rows.where(F.size("c") == (length or 0)).select("vec_id", F.transform("c", whole).alias("x"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows, written, with a column row from 0 without gaps."""
    placed = written(rows.withColumn("place", F.monotonically_increasing_id()), name)
    # Upper bits of a place are the partition, lower ones the row in it. One row a partition reaches the driver.
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).orderBy("part").collect()
    before, offsets = 0, []
    for part_number, many in counts:
        offsets.append((part_number, before))
        before += many
    offsets = rows.sparkSession.createDataFrame(offsets, "part bigint, before bigint")
    place_in = F.col("place") - F.shiftleft("part", 33)
    return placed.withColumn("part", part).join(offsets, "part").withColumn("row", F.col("before") + place_in).drop("part", "before", "place")


def block_matrix(rows: DataFrame, row: Column, vector: Column, dimension: int) -> BlockMatrix:
    """Vectors (arrays of doubles) by row number as distributed blocks of whole rows, kept until freed().

    A product reads the blocks of its factors several times; a lost one is made again from its rows.
    """
    indexed = rows.select(row.cast("bigint").alias("index"), array_to_vector(vector).alias("vector"))
    indexed = MLUtils.convertVectorColumnsFromML(indexed, "vector")
    return IndexedRowMatrix(indexed, 0, dimension).toBlockMatrix(ROWS_PER_BLOCK, dimension).persist(StorageLevel.MEMORY_AND_DISK)


def freed(m: BlockMatrix) -> None:
    m._java_matrix_wrapper._java_model.blocks().unpersist(False)


def multiplied(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a * b with its inner dimension split over that many groups of tasks, which BlockMatrix.multiply does not offer in Python."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def scatter(rows: DataFrame, n: int, vector: Column, dimension: int) -> np.ndarray:
    """Sum of the outer products of all rows' vectors."""
    total = np.zeros((dimension, dimension))
    for first, part in slabs(rows, n):
        m = block_matrix(part, F.col("row") - first, vector, dimension)
        splits = max(1, min(m.numRows() // ROWS_PER_BLOCK, part.sparkSession.sparkContext.defaultParallelism))
        total += multiplied(m.transpose(), m, splits).toLocalMatrix().toArray()
        freed(m)
    return (total + total.T) / 2


def slabs(rows: DataFrame, n: int) -> list[tuple[int, DataFrame]]:
    """(first row number, rows) of each slab; Parquet skips what lies outside, as numbers are written in order."""
    size = ROWS_PER_BLOCK * SLAB_BLOCKS
    return [(a, rows.where(F.col("row").between(a, min(a + size, n) - 1))) for a in range(0, n, size)]


def columns_sum(rows: DataFrame, vector: str, dimension: int) -> list:
    """Sums of an array's entries over all rows, in one pass."""
    return list(rows.agg(*[F.sum(F.col(vector)[i]).alias(f"s{i}") for i in range(dimension)]).first())


def whitened(rows: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, dict]:
    """(vec_id, n, deviation, y) of every usable row, and the model: mean, eigenvalues, explained, matrix, identity_error.

    y: the row's coordinates on the first components that have a variance, an array of doubles.
    """
    spark = rows.sparkSession
    placed = written(numbered(usable(rows, id_column, vector), "whitening-places"), "whitening-rows")
    n, dimension = placed.agg(F.count("*"), F.max(F.size("x"))).first()
    empty = spark.createDataFrame([], "vec_id bigint, n bigint, deviation bigint, y array<double>")
    if not n:
        return empty, {"eigenvalues": np.zeros(0), "explained": np.zeros(0), "identity_error": None}
    sums = columns_sum(placed, "x", dimension)
    exact = F.zip_with("x", F.array(*[F.lit(s).cast("bigint") for s in sums]), lambda x, s: F.try_subtract(F.try_multiply(F.lit(n).cast("bigint"), x), s))
    rows_ = placed.select("vec_id", "row", exact.alias("d"))
    centred = F.transform("d", lambda d: d.cast("double") / F.lit(float(n)))
    square = F.transform("d", lambda d: F.try_multiply(d, d))
    deviation = F.aggregate(square, F.lit(0).cast("bigint"), lambda a, b: F.try_add(a, b))

    values, vectors = np.linalg.eigh(scatter(rows_, n, centred, dimension) / n)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    least = values[0] * dimension * np.finfo(float).eps
    used = min(components, int((values > least).sum()))
    total = values.sum()
    explained = np.where(values > least, values, 0.0) / total if total else values
    model = {"mean": [s / n for s in sums], "eigenvalues": values, "explained": explained[:components], "identity_error": None}
    if not used:
        return rows_.select("vec_id", F.lit(n).cast("bigint").alias("n"), deviation.alias("deviation"), F.array().cast("array<double>").alias("y")), model
    matrix = vectors[:, :used] / np.sqrt(values[:used])
    model["matrix"] = matrix

    projected = None
    for first, part in slabs(rows_, n):
        m = block_matrix(part, F.col("row") - first, centred, dimension)
        by = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(dimension, used, matrix.ravel(order="F")))], 1), dimension, used)
        back = callMLlibFunc("getIndexedRows", m.multiply(by).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        back = MLUtils.convertVectorColumnsToML(back, "vector").select((F.col("index") + first).alias("row"), vector_to_array("vector").alias("y"))
        back = written(back, "whitening-projections")
        freed(m)
        projected = back if projected is None else projected.unionByName(back)
    out = rows_.select("vec_id", "row", F.lit(n).cast("bigint").alias("n"), deviation.alias("deviation")).join(projected, "row")
    out = written(out, "whitening-projected")

    mean = [s / n for s in columns_sum(out, "y", used)]
    moved = F.zip_with("y", F.array(*[F.lit(m) for m in mean]), lambda y, m: y - m)
    model["identity_error"] = float(np.abs(scatter(out, n, moved, used) / n - np.eye(used)).max())
    return out.select("vec_id", "n", "deviation", "y"), model


def report(rows: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each usable row and component."""
    found, model = whitened(rows)
    # Components without a variance keep their rows, without a value.
    explained = F.array(*[F.lit(float(e)) for e in model["explained"]]).cast("array<double>")
    each = found.select("vec_id", "n", "deviation", "y", F.posexplode(explained).alias("place", "explained"))
    error = F.lit(model["identity_error"]).cast("double")
    return each.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", F.get("y", F.col("place")).alias("whitened"), "explained",
        error.alias("identity_error"),
    )
