"""Near-duplicate classes by min-max hashing: links of similarity 0.85 or more between sets of three-word shingles.

1. A text's words are lower-cased (A to Z) and hashed; of its distinct shingles each of PERMUTATIONS permutations (a product with
   an odd factor) is evaluated once, and both its least and its largest product are kept. Both are unbiased estimates of
   similarity, and since they are drawn without replacement their mean varies less than that of two permutations, at half the
   evaluations. A band holds values of different permutations. Texts with equal shingle sets are one node.
2. Nodes that agree in a band are candidates. First every node is compared with the least node of each of its bands (a star, so
   a bucket of any size costs one comparison a node); what these links join is a class already.
3. What is left are pairs of a bucket whose nodes lie in different classes. Buckets of one class are done. In others, a class with
   many nodes has blocks of its own, the rest share blocks; every pair of blocks that are not of one class is a unit of work,
   bounded in nodes and shingles. So a bucket of common near copies costs as many rows as it has nodes, times the blocks of
   others, not the square of its size. Pairs are never rows.
4. In a unit, pairs that agree in too few values are dropped (a pair at the threshold is with probability 1e-9), a pair belongs
   to the first band in which it agrees, pairs that links join already are skipped, and all others are verified on whole sets.
5. Connected components of all links.

A link at the threshold itself shares no band with probability (1 - 0.85^4)^18 = 2e-6; no cap applies anywhere.

Defined results: null counts as empty; texts without words have no shingles, no links and are not copies of each other; fewer
words than three are one shingle. Repeated rows are copies; a null doc_id is never the smallest; a class without any other has a
null id. Ties need no rule: classes do not depend on the order of comparisons. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import chunks, texts_of, written
from panelwise.llm.components import components
from panelwise.llm.textarrays import mixed, windows, words

SHINGLE = 3
#: Links: NUMERATOR / DENOMINATOR of the union, in whole numbers.
NUMERATOR, DENOMINATOR = 85, 100
BANDS, ROWS = 18, 4
VALUES = BANDS * ROWS
PERMUTATIONS = VALUES // 2
#: Chance that a pair at the threshold is dropped for agreeing in too few values.
TOLERANCE = 1e-9
#: Bounds of a block: nodes, and shingles of its nodes together.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1_000_000
CHUNK = 150_000

FACTORS = mixed(np.arange(101, 101 + PERMUTATIONS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def least_matches(threshold: float = NUMERATOR / DENOMINATOR, tolerance: float = TOLERANCE) -> int:
    """Equal values that a pair at the threshold has but with probability `tolerance`."""
    total = 0.0
    for m in range(VALUES + 1):
        total += math.comb(VALUES, m) * threshold**m * (1 - threshold) ** (VALUES - m)
        if total >= tolerance:
            return m
    return VALUES


NEEDED = least_matches()


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    lower = [t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for t in texts]
    for a, b in chunks(lower, CHUNK):
        hashes, _, _, of_text = words(lower[a:b])
        shingles, many = windows(hashes, of_text, SHINGLE)
        for e, m in zip(np.cumsum(many), many, strict=True):
            yield np.unique(shingles[e - m : e])


def min_max(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x VALUES): upper halves of the least products with each factor, then of the largest; sets must not be empty."""
    out = np.empty((len(sets), VALUES), np.uint32)
    if sets:
        flat = np.concatenate(sets)
        sizes = np.array([len(s) for s in sets])
        begins = np.cumsum(sizes) - sizes
        for k in range(PERMUTATIONS):
            products = flat * FACTORS[k]
            out[:, k] = np.minimum.reduceat(products, begins) >> np.uint64(32)
            out[:, PERMUTATIONS + k] = np.maximum.reduceat(products, begins) >> np.uint64(32)
    return out


def _text_key(text: str = "text"):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, set_key, signature) of every row; the last two are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            n, keys, values = [], [], []
            for a, b in chunks(texts, CHUNK):
                sets = list(shingle_sets(texts[a:b]))
                signed = iter(min_max([s for s in sets if len(s)]))
                for s in sets:
                    n.append(len(s))
                    keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                    values.append(next(signed).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())],
                ["doc_id", "text_key", "n", "set_key", "signature"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_key().alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_key binary, n bigint, set_key binary, signature binary")


def nodes_of(signed: DataFrame) -> DataFrame:
    """(node, set_key, first_id, source_id, source_key, n, signature): one row a distinct set, and a row whose text has it."""
    rows = signed.where("n > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("text_key", F.col("doc_id").isNull(), "doc_id")).alias("source"),
        F.any_value("n").alias("n"), F.any_value("signature").alias("signature"),
    )
    rows = rows.select("set_key", "first_id", F.col("source.doc_id").alias("source_id"), F.col("source.text_key").alias("source_key"), "n", "signature")
    return written(rows.withColumn("node", F.monotonically_increasing_id()), "minmax-nodes")


def members(nodes: DataFrame) -> DataFrame:
    """(key, band, node, n, pivot) of every band that several nodes share; pivot is the least of them."""
    rows = nodes.select("node", "n", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "signature")
    rows = rows.select("node", "n", "band", F.xxhash64("band", F.expr(f"substring(signature, band * {4 * ROWS} + 1, {4 * ROWS})")).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where("size > 1").select("key", "pivot")
    # Written summaries leave joins plain, so partitions of hot keys can be split at run time.
    return rows.join(written(shared, "minmax-shared"), "key").select("key", "band", "node", "n", "pivot")


def _slices(nodes: str, shingles: str):
    return F.greatest(F.ceil(F.col(nodes) / BLOCK_NODES), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


UNIT = ["key", "band", "first", "second"]
UNIT_ROWS = "key bigint, band int, first bigint, second bigint, side int, node bigint, root bigint"


def stars(shared: DataFrame) -> DataFrame:
    """Units that compare every node with the pivots of its bands: a pivot (side 0) and a slice of its nodes (side 1)."""
    pairs = shared.where("node <> pivot").groupBy("pivot", "node").agg(F.any_value("n").alias("n"))
    pairs = written(pairs, "minmax-stars")
    slices = pairs.groupBy("pivot").agg(F.count("*").alias("size"), F.sum("n").alias("total")).select("pivot", _slices("size", "total").alias("slices"))
    slices = written(slices, "minmax-slices")
    fixed = [F.col("pivot").alias("key"), F.lit(-1).alias("band")]
    place = F.pmod(F.xxhash64("node"), F.col("slices"))
    leaves = pairs.join(slices, "pivot").select(*fixed, place.alias("first"), F.lit(0).cast("bigint").alias("second"), F.lit(1).alias("side"), "node", F.col("node").alias("root"))
    hubs = slices.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    hubs = hubs.select(*fixed, F.col("slice").cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("second"), F.lit(0).alias("side"), F.col("pivot").alias("node"), F.col("pivot").alias("root"))
    return leaves.unionByName(hubs)


def blocks(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Units that compare the nodes of a bucket that lie in different classes. roots: (node, root) of linked nodes."""
    rows = shared.select("key", "band", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_keys = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rows = written(rows.join(written(mixed_keys, "minmax-mixed-keys"), "key"), "minmax-mixed")
    # A class with many nodes in a bucket is a group of its own, all others are group -1.
    by_class = rows.groupBy("key", "root").agg(F.any_value("band").alias("band"), F.count("*").alias("size"), F.sum("n").alias("total"))
    by_class = written(by_class, "minmax-by-class").withColumn("group", F.when(_slices("size", "total") > 1, F.col("root")).otherwise(F.lit(-1)))
    large = by_class.where("group >= 0").select("key", "root", F.col("group").alias("own"))
    groups = by_class.groupBy("key", "group").agg(F.any_value("band").alias("band"), F.sum("size").alias("size"), F.sum("total").alias("total"))
    groups = written(groups.select("key", "group", "band", F.least(_slices("size", "total"), F.col("size").cast("int")).alias("slices")), "minmax-groups")
    placed = rows.join(large, ["key", "root"], "left").withColumn("group", F.coalesce("own", F.lit(-1).cast("bigint")))
    placed = placed.join(groups.select("key", "group", "slices"), ["key", "group"])
    # A block is named by its group and slice in one number; names only need to differ within a key.
    name = lambda slice_: F.when(F.col("group") < 0, slice_).otherwise(F.xxhash64("group", slice_))
    placed = placed.select("key", name(F.pmod(F.xxhash64("node"), F.col("slices"))).alias("block"), "node", "root")
    each = groups.select("key", "band", "group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices").cast("bigint") - 1)).alias("slice"))
    each = each.select("key", "band", "group", name(F.col("slice")).alias("block"))
    other = each.select("key", F.col("group").alias("group2"), F.col("block").alias("second"))
    pairs = each.withColumnRenamed("block", "first").join(other, "key").where("first <= second AND (group <> group2 OR group < 0)").select(*UNIT)
    left = placed.join(pairs.withColumn("block", F.col("first")), ["key", "block"]).withColumn("side", F.lit(0))
    right = placed.join(pairs.where("first < second").withColumn("block", F.col("second")), ["key", "block"]).withColumn("side", F.lit(1))
    return left.unionByName(right).select(*UNIT, "side", "node", "root")


def by_unit(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """What work gives for the rows of each unit, which are neighbours."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in UNIT], 1)
        cuts = [0, *(np.flatnonzero((unit[1:] != unit[:-1]).any(1)) + 1).tolist(), len(unit)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(unit[a].tolist())
            if waiting and now != last and (out := work(pa.Table.from_batches(waiting))) is not None:
                yield out
            waiting = [*(waiting if now == last else []), batch.slice(a, b - a)]
            last = now
    if waiting and (out := work(pa.Table.from_batches(waiting))) is not None:
        yield out


def unit_pairs(rows: pa.Table, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, partners) of a unit's pairs that agree in enough values, whose labels differ now, and that belong to this band."""
    values = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint32).reshape(-1, VALUES)
    side, sizes = rows["side"].to_numpy(), rows["n"].to_numpy()
    band, within = rows["band"][0].as_py(), rows["first"][0].as_py() == rows["second"][0].as_py() and rows["band"][0].as_py() >= 0
    right = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0):
        others = np.arange(i + 1, len(side)) if within else right
        least, most = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[(label[others] != label[i]) & (DENOMINATOR * least >= NUMERATOR * most)]
        same = values[others] == values[i]
        stay = same.sum(1) >= NEEDED
        if band >= 0:
            stay &= same.reshape(len(others), BANDS, ROWS).all(2).argmax(1) == band
        if stay.any():
            yield i, others[stay]


def candidates(rows: DataFrame) -> DataFrame:
    """Rows of units that take part in a pair that may be a link."""

    def work(unit: pa.Table) -> pa.RecordBatch | None:
        hit = np.zeros(len(unit), bool)
        for i, others in unit_pairs(unit, unit["root"].to_numpy()):
            hit[i] = True
            hit[others] = True
        return unit.filter(pa.array(hit)).combine_chunks().to_batches()[0] if hit.any() else None

    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT, "node").mapInArrow(lambda b: by_unit(b, work), f"{UNIT_ROWS}, n bigint, signature binary")


def verified(rows: DataFrame) -> DataFrame:
    """(a, b): links between nodes of units with whole shingle sets, as many as join what is linked."""

    def work(unit: pa.Table) -> pa.RecordBatch | None:
        raw = unit["shingles"].to_pylist()
        sizes = np.array([len(x) // 8 for x in raw], np.int64)
        flat, ends = np.frombuffer(b"".join(raw), np.uint64), np.cumsum(sizes)
        node, label = unit["node"].to_numpy(), unit["root"].to_numpy().copy()
        found: list[tuple[int, int]] = []
        for i, others in unit_pairs(unit, label):
            own, n = flat[ends[i] - sizes[i] : ends[i]], sizes[others]
            theirs = flat[np.repeat(ends[others] - np.cumsum(n), n) + np.arange(int(n.sum()))]
            at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            common = np.add.reduceat(own[at] == theirs, np.cumsum(n) - n, dtype=np.int64)
            for j in others[(NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (n + sizes[i])].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    found.append((node[i], node[j]))
        if not found:
            return None
        a, b = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT, "node").mapInArrow(lambda b: by_unit(b, work), "a bigint, b bigint")


def _sets(rows: DataFrame) -> DataFrame:
    """(node, shingles) of rows (node, text): sorted distinct hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return rows.mapInArrow(run, "node bigint, shingles binary")


def linked(units: DataFrame, nodes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Links (a, b) that a set of units shows."""
    signed = units.join(nodes.select("node", "n", "signature"), "node").select(*UNIT, "side", "node", "root", "n", "signature")
    kept = written(candidates(signed), f"minmax-{name}-candidates")
    wanted = kept.select("node").distinct().join(nodes.select("node", "source_id", "source_key"), "node")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("d"), _text_key().alias("t"), "text")
    texts = wanted.join(texts, F.col("source_id").eqNullSafe(F.col("d")) & (F.col("source_key") == F.col("t"))).select("node", "text").dropDuplicates(["node"])
    return written(verified(kept.join(_sets(texts), "node")), f"minmax-{name}-links")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text)."""
    signed = written(signatures(docs), "minmax-signatures")
    nodes = nodes_of(signed)
    shared = written(members(nodes), "minmax-members")
    first = linked(stars(shared), nodes, docs, "star")
    second = linked(blocks(shared, components(first)), nodes, docs, "block")
    roots = components(first.unionByName(second))
    found = nodes.select("node", "set_key", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = written(found, "minmax-classes")
    least = found.groupBy("root").agg(F.min("first_id").alias("class_id"))
    found = found.join(least, "root").select("set_key", "class_id")
    filled = signed.where("n > 0").select("doc_id", "n", "set_key").join(found, "set_key").select("doc_id", "n", "class_id")
    empty = signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("class_id"))
    return filled.unionByName(empty).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("class_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    )
