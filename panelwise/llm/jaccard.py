"""Similarity join on word shingles: MinHash candidates, Bayesian pruning, exact verification.

1. Every text gets MinHash values of its five-word shingles, in numpy, whole. Exact copies become one node (by digest).
2. Nodes whose values agree in all rows of a band are candidates. Only keys that several nodes share go on. A large bucket is
   cut into blocks by node, bounded in nodes and in shingles, and every pair of blocks is a task's unit of work, so no
   bucket meets in one place and pairs are never rows.
3. Within a unit, pairs are compared a few MinHash values at a time. With a uniform prior, the posterior probability that
   similarity reaches the threshold after m of n matches is P(Binomial(n + 1, threshold) <= m); a pair whose posterior
   falls below the tolerance is dropped. A pair belongs to the first band in which it agrees, so it counts once.
4. Nodes with a pair left are joined with the shingles of their text, and those pairs are verified exactly.
5. Links are summed per node; a spanning forest of each unit's links gives the classes by connected components.

At similarity 0.8, 24 bands of 4 values miss a pair with probability 3e-6; no cap applies anywhere. Texts of under five words
are one shingle; texts without words (null, empty, blank) have no links, but exact copies of each other share a class, and null
counts as empty. Repeated rows are copies.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import chunks, spare, texts_of, written
from panelwise.llm.components import components
from panelwise.llm.textarrays import mixed, windows, words

SHINGLE = 5
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
STEP = 8
TOLERANCE = 1e-6
#: Similarity threshold as a fraction, so that verification is in whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
#: Bounds of a block of a bucket: nodes, and shingles of its nodes together.
BLOCK_NODES, BLOCK_SHINGLES = 2048, 2_000_000
CHUNK = 150_000

FACTORS = (mixed(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)).astype(np.uint64)


def least_matches(threshold: float = NUMERATOR / DENOMINATOR, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, m): after n compared values a pair needs at least m matches to stay."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total = 0.0
        for m in range(n + 2):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append((n, m))
    return out


NEEDED = least_matches()


def minhash(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """(texts x VALUES) upper halves of the least products with each factor; texts without shingles get the largest value."""
    out = np.full((len(many), VALUES), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(many)
    if len(filled):
        begins = (np.cumsum(many) - many)[filled]
        for k in range(VALUES):
            out[filled, k] = (np.minimum.reduceat(hashes * FACTORS[k], begins) >> np.uint64(32)).astype(np.uint32)
    return out


def digest(text: Column | str = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(F.coalesce(c, F.lit("")).cast("binary")))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n, signature) of every row: number of shingles, and MinHash values as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            counts, values = [], []
            for a, b in chunks(texts, CHUNK):
                hashes, _, _, of_text = words(texts[a:b])
                shingles, many = windows(hashes, of_text, SHINGLE)
                counts.append(many)
                values += [x.tobytes() for x in minhash(shingles, many)]
            n = np.concatenate([np.zeros(0, np.int64), *counts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(n, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "digest", "n", "signature"]
            )

    rows = docs.select("doc_id", digest().alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id bigint, digest binary, n bigint, signature binary")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(node, shingles): sorted distinct shingle hashes as bytes, of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = texts_of(batch), []
            for a, b in chunks(texts, CHUNK):
                hashes, _, _, of_text = words(texts[a:b])
                shingles, many = windows(hashes, of_text, SHINGLE)
                ends = np.cumsum(many)
                out += [np.unique(shingles[e - m : e]).tobytes() for e, m in zip(ends, many, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["node", "shingles"])

    return rows.mapInArrow(run, "node bigint, shingles binary")


UNIT = ["key", "band", "first", "second"]


def by_unit(batches: Iterator[pa.RecordBatch], work: Callable[[int, bool, pa.RecordBatch], None], flush: Callable[[], pa.RecordBatch | None]):
    """Hand the rows of each unit, which are neighbours, to work(band, within one block, rows); yield what flush gives."""
    waiting: list[pa.RecordBatch] = []
    last = None

    def close() -> None:
        rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        work(rows["band"][0].as_py(), rows["first"][0].as_py() == rows["second"][0].as_py(), rows)
        waiting.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        unit = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in UNIT], 1)
        cuts = [0, *(np.flatnonzero((unit[1:] != unit[:-1]).any(1)) + 1).tolist(), len(unit)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(unit[a].tolist())
            if waiting and now != last:
                close()
            last = now
            waiting.append(batch.slice(a, b - a))
        if (out := flush()) is not None:
            yield out
    if waiting:
        close()
    if (out := flush()) is not None:
        yield out


def owned_pairs(values: np.ndarray, block: np.ndarray, within: bool, band: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, partners j) of the pairs that stay after Bayesian pruning and that agree first in this band."""
    n = len(values)
    for i in range(n - 1):
        others = np.arange(i + 1, n)
        if not within:
            others = others[block[others] != block[i]]
        matches, compared = np.zeros(len(others), np.int64), 0
        for upto, needed in NEEDED:
            if not len(others):
                break
            matches += (values[others, compared:upto] == values[i, compared:upto]).sum(1)
            stay = matches >= needed
            others, matches, compared = others[stay], matches[stay], upto
        if len(others):
            agree = (values[others] == values[i]).reshape(len(others), BANDS, ROWS).all(2)
            others = others[agree.argmax(1) == band]
            if len(others):
                yield i, others


def units(reps: DataFrame) -> DataFrame:
    """(key, band, first, second, block, node, signature): nodes of every shared band key, dealt to pairs of blocks."""
    bands = reps.where("n > 0").select("node", "n", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "signature")
    part = F.expr(f"substring(signature, band * {4 * ROWS} + 1, {4 * ROWS})")
    bands = bands.select("node", "n", "band", F.xxhash64("band", part).alias("key"))
    shared = bands.groupBy("key", "band").agg(F.count("*").alias("size"), F.sum("n").alias("total")).where("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_NODES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    blocks = F.least(blocks, F.col("size").cast("int"))
    members = bands.join(shared.select("key", "band", blocks.alias("blocks")), ["key", "band"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = members.select("key", "band", "node", "blocks", block.alias("block"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("key", "band", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node")
    return members.join(reps.select("node", "signature"), "node")


def candidates(reps: DataFrame) -> DataFrame:
    """Rows of units() that take part in a pair that pruning keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.RecordBatch] = []

        def work(band: int, within: bool, rows: pa.RecordBatch) -> None:
            values = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint32).reshape(-1, VALUES)
            hit = np.zeros(len(values), bool)
            for i, others in owned_pairs(values, rows["block"].to_numpy(), within, band):
                hit[i] = True
                hit[others] = True
            if hit.any():
                done.append(rows.take(pa.array(np.flatnonzero(hit))))

        def flush() -> pa.RecordBatch | None:
            if not done:
                return None
            out = pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            done.clear()
            return out

        yield from by_unit(batches, work, flush)

    schema = "key bigint, band int, first int, second int, block int, node bigint, signature binary"
    rows = units(reps).select("key", "band", "first", "second", "block", "node", "signature")
    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT, "node").mapInArrow(run, schema)


def verified(rows: DataFrame) -> DataFrame:
    """(node, links, other) of rows of units() with shingles: number of links found in a unit, or an edge of its forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def work(band: int, within: bool, rows: pa.RecordBatch) -> None:
            values = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint32).reshape(-1, VALUES)
            raw = rows["shingles"].to_pylist()
            sizes = np.array([len(x) // 8 for x in raw], np.int64)
            flat, ends = np.frombuffer(b"".join(raw), np.uint64), np.cumsum(sizes)
            node, links, label = rows["node"].to_numpy(), np.zeros(len(values), np.int64), np.arange(len(values))
            edges: list[tuple[int, int]] = []
            for i, others in owned_pairs(values, rows["block"].to_numpy(), within, band):
                own = flat[ends[i] - sizes[i] : ends[i]]
                n = sizes[others]
                place = np.repeat(ends[others] - np.cumsum(n), n) + np.arange(int(n.sum()))
                theirs = flat[place]
                at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                common = np.add.reduceat(own[at] == theirs, np.cumsum(n) - n, dtype=np.int64)
                near = others[(NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (n + sizes[i])]
                links[i] += len(near)
                links[near] += 1
                for j in near[label[near] != label[i]].tolist():
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        edges.append((i, j))
            hit = np.flatnonzero(links)
            if len(hit):
                found.append((node[hit], links[hit], node[hit]))
                e = np.array(edges, np.int64)
                found.append((node[e[:, 0]], np.zeros(len(e), np.int64), node[e[:, 1]]))

        def flush() -> pa.RecordBatch | None:
            if not found:
                return None
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["node", "links", "other"])

        yield from by_unit(batches, work, flush)

    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT, "node").mapInArrow(run, "node bigint, links bigint, other bigint")


def representatives(signed: DataFrame) -> DataFrame:
    """(node, digest, first_id, repeats, copies, n, signature): one row for each distinct text; repeats counts its rows of first_id."""
    same = signed.groupBy("digest", "doc_id").agg(F.count("*").alias("repeats"), F.any_value("n").alias("n"), F.any_value("signature").alias("signature"))
    rows = same.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "repeats")).alias("first"), F.sum("repeats").alias("copies"),
        F.any_value("n").alias("n"), F.any_value("signature").alias("signature"),
    )
    rows = rows.select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.repeats").alias("repeats"), "copies", "n", "signature")
    return written(rows.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")


def joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, digest) and nodes (node, digest, first_id, repeats, copies, links, root): root is the same for all nodes of a class."""
    signed = written(signatures(docs), "jaccard-signatures")
    reps = representatives(signed)
    kept = written(candidates(reps), "jaccard-candidates")
    wanted = kept.select("node").distinct().join(reps.select("node", "first_id", "digest"), "node")
    text = docs.select(F.col("doc_id").alias("d"), digest().alias("g"), "text")
    texts = wanted.join(text, F.col("first_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))).select("node", "text").dropDuplicates(["node"])
    found = written(verified(kept.join(shingle_sets(texts), "node")), "jaccard-links")
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("links = 0").select("node", "other"))
    nodes = reps.select("node", "digest", "first_id", "repeats", "copies").join(links, "node", "left").join(roots, "node", "left")
    return signed.select("doc_id", "digest"), nodes.withColumns({"links": F.coalesce("links", F.lit(0)), "root": F.coalesce("root", "node")})


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every document.

    class_id: the smallest doc_id of all documents that links and copies connect. n_links: other distinct texts of
    similarity 0.8 or more. n_copies: documents with exactly this text, itself included.
    """
    rows, nodes = joined(docs)
    nodes = written(nodes, "jaccard-classes")
    least = nodes.groupBy("root").agg(F.min("first_id").alias("class_id"))
    nodes = nodes.join(least, "root").select("digest", "class_id", F.col("links").alias("n_links"), F.col("copies").alias("n_copies"))
    return rows.join(nodes, "digest").select("doc_id", "class_id", "n_links", "n_copies")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs for each class: of its smallest doc_id (then its smallest node). All columns stay."""
    _, nodes = joined(docs)
    best = nodes.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "node", "digest", "repeats")).alias("best"))
    kept_id, kept_digest, repeats, own = (spare(docs, c) for c in ("kept_id", "kept_digest", "repeats", "own_digest"))
    best = best.select(F.col("best.first_id").alias(kept_id), F.col("best.digest").alias(kept_digest), F.col("best.repeats").alias(repeats))
    best = written(best, "jaccard-kept")
    kept = docs.withColumn(own, digest()).join(best, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_digest)))
    # Only rows that equal others in id and text need another look.
    single = kept.where(F.col(repeats) == 1).select(*docs.columns)
    repeated = kept.where(F.col(repeats) > 1).dropDuplicates([kept_id, kept_digest]).select(*docs.columns)
    return single.unionByName(repeated)
