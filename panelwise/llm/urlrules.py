"""URL filter over a sorted digest array.

Rules (host, path, verdict) become shards of 64-bit xxhash keys in ascending order with their full strings, written once to
the shared folder by a range-partitioned Spark job. Every Python worker maps the shards into memory and probes them by
vectorised binary search; a key that is found counts only if the stored string equals the probe, so collisions do no harm.

A rule fits its host and all subdomains of it if the url's path starts with the rule's path; the longest rule (host and
path together, then host) wins. Probes of a url are its host's suffixes at dots, each with the path's prefixes of the
lengths that occur among the rules. Equal rules with both verdicts block. Urls without a fitting rule get `default`.
A null url, or one without "://", has an empty host and path and fits no rule.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import shared_folder

#: Seed of Spark's own xxhash64, so that both sides make the same keys.
SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_RULES = 2_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def build(rules: DataFrame) -> str:
    """Write the index of the rules and return its folder. Rules without a host, or with a null, are left out."""
    spark = rules.sparkSession
    folder = shared_folder(spark, "urlrules")
    block = (F.col("verdict") == "block").cast("int")
    host = F.translate("host", UPPER, LOWER)
    keyed = (
        rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .groupBy(host.alias("host"), "path")
        .agg(F.max(block).cast("int").alias("block"))
        .select(F.xxhash64(F.concat("host", "path")).alias("key"), "host", "path", "block")
    )
    shards = max(1, -(-keyed.count() // SHARD_RULES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        hosts, paths = rows["host"].to_pylist(), rows["path"].to_pylist()
        full = [(h + p).encode() for h, p in zip(hosts, paths, strict=True)]
        lengths = sorted({len(p) for p in paths})
        head = np.array([len(full)], np.int64)
        keys = rows["key"].to_numpy().astype(np.int64)
        ends = np.cumsum([len(x) for x in full]).astype(np.int64)
        host_lengths = np.array([len(h.encode()) for h in hosts], np.int64)
        blocks = rows["block"].to_numpy().astype(np.int64)
        part = TaskContext.get().partitionId()
        name = f"{part:05d}-{TaskContext.get().taskAttemptId()}.digests"
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        with store.open_output_stream(f"{root}/{name}") as out:
            for x in (head, keys, ends, host_lengths, blocks):
                out.write(x.tobytes())
            out.write(b"".join(full))
        yield pa.RecordBatch.from_pydict({"name": [name], "first": [int(keys[0])], "lengths": [json.dumps(lengths)]})

    made = (
        keyed.repartitionByRange(shards, "key").sortWithinPartitions("key", "host").mapInArrow(write, "name string, first bigint, lengths string")
    ).collect()  # one row for each shard; a shard written twice is named by the attempt that succeeded
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    made.sort(key=lambda r: r.first)
    lengths = sorted({n for r in made for n in json.loads(r.lengths)})
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"shards": [(r.name, r.first) for r in made], "path_lengths": lengths}).encode())
    return folder


class Digests:
    """The shards of an index, mapped into memory."""

    def __init__(self, folder: str):
        store, root = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{root}/manifest.json") as f:
            manifest = json.loads(f.read())
        self.path_lengths = manifest["path_lengths"]
        self.firsts = np.array([first for _, first in manifest["shards"]], np.int64)
        self.shards = [self.mapped(store, f"{root}/{name}") for name, _ in manifest["shards"]]

    @staticmethod
    def mapped(store: fs.FileSystem, path: str) -> tuple[np.ndarray, ...]:
        """A nameless local copy serves as the map, as the shared store may have no files to map; it goes with the worker."""
        with tempfile.TemporaryFile() as copy:
            with store.open_input_stream(path) as f:
                while block := f.read(1 << 22):
                    copy.write(block)
            copy.flush()
            raw = np.memmap(copy, dtype=np.uint8, mode="r")
        n = int(raw[:8].view(np.int64)[0])
        part = [raw[8 + 8 * n * i : 8 + 8 * n * (i + 1)].view(np.int64) for i in range(4)]
        return (*part, raw[8 + 32 * n :])

    def probe(self, probes: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(number of the probe, host bytes, 1 if it blocks) of each probe that is a rule."""
        keys = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in probes), np.uint64, len(probes)).view(np.int64)
        # Equal keys may be split over two shards; a key that equals the first of a shard is also looked up in the one before.
        last = np.searchsorted(self.firsts, keys, "right") - 1
        first = np.maximum(np.searchsorted(self.firsts, keys, "left") - 1, 0)
        for s, (stored, ends, host_lengths, blocks, strings) in enumerate(self.shards):
            mine = np.flatnonzero((first <= s) & (s <= last))
            at = np.searchsorted(stored, keys[mine], "left")
            while len(mine):
                fits = (at < len(stored)) & (stored[np.minimum(at, len(stored) - 1)] == keys[mine])
                mine, at = mine[fits], at[fits]
                for i, k in zip(mine.tolist(), at.tolist(), strict=True):
                    if strings[ends[k - 1] if k else 0 : ends[k]].tobytes() == probes[i]:
                        yield i, int(host_lengths[k]), int(blocks[k])
                at = at + 1

    def match(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, bool]]:
        """The longest rule that fits each (host, path), and whether it blocks."""
        probes: list[bytes] = []
        owner: list[tuple[int, int]] = []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            suffix = host
            while suffix:
                for n in self.path_lengths:
                    if n <= len(path):
                        probes.append((suffix + path[:n]).encode())
                        owner.append((i, len(suffix.encode())))
                _, _, suffix = suffix.partition(".")
        best: dict[int, tuple[int, int, bytes, int]] = {}
        for k, host_bytes, blocks in self.probe(probes) if probes and self.shards else ():
            i, own = owner[k]
            if own == host_bytes:  # the same string may be cut into host and path elsewhere
                found = (len(probes[k]), host_bytes, probes[k], blocks)
                best[i] = max(best.get(i, found), found)
        return [(best[i][2].decode(), bool(best[i][3])) if i in best else (None, False) for i in range(len(hosts))]


@lru_cache(maxsize=4)
def digests(folder: str) -> Digests:
    return Digests(folder)


def judge(pages: DataFrame, index: str, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    host, path = host_and_path(F.col(url_column))
    kind = pages.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = digests(index)
        for batch in batches:
            found = rules.match(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            verdicts = [default if rule is None else "block" if blocks else "allow" for rule, blocks in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column), batch.column("host"), batch.column("path"), pa.array([r for r, _ in found], pa.string()), pa.array(verdicts, pa.string())],
                [id_column, "host", "path", "rule", "verdict"],
            )

    urls = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    return urls.mapInArrow(run, f"`{id_column}` {kind}, host string, path string, rule string, verdict string")
