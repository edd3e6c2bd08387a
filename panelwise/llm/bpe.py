"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In a round, every adjacent pair of symbols is looked up by binary search
in the sorted array of merge keys; each word merges all occurrences of its pair of lowest rank (from the left where they
overlap). Words that have no mergeable pair leave the array, so later rounds work on the rest only.

Texts are first cut at white space; the pieces between are few and repeat, so a bounded cache of each Python worker keeps
their ids. Encoding equals the tokenizers library: special tokens in a text become their ids, all else ordinary text.
Null and empty texts have no tokens. Nothing depends on other rows, so no shuffle is needed.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelwise.llm.common import CHUNK_CHARS, chunks, texts_of

# Fixed values of the vocabulary format: white space, the pattern of pieces, the bytes that stand for themselves.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]

#: Cached pieces of one Python worker; the cache starts anew when it is full.
CACHE_PIECES = 200_000
#: Longer pieces are not cached.
CACHE_CHARS = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file."""
    out, extra = [], 0
    for b in range(256):
        if b in PRINTABLE:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class BytePairs:
    """A vocabulary and its merges as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)[order]
        self.none = len(merges)
        back = {c: i for i, c in enumerate(letters)}
        names = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        names |= {i: t.encode() for t, i in self.special.items()}
        size = max(names) + 1
        self.token_lengths = np.array([len(names.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.token_starts = np.concatenate([[0], np.cumsum(self.token_lengths)])[:-1]
        self.token_bytes = np.frombuffer(b"".join(names.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.outer = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.inner = regex.compile(PIECES)
        self.at_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each word."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbol = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            inside = word[:-1] == word[1:]
            rank = np.where(inside & (self.keys[at] == key), self.ranks[at], self.none) if self.none else np.zeros(0, np.int64)
            rank = np.append(rank, self.none)
            begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.append(begins, len(word)))
            going = np.repeat(least < self.none, sizes)
            if not going.all():
                done.append((word[~going], symbol[~going]))
            if not going.any():
                break
            hit = going & (rank == np.repeat(least, sizes))
            # Of occurrences that overlap, every other one counts, from the left.
            index = np.arange(len(hit))
            starts = hit & ~np.concatenate([[False], hit[:-1]])
            run = np.maximum.accumulate(np.where(starts, index, 0))
            hit &= (index - run) % 2 == 0
            places = np.flatnonzero(hit)
            symbol[places] = self.made[at[places]]
            keep = going
            keep[places + 1] = False
            symbol, word = symbol[keep], word[keep]
        words_of, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(words_of, kind="stable")
        return ids[order], np.bincount(words_of, minlength=len(words))

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids, as little-endian 32-bit bytes, of pieces between white space."""
        inner = [self.inner.findall(p) for p in pieces]
        words = list(dict.fromkeys(w for ws in inner for w in ws))
        ids, counts = self.merge([w.encode("utf-8", "surrogatepass") for w in words])
        flat, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
        known = {w: flat[e - 4 * c : e] for w, c, e in zip(words, counts.tolist(), ends.tolist(), strict=True)}
        return {p: b"".join([known[w] for w in ws]) for p, ws in zip(pieces, inner, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list[str]] = []
        for t in texts:
            parts = self.at_special.split(t) if self.at_special and any(s in t for s in self.special) else [t]
            # split() leaves special tokens at the odd places; they are kept apart from text as tuples.
            cut.append([x for i, part in enumerate(parts) for x in ([(part,)] if i % 2 else self.outer.findall(part))])
        unseen = {p for pieces in cut for p in pieces if isinstance(p, str) and p not in self.cache}
        ids = self.cache
        if unseen:
            fresh = self.learn(list(unseen))
            if len(self.cache) + len(fresh) > CACHE_PIECES:
                ids = self.cache | fresh
                self.cache = {}
            else:
                self.cache.update((p, i) for p, i in fresh.items() if len(p) <= CACHE_CHARS)
                ids = self.cache if all(len(p) <= CACHE_CHARS for p in fresh) else self.cache | fresh
        special = {t: np.array([i], dtype="<u4").tobytes() for t, i in self.special.items()}
        return [b"".join([ids[p] if isinstance(p, str) else special[p[0]] for p in pieces]) for pieces in cut]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of encoded ids; special tokens are written out, bytes that are no UTF-8 become U+FFFD."""
        flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)
        lengths = self.token_lengths[flat]
        ends = np.cumsum(lengths)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.token_starts[flat] - (ends - lengths), lengths)
        raw = self.token_bytes[place].tobytes()
        upto = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(upto, upto[1:], strict=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> BytePairs:
    return BytePairs(path)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<long>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = texts_of(batch, text_column)
            for a, b in chunks(texts, CHUNK_CHARS):
                ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in bpe.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(id_column).slice(a, b - a), pa.array(ids, pa.list_(pa.int64()))], [id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<bigint>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = texts_of(batch)
            rows = []
            for a, b in chunks(texts, CHUNK_CHARS):
                ids = bpe.encode(texts[a:b])
                for i, back in zip(ids, bpe.decode(ids), strict=True):
                    rows.append((len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()))
            n, first, second = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, out)
