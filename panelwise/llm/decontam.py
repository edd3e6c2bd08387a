"""Benchmark decontamination: CGK embedding of characters, repeated bit-sampling LSH, gram counts, exact edit distance.

A CGK walk reads a text at a place that moves on, or stays, by a random bit of the character read and of the step; here a
place is read at most twice in a row. The characters it reads are the embedding of the window that begins at its first place:
two windows of small edit distance mostly read alike, as the walks come into step again soon after an edit. A key is a sample
of the places of an embedding, so a walk may read edited characters between the sampled ones.

Items are put into classes of doubling length. Windows begin at each character of an item, and in documents at each, every second
or every third one. How many places are sampled, how many samples are taken, of how many embeddings, and how far apart the windows
of documents lie, is measured when the index is made: the cheapest of PLANS that finds TARGET of the class's own items again
after `rate` of their characters is edited, at even distances, at random places, or with insertions and deletions. Classes of
the same plan share their tables. A window spans some 18 characters, not the whole item: after a fifth of them is edited,
walks of item length are out of step for most of their way.

Equal keys make a candidate place. Candidates pass if the least edit distances of the item's pieces of a machine word add up to
no more than the allowed edits (Myers' bit-parallel method, for all candidates at once), if the text around has as many of the
item's grams, near their places, as these edits leave for certain, and if the whole item's distance may be small enough;
the item is then searched there by the exact edit distance in characters, allowing `rate` of its length.

The index of the items is bounded: a benchmark of more than PART_CHARS characters is dealt to several passes over the
documents by hash of the item. Documents are read whole, in chunks, and nothing is shuffled. Comparison is in lower case and
white space counts as one blank. Items of under four words say too little and match nothing; null texts match nothing;
repeated items are reported each; repeated documents are judged each for themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import add_from_text, chunks, code_points, spare, texts_of

RATE = 0.2
#: Share of a class's own items, edited at the full rate in each of EDITS, that its keys have to find again.
TARGET = 0.97
EDITS = ("spread", "random", "mixed")
#: Items of a class that are edited to measure that share, and random beginnings of documents around each.
TRIALS = 48
#: (sampled places of an embedding, embeddings, samples of each, distance of windows in documents), cheapest first.
PLANS = [(14, 1, 2, 3), (12, 1, 2, 3), (12, 1, 3, 3), (12, 1, 3, 2), (11, 1, 4, 2), (10, 1, 3, 2), (10, 1, 5, 2), (9, 1, 4, 2), (10, 1, 3, 1), (9, 1, 4, 1), (8, 2, 4, 1), (7, 2, 5, 1), (6, 3, 5, 1), (5, 4, 5, 1), (4, 6, 5, 1), (3, 6, 4, 1)]
#: Grams counted in candidates; fewest words of an item.
WIDTHS = (3, 4)
LEAST_WORDS = 4
#: Characters of benchmark texts in one pass.
PART_CHARS = 20_000_000
CHUNK = 2_000_000
#: Windows embedded at once, candidates counted, compared whole and by pieces at once, characters in a piece, and bits of a gram's hash.
BLOCK = 1 << 15
BATCH = 64
NEAR = 1024
CLOSE = 2048
#: Up to so many candidates are searched one by one sooner than they are screened together.
FEW = 200
PIECE = 64
GRAM_BITS = 12
PIECES = 8
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def needed(lengths: np.ndarray, width: int, rate: float) -> np.ndarray:
    """Grams of an item that a passage has for certain: an edit touches `width` of them at most."""
    return lengths - width + 1 - width * (rate * lengths).astype(np.int64)


@lru_cache(maxsize=64)
def moves(steps: int, repeat: int) -> np.ndarray:
    """Whether the walk moves on, for each step and symbol; a symbol that stays at an even step moves at the next one."""
    bits = np.random.default_rng([steps, repeat]).integers(0, 2, (steps + 1, 256))
    bits[1::2] = 1 - bits[0 : len(bits) - len(bits) % 2 : 2]
    return bits


@lru_cache(maxsize=256)
def sampled(steps: int, places: int, walk: int, sample: int) -> tuple[int, ...]:
    """Places of an embedding of that many steps that make a key."""
    return tuple(sorted(np.random.default_rng([steps, places, walk, sample]).choice(steps, places, replace=False).tolist()))


def symbols_of(codes: np.ndarray) -> np.ndarray:
    return ((codes ^ (codes >> np.uint32(8)) * np.uint32(31)) & np.uint32(255)).astype(np.uint8)


def grams(symbols: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the characters from each place on; `width` - 1 places of padding are at the end."""
    size = len(symbols) - width + 1
    x = np.zeros(size, np.uint32)
    for k in range(width):
        x = x * np.uint32(0x9E3779B1) + symbols[k : k + size]
    return ((x * np.uint32(0x85EBCA77)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)


def embedded(symbols: np.ndarray, starts: np.ndarray, steps: int, walk: int) -> tuple[list[np.ndarray], np.ndarray]:
    """CGK embeddings of the windows from `starts`, one array a step, and the last places read; symbols end in `steps` places of padding."""
    moved = moves(steps, walk)
    at = starts.astype(np.int64)
    reads = []
    for step in range(steps):
        read = symbols.take(at)
        reads.append(read)
        if step < steps - 1:
            at += moved[step].take(read)
    return reads, at


def keys(reads: list[np.ndarray], places: tuple[int, ...]) -> np.ndarray:
    """Keys of the sampled places of embeddings."""
    key = np.full(len(reads[0]), places[0], np.uint64)
    for k in places:
        key *= FACTOR
        key += reads[k]
    key *= FACTOR
    key ^= key >> np.uint64(29)
    key *= FACTOR
    return key


def edited(text: str, rate: float, kind: str, rng: np.random.Generator, others: str) -> str:
    """The text with rate * length of its characters edited: every n-th one, or at random places, substituted or of all kinds."""
    n = int(rate * len(text))
    if kind == "spread":
        places = (np.arange(n) * len(text) // max(n, 1) + rng.integers(0, max(len(text) // max(n, 1), 1))) % max(len(text), 1)
    else:
        places = rng.choice(len(text), n, replace=False)
    out = list(text)
    for k in places.tolist():
        how = rng.integers(3) if kind == "mixed" else 0
        new = others[rng.integers(len(others))]
        while new == out[k] and how == 0 and len(set(others)) > 1:
            new = others[rng.integers(len(others))]
        out[k] = ("" if how == 1 else new) if how < 2 else out[k] + new
    return "".join(out)


def plan_of(texts: list[str], rate: float) -> tuple[int, int, int, int]:
    """The cheapest of PLANS whose keys find TARGET of the items again after each kind of edits, measured on the class's own items."""
    rng = np.random.default_rng(len(texts))
    some = [texts[i] for i in np.linspace(0, len(texts) - 1, min(TRIALS, len(texts))).astype(int)]
    some = some * -(-TRIALS // len(some))
    others = "".join(some)
    kinds = EDITS if rate > 0 else EDITS[:1]
    cases = [(x, edited(x, rate, kind, rng, others)) for kind in kinds for x in some]
    pad = np.zeros(2 * PLANS[0][0] + 3, np.uint32)
    sides = []
    for side in (0, 1):
        codes, begins = code_points([c[side] + "\n" for c in cases])
        sides.append((symbols_of(np.concatenate([codes, pad])), begins, np.repeat(np.arange(len(cases)), np.diff(begins))))
    for places, walks, samples, stride in PLANS:
        hit = np.zeros(len(cases), bool)
        for walk in range(walks):
            reads = []
            for side, (symbols, begins, owner) in enumerate(sides):
                starts = np.flatnonzero((np.arange(len(owner)) + owner) % stride == 0) if side else np.arange(len(owner))
                read, last = embedded(symbols, starts, 2 * places, walk)
                inside = np.flatnonzero(last < begins[owner[starts] + 1])
                reads.append(([x[inside] for x in read], owner[starts[inside]]))
            for sample in range(samples):
                own, other = (keys(r, sampled(2 * places, places, walk, sample)) ^ (o.astype(np.uint64) * FACTOR) for r, o in reads)
                hit[reads[1][1][np.isin(other, own)]] = True
        if (hit.reshape(len(kinds), -1).mean(1) >= TARGET).all():
            break
    return places, walks, samples, stride


def search(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the pattern to a piece of the text, and where the (first) best piece ends.

    The piece begins anywhere, or at the text's beginning if anchored.
    """
    m = len(pattern)
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        places[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        equal = places.get(c, 0)
        zero = (((equal & up) + up) ^ up) | equal | down
        plus, minus = (down | ~(zero | up)) & full, up & zero
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1 | (1 if anchored else 0)) & full, (minus << 1) & full
        up, down = (minus | ~(zero | plus)) & full, plus & zero
        if score < best:
            best, end = score, j + 1
    return best, end


def least_distances(patterns: list[np.ndarray], texts: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern to a piece of its row of texts, in symbols: Myers' method for all rows at once.

    Patterns come by rising length. Equal symbols may be different characters, so a distance is a lower bound.
    """
    lengths = np.array([len(x) for x in patterns])
    words, rows = -(-int(lengths[-1]) // 64), len(patterns)
    masks = np.zeros((words, rows * 256), np.uint64)
    for row, pattern in enumerate(patterns):
        offset = np.arange(len(pattern))
        np.bitwise_or.at(masks, (offset >> 6, row * 256 + pattern.astype(np.int64)), np.uint64(1) << (offset & 63).astype(np.uint64))
    # Rows from first[w] on have a word w; it is the last one of those before first[w + 1].
    first = np.searchsorted(lengths, 64 * np.arange(words + 1), "right").tolist()
    one, high, top = np.uint64(1), np.uint64(63), ((lengths - 1) & 63).astype(np.uint64)
    up = [np.full(rows - a, ~np.uint64(0)) for a in first[:-1]]
    down = [np.zeros(rows - a, np.uint64) for a in first[:-1]]
    score, begin, none = lengths.copy(), np.arange(rows) * 256, np.zeros(rows, np.uint64)
    best = score.copy()
    for symbol in np.ascontiguousarray(texts.T):
        at, more, less = begin + symbol, none, none
        for w in range(words):
            a, ends = first[w], first[w + 1] - first[w]
            more, less = more[len(more) - rows + a :], less[len(less) - rows + a :]
            equal, u, d = masks[w].take(at[a:]), up[w], down[w]
            vertical = equal | d
            equal |= less
            zero = equal & u
            zero += u
            zero ^= u
            zero |= equal
            plus = zero | u
            np.invert(plus, out=plus)
            plus |= d
            minus = zero
            minus &= u
            if ends:
                bit = top[a : a + ends]
                score[a : a + ends] += ((plus[:ends] >> bit) & one).view(np.int64) - ((minus[:ends] >> bit) & one).view(np.int64)
            plus_in, minus_in = more, less
            if w < words - 1:
                more, less = plus >> high, minus >> high
            plus <<= one
            plus |= plus_in
            minus <<= one
            minus |= minus_in
            np.bitwise_and(plus, vertical, out=d)
            plus |= vertical
            np.invert(plus, out=plus)
            np.bitwise_or(plus, minus, out=u)
        np.minimum(best, score, out=best)
    return best


def piece_distances(masks: np.ndarray, row: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, first: np.ndarray, reach: int) -> np.ndarray:
    """Least edit distance of each pattern of at most 64 symbols to a piece of the `reach` symbols from its `first` place on.

    A pattern's places of each symbol are 256 words of `masks` from 256 * `row` on.
    """
    one, top, begin = np.uint64(1), (sizes - 1).astype(np.uint64), row * 256
    up, down = np.full(len(row), ~np.uint64(0)), np.zeros(len(row), np.uint64)
    score = sizes.copy()
    best = score.copy()
    for block in range(0, reach, 256):
        place = first + np.arange(block, min(block + 256, reach))[:, None]
        for symbol in symbols.take(place, mode="clip"):
            equal = masks.take(begin + symbol)
            zero = equal & up
            zero += up
            zero ^= up
            zero |= equal
            zero |= down
            plus = zero | up
            np.invert(plus, out=plus)
            plus |= down
            minus = zero & up
            score += ((plus >> top) & one).view(np.int64)
            score -= ((minus >> top) & one).view(np.int64)
            plus <<= one
            minus <<= one
            np.bitwise_and(plus, zero, out=down)
            plus |= zero
            np.invert(plus, out=plus)
            np.bitwise_or(plus, minus, out=up)
            np.minimum(best, score, out=best)
    return best


@dataclass
class Table:
    """Sorted keys of one class and repetition with item and offset, and which of the keys' first bits occur."""

    places: tuple[int, ...]
    key: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    occurs: np.ndarray
    down: np.uint64

    @classmethod
    def of(cls, places: tuple[int, ...], key: np.ndarray, item: np.ndarray, offset: np.ndarray) -> Table:
        order = np.argsort(key, kind="stable")
        bits = min(max(len(key).bit_length() + 4, 12), 24)
        down = np.uint64(64 - bits)
        occurs = np.zeros(1 << bits, bool)
        occurs[key >> down] = True
        return cls(places, key[order], item[order].astype(np.int32), offset[order].astype(np.int32), occurs, down)

    def hits(self, reads: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the windows whose key equals that of an item's window, the item, and the offset in it."""
        key = keys(reads, self.places)
        maybe = np.flatnonzero(self.occurs.take(key >> self.down))
        key = key[maybe]
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = high - low
        at = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(maybe, n), self.item[at], self.offset[at]


@dataclass
class Embedding:
    """One embedding of a class of items: its steps, the distance of windows in documents, and the tables of its samples."""

    steps: int
    stride: int
    walk: int
    tables: list[Table]

    def hits(self, symbols: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places among the first `size` whose window shares a key with an item's, the item, and the offset in it."""
        for begin in range(0, size, BLOCK * self.stride):
            starts = np.arange(begin, min(begin + BLOCK * self.stride, size), self.stride)
            reads, _ = embedded(symbols, starts, self.steps, self.walk)
            for table in self.tables:
                number, item, offset = table.hits(reads)
                yield starts[number], item, offset


@dataclass
class Index:
    """All items of a part in lower case with single blanks, their symbols and grams, and the tables of their walks."""

    ids: list[int]
    texts: list[str]
    symbols: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray
    grams: dict[int, np.ndarray]
    embeddings: list[Embedding]
    rate: float

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None], rate: float = RATE) -> Index:
        plain = [" ".join((t or "").lower().split()) for t in texts]
        codes, begins = code_points(plain)
        lengths = np.diff(begins)
        symbols = symbols_of(np.concatenate([codes, np.zeros(2 * PLANS[0][0] + 3, np.uint32)]))
        classes: dict[int, list[int]] = defaultdict(list)
        for i, t in enumerate(plain):
            if t.count(" ") + 1 >= LEAST_WORDS:
                classes[len(t).bit_length()].append(i)
        # Classes of like windows share embeddings and tables, as many as any of them needs.
        shared: dict[tuple[int, int], list[list[int]]] = defaultdict(lambda: [[], [0], [0]])
        for _, members in sorted(classes.items()):
            places, walks, samples, stride = plan_of([plain[i] for i in members], rate)
            for mine, more in zip(shared[places, stride], (members, [walks], [samples]), strict=True):
                mine += more
        embeddings = []
        for (places, stride), (members, several_walks, several_samples) in shared.items():
            walks, samples = max(several_walks), max(several_samples)
            many = lengths[members]
            item = np.repeat(members, many)
            offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            start = begins[item] + offset
            for walk in range(walks):
                reads, last = embedded(symbols, start, 2 * places, walk)
                inside = np.flatnonzero(last < begins[item + 1])
                reads = [x[inside] for x in reads]
                samplings = [sampled(2 * places, places, walk, r) for r in range(samples)]
                tables = [Table.of(x, keys(reads, x), item[inside], offset[inside]) for x in samplings]
                embeddings.append(Embedding(2 * places, stride, walk, tables))
        return cls(list(ids), plain, symbols, begins, lengths, {w: grams(symbols, w) for w in WIDTHS}, embeddings, rate)

    def candidates(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(text, item, first place, last place) of where items may begin in texts, each once for places close together.

        Texts begin at `at`, which also has the end of the last one; an item may begin before its text.
        """
        width = np.maximum(4, (self.rate * self.lengths).astype(np.int64))
        many = (int(np.diff(at).max()) + int(self.lengths.max())) // 4 + 2
        found = [np.zeros(0, np.int64)]
        for embedding in self.embeddings:
            for place, item, offset in embedding.hits(symbols, int(at[-1])):
                text = np.searchsorted(at, place, "right") - 1
                bucket = (place - at[text] - offset + self.lengths[item]) // width[item]
                found.append(np.unique((item * many + bucket) * (len(at) - 1) + text))
        code = np.unique(np.concatenate(found))
        item, bucket, text = code // (len(at) - 1) // many, code // (len(at) - 1) % many, code % (len(at) - 1)
        first = bucket * width[item] - self.lengths[item]
        return np.stack([text, item, first, first + width[item] - 1], 1)

    def close(self, some: np.ndarray, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those of the candidates for which the least distances of disjoint pieces of the item add up to no more than the allowed edits.

        Pieces are taken from both ends in turn, and sought wherever in the text around they may lie if the item is there.
        """
        some = some[np.lexsort((some[:, 1], self.lengths[some[:, 1]]))]
        kept = [some[:0]]
        for k in range(0, len(some), CLOSE):
            part = some[k : k + CLOSE]
            spent = np.zeros(len(part), np.int64)
            for number in range(max(int(self.lengths[part[-1, 1]]) // PIECE, 1)):
                # Shorter items, which have no such piece, come first.
                skip = int(np.searchsorted(self.lengths[part[:, 1]], PIECE * (number + 1))) if number else 0
                own = part[skip:]
                if not len(own):
                    break
                items, row = np.unique(own[:, 1], return_inverse=True)
                m = self.lengths[items]
                sizes, allowed = np.minimum(m, PIECE), (self.rate * m).astype(np.int64)
                offset = m - PIECE * ((number + 1) // 2) if number % 2 else np.full(len(items), PIECE * (number // 2))
                masks = np.zeros(len(items) * 256, np.uint64)
                for j in range(int(sizes.max())):
                    symbol = self.symbols[np.minimum(self.begins[items] + offset + j, len(self.symbols) - 1)]
                    masks[np.arange(len(items)) * 256 + symbol] |= np.where(j < sizes, np.uint64(1) << np.uint64(j), np.uint64(0))
                before, after = np.maximum(offset - allowed, 0), np.maximum(m - offset - sizes - allowed, 0)
                first = at[own[:, 0]] + own[:, 2] + (before - allowed)[row]
                reach = own[:, 3] - own[:, 2] + 1 + (m + 2 * allowed - before - after)[row]
                spent[skip:] += piece_distances(masks, row, sizes[row], symbols, first, int(reach.max()))
                fits = spent <= (self.rate * self.lengths[part[:, 1]]).astype(np.int64)
                part, spent = part[fits], spent[fits]
                if not len(part):
                    break
            kept.append(part)
        return np.concatenate(kept)

    def likely(self, some: np.ndarray, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those of the candidates whose text has as many of the item's grams as the allowed edits leave, each within them of its place."""
        for width in WIDTHS:
            here, own, least = grams(symbols, width), self.grams[width], needed(self.lengths, width, self.rate)
            some = some[np.argsort(self.lengths[some[:, 1]], kind="stable")]
            kept = []
            for k in range(0, len(some), BATCH):
                part = some[k : k + BATCH]
                m = self.lengths[part[:, 1]]
                allowed = (self.rate * m).astype(np.int64)
                rows = np.arange(len(part))[:, None] * PIECES
                seen = np.zeros(len(part) * PIECES << GRAM_BITS, bool)
                reach = int((-(-m // PIECES) + 2 * allowed + part[:, 3] - part[:, 2]).max()) + 1
                for piece in range(PIECES):
                    place = (at[part[:, 0]] + part[:, 2] - allowed + piece * m // PIECES)[:, None] + np.arange(reach)
                    seen[((rows + piece) << GRAM_BITS) + here[np.clip(place, 0, len(here) - 1)]] = True
                offset = np.arange(int(m.max()))
                gram = own[np.minimum(self.begins[part[:, 1]][:, None] + offset, len(own) - 1)]
                piece = np.minimum(offset * PIECES // m[:, None], PIECES - 1)
                shared = (seen[((rows + piece) << GRAM_BITS) + gram] & (offset < (m - width + 1)[:, None])).sum(1)
                kept.append(part[shared >= least[part[:, 1]]])
            some = np.concatenate([some[:0], *kept])
        return some

    def near(self, some: np.ndarray, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those of the candidates around which a piece of the text may be within the allowed edits of the item."""
        if len(some) <= FEW:
            return some
        some = some[np.argsort(self.lengths[some[:, 1]], kind="stable")]
        kept = [some[:0]]
        for k in range(0, len(some), NEAR):
            part = some[k : k + NEAR]
            m = self.lengths[part[:, 1]]
            allowed = (self.rate * m).astype(np.int64)
            reach = m + 2 * allowed + part[:, 3] - part[:, 2] + 1
            place = (at[part[:, 0]] + part[:, 2] - allowed)[:, None] + np.arange(int(reach.max()))
            own = [self.symbols[self.begins[i] : self.begins[i + 1]] for i in part[:, 1].tolist()]
            kept.append(part[least_distances(own, symbols[np.clip(place, 0, len(symbols) - 1)]) <= allowed])
        return np.concatenate(kept)

    def hits(self, texts: list[str]) -> list[list[int]]:
        """For each text, four numbers for each item found: place of the item, distance, first word, words."""
        out: list[list[int]] = [[] for _ in texts]
        if not self.embeddings or not texts:
            return out
        plain = [" ".join(t.lower().split()) for t in texts]
        codes, at = code_points([t + "\n" for t in plain])
        symbols = symbols_of(np.concatenate([codes, np.zeros(2 * PLANS[0][0] + 3, np.uint32)]))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        some = self.candidates(symbols, at)
        for screen in (self.close, self.likely, self.near):
            some = screen(some, symbols, at)
        for t, i, first, last in some[np.lexsort((some[:, 2], some[:, 1], some[:, 0]))].tolist():
            pattern, allowed = self.texts[i], int(self.rate * len(self.texts[i]))
            a = max(0, first - allowed)
            body = plain[t][a : max(a, last + len(pattern) + allowed)]
            distance, end = search(pattern, body)
            if distance <= self.rate * len(pattern) and distance < best.get((t, i), (len(pattern) + 1, 0))[0]:
                _, back = search(pattern[::-1], body[:end][::-1], anchored=True)
                piece = body[end - back : end]
                begin = a + end - back + len(piece) - len(piece.lstrip())
                best[t, i] = distance, plain[t].count(" ", 0, begin), len(piece.split())
        for (t, i), (distance, start_word, n) in sorted(best.items()):
            out[t] += [i, distance, start_word, n]
        return out


def indexes(benchmark: DataFrame, rate: float = RATE) -> Iterator[Index]:
    """Indexes of bounded parts of the benchmark, one after the other."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // PART_CHARS)
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id", "text").toArrow()
        yield Index.of(mine["item_id"].to_pylist(), mine["text"].to_pylist(), rate)


HIT = "array<struct<item_id:bigint,distance:bigint,first_word:bigint,n_words:bigint>>"


def marked(docs: DataFrame, benchmark: DataFrame, column: str = "contamination", rate: float = RATE) -> DataFrame:
    """docs with an array of the items found in each text: item_id, distance, first word and number of words of the passage."""
    out = docs.withColumn(column, F.expr(f"cast(array() AS {HIT})"))
    for index in indexes(benchmark, rate):

        def find(batch: pa.RecordBatch, index: Index = index) -> list[pa.Array]:
            texts = texts_of(batch)
            rows = [x for a, b in chunks(texts, CHUNK) for x in index.hits(texts[a:b])]
            kinds = [("item_id", pa.int64()), ("distance", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64())]
            own = [[dict(zip([k for k, _ in kinds], [index.ids[x[k]], *x[k + 1 : k + 4]], strict=True)) for k in range(0, len(x), 4)] for x in rows]
            return [pa.array(own, pa.list_(pa.struct(kinds)))]

        found = spare(out, "found")
        out = add_from_text(out, f"{found} {HIT}", find)
        out = out.withColumn(column, F.concat(column, found)).drop(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, first_word, n_words) of every item found in a document, at its best place."""
    hits = marked(docs.select("doc_id", "text"), benchmark, "hits", rate)
    return hits.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without the documents that hold a benchmark passage."""
    hits = spare(docs, "hits")
    return marked(docs, benchmark, hits, rate).where(F.size(hits) == 0).drop(hits)
