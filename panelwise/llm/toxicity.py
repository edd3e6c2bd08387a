"""Toxicity by a convolutional text classifier in numpy.

Words are hashed to buckets with an embedding each; filters of several widths slide over the words, the maximum over all
places of a text is each filter's feature, and a logistic layer makes the score. Because a filter is linear in its words,
scoring adds rows of one precomputed table per place. Embeddings start from each word's log odds among the training
texts; all weights are then trained together by Adam. The gradient of a maximum flows to one place only, so it is sparse.

The fit collects hashed words of at most `per_class` labelled texts of each class (a documented bound); every text is then
scored whole, in bounded chunks, without a shuffle. One logistic map makes 0.5 the best threshold over all languages, and
each language gets a threshold of its own from the texts kept for calibration. The language is no input of the score.

Null and empty texts have no words and get the score of a text that triggers nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import add_from_text, chunks, held_out, sigmoid, spare, texts_of, training_texts

WORD = re.compile(r"[^\W_]+")
#: Rows of the embedding: words, first letters of words, and one row of padding.
WORDS, PREFIXES = 1 << 15, 1 << 14
PAD = WORDS + PREFIXES
PREFIX = 4
WIDTHS = (1, 2, 3)
FILTERS = 4
DIMENSIONS = 12
#: With fewer texts of a class kept for calibration, all texts serve for both.
FEW = 15
#: Characters scored at once.
CHUNK = 200_000


def bucket(word: str) -> int:
    """Embedding rows of a word and of its first letters, in one number. Inflected words share their first letters."""
    own = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"), 7) % WORDS
    first = xxhash.xxh32_intdigest(word[:PREFIX].encode("utf-8", "surrogatepass"), 8) % PREFIXES
    return first << 16 | own


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the distinct words of some texts, the numbers of the words of all texts, and the words of each text."""
    found = [WORD.findall(t.lower()) for t in texts]
    number = dict.fromkeys(w for ws in found for w in ws)
    rows = np.fromiter(map(bucket, number), np.int64, len(number))
    number = {w: i for i, w in enumerate(number)}
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return rows, np.fromiter((number[w] for ws in found for w in ws), np.int64, int(sizes.sum())), sizes


def hashed(text: str) -> np.ndarray:
    rows, ids, _ = words([text])
    return rows[ids].astype(np.int32)


def laid_out(ids: np.ndarray, sizes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts in one array, each text followed by padding; begin and end of each text (at least one place)."""
    gap = max(WIDTHS)
    begins = (np.cumsum(sizes + gap) - sizes - gap).astype(np.int64)
    flat = np.full(int(sizes.sum()) + gap * len(sizes), pad, np.int64)
    flat[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)) * gap, sizes)] = ids
    return flat, begins, begins + np.maximum(sizes, 1)


@dataclass
class Model:
    embedding: np.ndarray  # (PAD + 1, DIMENSIONS); the last row is the padding
    filters: list[np.ndarray]  # for each width: (FILTERS, width, DIMENSIONS)
    filter_bias: np.ndarray
    out: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def table(self) -> np.ndarray:
        """What each embedding row adds to each filter at each of its places: one product for all texts."""
        return np.concatenate([self.embedding @ w[:, k].T for w in self.filters for k in range(w.shape[1])], 1).astype(np.float32)

    def raw(self, rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Scores before calibration of texts given as words() gives them."""
        own = np.concatenate([table[rows & 0xFFFF] + table[WORDS + (rows >> 16)], np.zeros((1, table.shape[1]), np.float32)])
        flat, begins, ends = laid_out(ids, sizes, len(rows))
        cuts, at, pooled = np.stack([begins, ends], 1).ravel(), 0, []
        made = own[np.append(flat, len(rows))]
        for width in WIDTHS:
            n = len(made) - width + 1
            value = made[:n, at : at + FILTERS]
            for k in range(1, width):
                value = value + made[k : n + k, at + k * FILTERS : at + (k + 1) * FILTERS]
            pooled.append(np.maximum.reduceat(value, np.minimum(cuts, n - 1), axis=0)[::2])
            at += width * FILTERS
        return np.maximum(np.concatenate(pooled, 1) + self.filter_bias, 0) @ self.out + self.bias

    def score(self, texts: list[str], table: np.ndarray | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        table = self.table() if table is None else table
        parts = [self.raw(*words(texts[a:b]), table) for a, b in chunks(texts, CHUNK)]
        return sigmoid(self.scale * np.concatenate([np.zeros(0), *parts]) + self.shift)

    def limits(self, batch: pa.RecordBatch) -> np.ndarray:
        """Threshold of each row's language; 0.5 for languages without one."""
        langs = batch.column("lang").to_pylist() if "lang" in batch.schema.names else [None] * batch.num_rows
        return np.array([self.thresholds.get(x, 0.5) for x in langs], float)


def unpacked(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As words(), of texts that are hashed already."""
    flat = np.concatenate([np.zeros(0, np.int32), *docs]).astype(np.int64)
    rows, ids = np.unique(flat, return_inverse=True)
    return rows, ids, np.array([len(d) for d in docs], np.int64)


def started(docs: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> Model:
    """Weights before training: the first dimension of a word is its log odds, its texts counted once each."""
    seen = np.full((2, PAD + 1), 0.5)
    for d, label in zip(docs, y, strict=True):
        seen[int(label), np.unique(d & 0xFFFF)] += 1
        seen[int(label), np.unique(WORDS + (d >> 16))] += 1
    total = np.array([(y == 0).sum() + 1.0, (y == 1).sum() + 1.0])
    odds = np.log(seen[1] / total[1]) - np.log(seen[0] / total[0])
    # A word seen in few texts says little.
    odds *= seen.sum(0) / (seen.sum(0) + 4.0)
    odds[seen.sum(0) <= 1.0] = 0
    embedding = rng.normal(0, 0.05, (PAD + 1, DIMENSIONS))
    embedding[:, 0] = np.clip(odds, -3, 3) / 2
    embedding[PAD] = 0
    filters = [rng.normal(0, 0.1, (FILTERS, w, DIMENSIONS)) for w in WIDTHS]
    for w in filters:
        w[:, :, 0] = rng.uniform(0.2, 0.8, w.shape[:2]) / w.shape[1]
    n = FILTERS * len(WIDTHS)
    return Model(embedding, filters, np.full(n, -0.2), np.full(n, 0.3), -1.5)


def step(model: Model, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted log loss of a small batch."""
    sizes = np.array([len(d) for d in docs], np.int64)
    packed, begins, ends = laid_out(np.concatenate(docs), sizes, -1)
    packed = np.append(packed, -1)
    pair = np.stack([np.where(packed < 0, PAD, packed & 0xFFFF), np.where(packed < 0, PAD, WORDS + (packed >> 16))])
    rows = model.embedding[pair[0]] + model.embedding[pair[1]]
    best, where = [], []
    for w in model.filters:
        n = len(packed) - w.shape[1] + 1
        made = sum(rows[k : n + k] @ w[:, k].T for k in range(w.shape[1]))
        at = np.stack([b + made[b:e].argmax(0) for b, e in zip(begins, ends, strict=True)])
        best.append(np.take_along_axis(made, at, 0))
        where.append(at)
    value = np.concatenate(best, 1) + model.filter_bias
    pooled = np.maximum(value, 0)
    error = (sigmoid(pooled @ model.out + model.bias) - y) * weight / len(docs)
    back = error[:, None] * model.out * (value > 0)
    d_embedding = np.zeros_like(model.embedding)
    d_filters = []
    for i, (w, at) in enumerate(zip(model.filters, where, strict=True)):
        own = back[:, i * FILTERS : (i + 1) * FILTERS]
        d = np.zeros_like(w)
        for k in range(w.shape[1]):
            d[:, k] = np.einsum("bf,bfd->fd", own, rows[at + k])
            moved = (own[:, :, None] * w[None, :, k]).reshape(-1, DIMENSIONS)
            for side in pair:
                np.add.at(d_embedding, side[at + k].ravel(), moved)
        d_filters.append(d)
    d_embedding[PAD] = 0
    return [d_embedding, *d_filters, back.sum(0), pooled.T @ error, np.array([error.sum()])]


def train(docs: list[np.ndarray], y: np.ndarray, langs: list[str | None], epochs: int = 6, rate: float = 0.01, seed: int = 11) -> Model:
    """Fit on four fifths of the texts; calibrate on the rest, or use all for both where the rest is too small.

    Without texts of both classes nothing can be learnt: every text then scores as the one class, or 0 without any.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(y, float)
    if len(docs) == 0 or y.min() == y.max():
        n = FILTERS * len(WIDTHS)
        empty = Model(np.zeros((PAD + 1, DIMENSIONS)), [np.zeros((FILTERS, w, DIMENSIONS)) for w in WIDTHS], np.zeros(n), np.zeros(n), 0.0)
        empty.constant = float(y[0]) if len(y) else 0.0
        return empty
    order = rng.permutation(len(docs))
    check = order[: len(docs) // 5]
    fit = order[len(docs) // 5 :]
    if min(y[check].sum(), (1 - y[check]).sum()) < FEW:
        check = fit = order
    model = started([docs[i] for i in fit], y[fit], rng)
    share = y[fit].mean()
    weights = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    params = [model.embedding, *model.filters, model.filter_bias, model.out, np.array([model.bias])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            grads = step(model, [docs[i] for i in batch], y[batch], weights[batch])
            t += 1
            now = rate * (1 - epoch / epochs)
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= now * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
            model.bias = float(params[-1][0])
    calibrate(model, [docs[i] for i in check], y[check], [langs[i] for i in check])
    return model


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap below which F1 is best."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # equal scores stay together
    k = int(f1.argmax())
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else p[k] - 1)) / 2)


def calibrate(model: Model, docs: list[np.ndarray], y: np.ndarray, langs: list[str | None], least: int = 20) -> None:
    """Shift the scores so that 0.5 is the best threshold; thresholds of languages with at least `least` texts of each class."""
    table = model.table()
    raw = np.concatenate([model.raw(*unpacked(docs[a : a + 64]), table) for a in range(0, len(docs), 64)])
    model.shift = -model.scale * best_threshold(raw, y)
    p = sigmoid(model.scale * raw + model.shift)
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        if min(y[own].sum(), (1 - y[own]).sum()) >= least:
            model.thresholds[lang] = min(0.9, max(0.1, best_threshold(p[own], y[own])))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1500) -> Model:
    """Train on labelled rows that are not held out; rows are ordered by id, so the fit does not depend on the partitioning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([hashed(t) for t in texts_of(batch)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("y"), ids], ["doc_id", "lang", "y", "ids"])

    sample = training_texts(docs, labels, label, per_class).select("doc_id", "lang", "y", "text")
    rows = sample.mapInArrow(run, "doc_id bigint, lang string, y int, ids array<int>").toArrow().sort_by("doc_id")
    words = rows["ids"].combine_chunks()
    flat, at = words.flatten().to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
    return train([flat[a:b] for a, b in zip(at, at[1:], strict=False)], rows["y"].to_numpy(), rows["lang"].to_pylist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, flagged): flagged where the score reaches the threshold of the row's language."""
    source = docs.select("doc_id", F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            p = model.score(texts_of(batch), table)
            limit = model.limits(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(limit), pa.array(p >= limit)],
                ["doc_id", "score", "predicted", "threshold", "flagged"],
            )

    out = source.mapInArrow(run, "doc_id bigint, score double, predicted int, threshold double, flagged boolean")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "threshold", "flagged")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs whose text scores below the threshold of their language, with all their columns."""

    table = model.table()

    def flag(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(model.score(texts_of(batch), table) >= model.limits(batch))]

    name = spare(docs, "flagged")
    return add_from_text(docs, f"{name} boolean", flag).where(~F.col(name)).drop(name)
