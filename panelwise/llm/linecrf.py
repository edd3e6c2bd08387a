"""Document quality from a linear-chain conditional random field over lines.

Every line is described by numbers taken from its characters and words and by those of the lines before and after it. The
field gives each line a probability of being good, from forward and backward messages over the whole document; the mean of
these, weighted by line length, is the document's quality, and one logistic map on top makes it a probability.

Labels exist for documents only, so in training all lines carry their document's label. All work is vectorised: characters
of many texts lie in one array, features are sums over segments, and messages run over all texts of a chunk at once, one
step for each line of the longest. The fit collects line features of at most `per_class` labelled texts of each class (a
documented bound; `long_lines` bounds the lines of one training text by averaging neighbours). Scoring reads every text
whole and needs no shuffle. A null or empty text is one empty line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import add_from_text, chunks, code_points, held_out, sigmoid, spare, texts_of, training_texts
from panelwise.llm.textarrays import segment_hashes

OTHER, LOWER, UPPER, DIGIT, SPACE, NEWLINE, SYMBOL, STOP, MARK = range(9)
KINDS = 9
#: Characters handled at once.
CHUNK = 120_000
OWN = 15
FEATURES = 3 * OWN + 3


def kinds_table() -> np.ndarray:
    """Kind of each code point below 0x2000; all above are OTHER."""
    out = np.zeros(0x2000, np.uint8)
    for c in range(0x2000):
        t = chr(c)
        if t == "\n":
            out[c] = NEWLINE
        elif t.isspace():
            out[c] = SPACE
        elif t.isdigit():
            out[c] = DIGIT
        elif t.isupper():
            out[c] = UPPER
        elif t.isalpha():
            out[c] = LOWER
        elif t in "#*$%&|<>{}[]=@^~_\\/+":
            out[c] = SYMBOL
        elif t in ".?:;\"')…»”":
            out[c] = STOP
        elif t in "!,-":
            out[c] = MARK
    return out


KIND = kinds_table()


def again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs more than once, and whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    before, several = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    several[order[1:]] |= same
    several[order[:-1]] |= same
    return several, before


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x OWN features, weight of each line, lines of each text); every text has at least one line."""
    flat, text_at = code_points([t + "\n" for t in texts])
    kind = KIND[np.minimum(flat, 0x1FFF)]
    kind[flat >= 0x2000] = OTHER
    ends = np.flatnonzero(kind == NEWLINE)  # the newline belongs to the line that it ends
    begins = np.concatenate([[0], ends[:-1] + 1])
    lengths = ends - begins
    lines_of = np.diff(np.searchsorted(ends, text_at))
    line_text = np.repeat(np.arange(len(texts)), lines_of)
    line_kind = np.repeat(np.arange(len(ends)) * KINDS, lengths + 1) + kind
    total = np.bincount(line_kind, minlength=len(ends) * KINDS).reshape(-1, KINDS)
    solid = (kind != SPACE) & (kind != NEWLINE)
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    word_begins, word_ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word_line = np.searchsorted(ends, word_begins)
    n_words = np.bincount(word_line, minlength=len(ends))
    solids = np.maximum(lengths - total[:, SPACE], 1)
    letters = np.maximum(total[:, LOWER] + total[:, UPPER], 1)
    x = np.zeros((len(ends), OWN))
    if len(word_begins):
        word_hash = segment_hashes(flat, word_begins, word_ends)
        word_text = line_text[word_line]
        follows = np.concatenate([[False], (word_hash[1:] == word_hash[:-1]) & (word_text[1:] == word_text[:-1])])
        per_word = np.maximum(n_words, 1)
        x[:, 8] = np.bincount(word_line, follows, len(ends)) / per_word
        salt = word_text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        if len(word_hash) > 2:
            whole = word_text[2:] == word_text[:-2]
            triple = word_hash[:-2] * np.uint64(3) + word_hash[1:-1] * np.uint64(0x9E3779B97F4A7C15) + word_hash[2:] * np.uint64(0xC2B2AE3D27D4EB4F) + salt[:-2]
            x[:, 9] = np.bincount(word_line[:-2], again(triple)[0] & whole, len(ends)) / per_word
        word_kind = np.add.reduceat((kind == UPPER).astype(np.int32), np.stack([word_begins, word_ends], 1).ravel())[::2]
        x[:, 10] = np.bincount(word_line, word_kind >= 2, len(ends)) / per_word
        filled = np.flatnonzero(lengths)
        line_hash = segment_hashes(flat, begins[filled], ends[filled]) + line_text[filled].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x[filled, 11] = again(line_hash)[1]
    x[:, 0] = np.log1p(lengths) / 5
    x[:, 1] = total[:, UPPER] / letters
    x[:, 2] = total[:, DIGIT] / solids
    x[:, 3] = total[:, SYMBOL] / solids
    x[:, 4] = total[:, STOP] / solids
    x[:, 5] = total[:, MARK] / solids
    x[:, 6] = total[:, OTHER] / solids
    x[:, 7] = np.minimum(solids / np.maximum(n_words, 1), 40) / 10
    x[:, 12] = np.log1p(n_words) / 5
    x[:, 13] = np.where(lengths > 0, kind[np.maximum(ends - 1, 0)] == STOP, False)
    x[:, 14] = lengths == 0
    return x, lengths + 1.0, lines_of


def with_neighbours(own: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """Features of a line, of the lines before and after it, whether they exist, and a constant."""
    ends = np.cumsum(lines_of)
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[ends - lines_of] = True
    last[ends - 1] = True
    before = np.where(first[:, None], own, np.concatenate([own[:1], own[:-1]]))
    after = np.where(last[:, None], own, np.concatenate([own[1:], own[-1:]]))
    return np.concatenate([own, before, after, first[:, None], last[:, None], np.ones((len(own), 1))], 1)


class Packed:
    """Lines of several texts as steps: step t holds the t-th lines of all texts that have so many, the longest text first."""

    def __init__(self, lines_of: np.ndarray):
        order = np.argsort(-lines_of, kind="stable")
        sizes, starts = lines_of[order], (np.cumsum(lines_of) - lines_of)[order]
        self.starts = starts
        self.active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left") if len(sizes) else np.zeros(0, np.int64)

    def steps(self) -> Iterator[np.ndarray]:
        for t, n in enumerate(self.active):
            yield self.starts[:n] + t


def marginals(unary: np.ndarray, moves: np.ndarray, lines_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line by the forward-backward algorithm, and the expected moves between states, summed.

    unary: score of good over bad of each line; moves: 2 x 2 scores, from state to next state (0 bad, 1 good).
    """
    packed = Packed(lines_of)
    e = np.exp(moves)
    good = sigmoid(unary)
    local = np.stack([1 - good, good], 1)
    forward, expected, posterior = np.empty_like(local), np.zeros((2, 2)), np.empty(len(unary))
    steps = list(packed.steps())
    state = None
    for rows in steps:
        state = local[rows] if state is None else (state[: len(rows)] @ e) * local[rows]
        state = state / state.sum(1, keepdims=True)
        forward[rows] = state
    back = np.zeros((0, 2))
    for t in range(len(steps) - 1, -1, -1):
        rows = steps[t]
        now = np.ones((len(rows), 2))
        if t + 1 < len(steps):
            nxt = local[steps[t + 1]] * back
            m = len(nxt)
            joint = forward[rows[:m], :, None] * e[None] * nxt[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            now[:m] = nxt @ e.T
            now[:m] /= now[:m].sum(1, keepdims=True)
        both = forward[rows] * now
        posterior[rows] = both[:, 1] / both.sum(1)
        back = now
    return posterior, expected


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def good_lines(self, own: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
        x = (with_neighbours(own, lines_of) - self.mean) / self.spread
        return marginals(np.clip(x, -6, 6) @ self.weights, self.moves, lines_of)[0]

    def quality(self, own: np.ndarray, weight: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
        """Mean of P(good) weighted by length, in log odds."""
        at = np.cumsum(lines_of) - lines_of
        p = np.add.reduceat(self.good_lines(own, lines_of) * weight, at) / np.add.reduceat(weight, at)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        parts = [self.quality(*line_features(texts[a:b])) for a, b in chunks(texts, CHUNK)]
        return sigmoid(self.scale * np.concatenate([np.zeros(0), *parts]) + self.shift)


def adam(params: list[np.ndarray], gradient, rounds: int, rate: float) -> None:
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        for p, g, a, b in zip(params, gradient(), first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (1 - 0.9 * t / rounds) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)


def train(own: np.ndarray, weight: np.ndarray, lines_of: np.ndarray, y: np.ndarray, rounds: int = 250) -> Model:
    """Penalised likelihood of all lines carrying their text's label; each text has the same say.

    Without texts of both classes nothing can be learnt: every text then scores as the one class, or 1 without any.
    """
    y = np.asarray(y, float)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), np.zeros((2, 2)), constant=float(y[0]) if len(y) else 1.0)
    x = with_neighbours(own, lines_of)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    mean[-1], spread[-1] = 0.0, 1.0
    x = np.clip((x - mean) / spread, -6, 6)
    label = np.repeat(y, lines_of)
    say = np.repeat(1.0 / lines_of / len(y), lines_of)
    say *= np.where(label == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weights, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    pairs = np.array([[(lines_of[y == 0] - 1).sum(), 0.0], [0.0, (lines_of[y == 1] - 1).sum()]])
    n = max(pairs.sum(), 1.0)

    def gradient() -> list[np.ndarray]:
        p, expected = marginals(x @ weights, moves, lines_of)
        # Documents are all of one label, which would make moves between states impossible; the penalty keeps them possible.
        return [x.T @ ((p - label) * say) + 1e-4 * weights, (expected - pairs) / n + 0.02 * moves]

    adam([weights, moves], gradient, rounds, 0.1)
    model = Model(mean, spread, weights, moves)
    z = model.quality(own, weight, lines_of)
    line = [np.array([0.5]), np.array([0.0])]

    def fit_map() -> list[np.ndarray]:
        error = sigmoid(line[0][0] * z + line[1][0]) - y
        return [np.array([(error * z).mean() + 1e-3 * line[0][0]]), np.array([error.mean()])]

    adam(line, fit_map, 400, 0.1)
    model.scale, model.shift = float(max(line[0][0], 0.05)), float(line[1][0])
    return model


def shortened(own: np.ndarray, weight: np.ndarray, long_lines: int) -> tuple[np.ndarray, np.ndarray]:
    """At most long_lines rows: neighbouring lines of a longer text are averaged."""
    if len(own) <= long_lines:
        return own, weight
    at = np.linspace(0, len(own), long_lines, endpoint=False).astype(np.int64)
    n = np.diff(np.append(at, len(own)))
    return np.add.reduceat(own, at) / n[:, None], np.add.reduceat(weight, at)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, long_lines: int = 200) -> Model:
    """Train on labelled rows that are not held out; rows are ordered by id, so the fit does not depend on the partitioning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shortened(*line_features([t])[:2], long_lines) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("y"), pa.array([len(w) for _, w in rows], pa.int32()),
                    pa.array([x.astype(np.float32).tobytes() for x, _ in rows], pa.binary()), pa.array([w.tobytes() for _, w in rows], pa.binary()),
                ],
                ["doc_id", "y", "n", "own", "weight"],
            )

    sample = training_texts(docs, labels, label, per_class).select("doc_id", "y", "text")
    rows = sample.mapInArrow(run, "doc_id bigint, y int, n int, own binary, weight binary").toArrow().sort_by("doc_id")
    own = np.frombuffer(b"".join(rows["own"].to_pylist()), np.float32).reshape(-1, OWN).astype(float)
    weight = np.frombuffer(b"".join(rows["weight"].to_pylist()), float)
    return train(own, weight, rows["n"].to_numpy().astype(np.int64), rows["y"].to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): predicted 1 where the score reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows of docs whose text scores the threshold or more, with all their columns."""
    name = spare(docs, "score")
    marked = add_from_text(docs, f"{name} double", lambda batch: [pa.array(model.score(texts_of(batch)))])
    return marked.where(F.col(name) >= threshold).drop(name)
