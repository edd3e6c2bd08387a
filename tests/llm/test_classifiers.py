import itertools
import zlib

import numpy as np
import pytest

from panelwise.llm import linecrf, toxicity
from panelwise.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.01"


def labelled(spark, label):
    return {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}


@pytest.mark.parametrize("key,label,least", [("op1_toxicity", "toxic", 0.9), ("op5_linecrf", "quality", 0.95)])
def test_held_out_accuracy(spark, key, label, least):
    truth = labelled(spark, label)
    rows = QUERIES[key](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    limit = 0.5 if label == "toxic" else 0.3
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= limit) for r in rows)
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= least


def test_pooling_equals_one_text_at_a_time():
    texts = ["a b c d", "", "you idiot idiot", "x", "longer text with many words " * 40]
    rng = np.random.default_rng(0)
    model = toxicity.started([toxicity.hashed(t) for t in texts], np.array([0, 0, 1, 0, 0]), rng)
    together = model.score(texts)
    assert np.allclose(together, np.concatenate([model.score([t]) for t in texts]))
    table = model.embedding
    for text, p in zip(texts, together, strict=True):
        packed = toxicity.hashed(text).astype(int)
        rows = np.concatenate([table[packed & 0xFFFF] + table[toxicity.WORDS + (packed >> 16)], np.zeros((4, toxicity.DIMENSIONS))])
        pooled = [max(float((rows[i : i + w.shape[1]] * f).sum()) for i in range(max(len(packed), 1))) for w in model.filters for f in w]
        raw = np.maximum(np.array(pooled) + model.filter_bias, 0) @ model.out + model.bias
        assert abs(1 / (1 + np.exp(-raw)) - p) < 1e-4


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    docs = [toxicity.hashed(t) for t in ("a b c", "d e idiot", "f")]
    y = np.array([0.0, 1.0, 0.0])
    model = toxicity.started(docs, y, rng)
    model.filter_bias += 0.5
    grads = toxicity.step(model, docs, y, np.ones(3))

    def loss():
        raw = model.raw(*toxicity.unpacked(docs), model.table().astype(float))
        p = 1 / (1 + np.exp(-raw))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for value, grad in zip([*model.filters, model.filter_bias, model.out], grads[1:-1], strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        value[at] += 1e-3
        up = loss()
        value[at] -= 2e-3
        assert abs((up - loss()) / 2e-3 - grad[at]) < 1e-3
        value[at] += 1e-3


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    lines_of = np.array([3, 1, 4])
    unary, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    got, expected = linecrf.marginals(unary, moves, lines_of)
    at, want, pairs = 0, [], np.zeros((2, 2))
    for n in lines_of:
        u = unary[at : at + n]
        at += n
        paths = list(itertools.product([0, 1], repeat=n))
        weight = np.array([np.exp(sum(u[i] * p[i] for i in range(n)) + sum(moves[p[i], p[i + 1]] for i in range(n - 1))) for p in paths])
        weight /= weight.sum()
        want += [sum(w for w, p in zip(weight, paths, strict=True) if p[i]) for i in range(n)]
        for w, p in zip(weight, paths, strict=True):
            for i in range(n - 1):
                pairs[p[i], p[i + 1]] += w
    assert np.allclose(got, want) and np.allclose(expected, pairs)


def test_line_features_do_not_depend_on_the_chunk():
    texts = ["One line.\nSame same same\n\nSame same same", "", "\n", "A | B | C\na b c a b c", "ÉÈ 12 ###\nx"]
    together, weight, lines_of = linecrf.line_features(texts)
    assert lines_of.tolist() == [len(t.split("\n")) for t in texts]
    assert weight.tolist() == [len(x) + 1 for t in texts for x in t.split("\n")]
    alone = np.concatenate([linecrf.line_features([t])[0] for t in texts])
    assert np.allclose(together, alone)
    row = together[3]
    assert row[11] == 1 and abs(row[8] - 1 / 3) < 1e-9


ROWS = [(1, "You idiot loser " * 5, "en"), (2, "A calm and pleasant day.\nAll is well here.", "en"), (3, None, None), (4, "", "xx"), (None, "word", "en"), (2, "again", "en"), (6, "y " * 60000, "fr")]


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (linecrf, "quality")])
def test_nulls_repeats_long_texts_and_empty_table(spark, module, label):
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in ROWS], "doc_id bigint, text string, lang string, score double, predicted int")
    more = spark.createDataFrame([(100 + i, ("bad idiot ### $$$" if i % 2 else "good clean text here.") + f" {i}", "en", 0.1, 0) for i in range(60)], docs.schema)
    marks = spark.createDataFrame([(100 + i, (i % 2) ^ (label == "quality")) for i in range(60)] + [(None, 1), (101, None), (101, 1)], f"doc_id bigint, {label} int")
    model = module.fit(docs.unionByName(more), marks)
    got = module.score(docs, model).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 2, 3, 4, 6]
    by = {r.doc_id: r.score for r in got}
    assert by[3] == by[4] and all(0 <= r.score <= 1 for r in got)
    assert module.score(docs.where("false"), model).count() == 0
    kept = module.accepted(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum((r.score < 0.5) if label == "toxic" else (r.score >= 0.3) for r in got)
    nothing = module.fit(docs.where("false"), marks)
    assert module.accepted(docs, nothing).count() == len(ROWS)
