import numpy as np
import pytest

from panelwise.llm import whitening
from panelwise.llm.catalog import QUERIES

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
SCHEMA = "vec_id long, embedding array<double>"


def brute(rows):
    """{component: explained} and {vec_id: [(deviation, whitened of each component)]} of (vec_id, vector) rows."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n, s = len(kept), x.sum(0)
    d = n * x - s
    centred = d.astype(float) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    y = centred @ q[:, :32] / np.sqrt(np.maximum(e[:32], 1e-300))
    out = {}
    for (i, _), dev, w in zip(kept, (d * d).sum(1), y, strict=True):
        out.setdefault(i, []).append((int(dev), w))
    return n, e / e.sum(), out


def agree(df, rows, places=1e-7):
    assert df.columns == COLUMNS
    got = df.collect()
    n, explained, expected = brute(rows)
    by = {}
    for r in got:
        assert r.n == n and 0 <= r.identity_error <= 1e-4
        assert abs(r.explained - explained[r.component - 1]) <= 1e-9
        by.setdefault(r.vec_id, {}).setdefault(r.deviation, {}).setdefault(r.component, []).append(r.whitened)
    k = min(32, len(explained))
    assert len(got) == n * k
    first = {i: v[0] for i, v in expected.items()}
    matrix = np.array([v[1] for v in first.values()])
    mine = np.array([[by[i][v[0]][c + 1][0] for c in range(k)] for i, v in first.items()])
    for c in range(k):
        sign = 1 if np.dot(mine[:, c], matrix[:, c]) > 0 else -1
        assert np.abs(mine[:, c] - sign * matrix[:, c]).max() < places
    for i, v in expected.items():
        assert sum(len(x[1]) for x in by[i].values()) == len(v)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_query_against_numpy(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    agree(QUERIES["op11_whitening"](spark, folder), rows)


def made(n=300, dimension=5, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(dimension, dimension)) * np.arange(1, dimension + 1)
    return [(int(i), [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(n, dimension)) @ m)]


def test_unusable_vectors_repeats_and_further_columns(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(whitening, "SLAB_BLOCKS", 3)
    rows = made()
    rows += rows[:7] + [(7, rows[0][1]), (900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [1.0, float("nan"), 1.0, 1.0, 1.0]), (903, [float("inf")] * 5)]
    extra = [(910, []), (911, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows + extra], SCHEMA + ", row int, place string")
    agree(whitening.report(df), rows)


def test_empty_table_one_row_and_equal_rows(spark):
    assert whitening.report(spark.createDataFrame([], SCHEMA)).collect() == []
    same = spark.createDataFrame([(i, [0.5, 1.0]) for i in range(4)], SCHEMA)
    got = whitening.report(same).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [
        (i, c, 4, 0, None, 0.0, None) for i in range(4) for c in (1, 2)
    ]


def test_a_direction_without_variance(spark):
    rows = [(i, [c, 2 * c, 1.0]) for i, (_, (c, _)) in enumerate(made(50, 2))]
    rows = [(i, [round(v[0] * 64) / 64, round(v[0] * 64) / 32, 1.0]) for i, v in rows]
    got = whitening.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 150 and got[0].identity_error < 1e-9
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert {r.explained for r in got if r.component > 1} == {0.0}


def test_very_large_entries(spark):
    rows = [(i, [1e30 * (-1) ** i, float(i)]) for i in range(6)]
    got = whitening.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.deviation for r in got} == {None} and {r.n for r in got} == {6}
