import random
import re

import numpy as np
import pytest

from panelwise.llm import minmax
from panelwise.llm.catalog import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))) if w else frozenset()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of rows (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=lambda s: (len(s), sorted(s)))
    holders = {}
    for i, s in enumerate(distinct):
        for x in s:
            holders.setdefault(x, []).append(i)
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(distinct):
        common = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, both in common.items():
            if 100 * both >= 85 * (len(s) + len(distinct[j]) - both):
                root[find(i)] = find(j)
    number, least = {s: i for i, s in enumerate(distinct)}, {}
    for (d, _), s in zip(rows, sets, strict=True):
        if d is not None and s:
            r = find(number[s])
            least[r] = min(least.get(r, d), d)
    out = []
    for (d, _), s in zip(rows, sets, strict=True):
        c = least.get(find(number[s])) if s else d
        out.append((d, len(s), c, d == c))
    return sorted(out, key=repr)


def made(groups=25, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 9, 10, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = rng.choice([" ", "\n", " \t"]).join(w)
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "a"), (504, "A "), (505, rows[0][1]), (0, rows[0][1]), (0, "other text of this id"), (None, rows[3][1]), (None, "x y"), (None, "")]
    return rows


SCHEMA = "doc_id long, text string"


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_classes_with_nulls_ties_repeats_and_clashing_columns(spark):
    rows = made()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", node long, set_key string")
    assert got(minmax.classes(df)) == brute(rows)


def test_small_blocks_give_the_same_classes(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"v{rng.randrange(200)}" for _ in range(120)]
    rows = made(10, 5)
    for i in range(60):
        w = list(base)
        # Chains of small steps, and texts that share much with the group without a link to it.
        for p in range(rng.choice([0, 2, 4, 10, 14])):
            w[(i * 7 + p * 3) % len(w)] = f"n{i}.{p}" if rng.random() < 0.7 else "common"
        rows.append((1000 + i, " ".join(w)))
    monkeypatch.setattr(minmax, "BLOCK_NODES", 4)
    assert got(minmax.classes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_table_and_a_very_long_text(spark):
    assert got(minmax.classes(spark.createDataFrame([], SCHEMA))) == []
    rng = random.Random(2)
    w = [f"q{rng.randrange(5000)}" for _ in range(200_000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w, "end"])), (3, "z" * 1_000_000), (4, " ".join(w[:150_000]))]
    assert got(minmax.classes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op12_minmax"](spark, folder)) == brute(rows)


def test_both_ends_of_a_permutation_estimate_similarity():
    rng = np.random.default_rng(1)
    one, both = [], []
    for _ in range(200):
        x = rng.integers(0, 2**63, 60, dtype=np.uint64)
        a, b = np.unique(x[:50]), np.unique(x[10:])
        v = minmax.min_max([a, b])
        same = v[0] == v[1]
        both.append(same.mean())
        one.append(same[: minmax.PERMUTATIONS].mean())
    true = 40 / 60
    assert abs(np.mean(both) - true) < 0.01
    # The mean of both ends varies no more than that of as many independent evaluations.
    assert np.var(both) < 1.1 * true * (1 - true) / minmax.VALUES
    assert np.var(both) < np.var(one)


def test_least_matches_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    assert (rng.binomial(minmax.VALUES, 0.85, 1_000_000) >= minmax.NEEDED).all()
    assert minmax.NEEDED > 0.5 * minmax.VALUES
