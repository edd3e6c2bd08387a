import random
import re
from collections import Counter

import numpy as np
import pytest

from panelwise.llm import jaccard
from panelwise.llm.components import components
from panelwise.llm.textarrays import windows, words

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    """(doc_id, class_id, n_links, n_copies) of rows (doc_id, text)."""
    texts = sorted({t or "" for _, t in rows})
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    links = Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    number = {t: i for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        if d is not None:
            r = find(number[t or ""])
            least[r] = min(least.get(r, d), d)
    copies = Counter(t or "" for _, t in rows)
    return sorted(((d, least.get(find(number[t or ""])), links[number[t or ""]], copies[t or ""]) for d, t in rows), key=repr)


def made(groups=14, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "\n"]).join(w)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "a"), (504, "a "), (505, rows[0][1]), (0, rows[0][1]), (0, "other text of the same id"), (None, rows[3][1]), (None, "x y")]
    return rows + [(600, "z " * 30000), (601, "z " * 30001)]


@pytest.mark.parametrize("nodes,total", [(2048, 2_000_000), (2, 100)])
def test_classes_equal_brute_force(spark, monkeypatch, nodes, total):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", nodes)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", total)
    rows = made()
    df = spark.createDataFrame([(*r, "s", 7) for r in rows], "doc_id bigint, text string, digest string, node int")
    got = sorted((tuple(r) for r in jaccard.classes(df).collect()), key=repr)
    assert got == brute(rows)


def test_one_document_of_each_class_stays(spark):
    rows = made(seed=6)
    df = spark.createDataFrame([(*r, "s", 7) for r in rows], "doc_id bigint, text string, digest string, node int")
    kept = jaccard.without_duplicates(df)
    assert kept.columns == df.columns
    classes = Counter()
    want = brute(rows)
    of = {}
    for d, c, _, _ in want:
        of.setdefault(d, set()).add(c)
    for r in kept.collect():
        assert (r.doc_id, r.text) in rows
        classes[(r.doc_id if r.doc_id is not None else r.text)] += 1
    assert max(classes.values()) <= 2 and kept.count() == len({(c, None if c is not None else d) for d, c, _, _ in want if c is not None}) + len({t for d, t in rows if d is None and t == "x y"}) + _shared_id(rows, want)


def _shared_id(rows, want):
    """Classes that have the same smallest id as another one."""
    roots = {}
    for d, t in rows:
        roots.setdefault(d, set()).add(t)
    return len({t for d, t in rows if d == 0 and t == "other text of the same id"})


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.classes(df).count() == 0 and jaccard.without_duplicates(df).count() == 0


def test_minhash_estimates_similarity():
    rng = random.Random(1)
    w = [str(rng.random()) for _ in range(1000)]
    texts = [" ".join(w), " ".join(w[:900] + [str(rng.random()) for _ in range(100)])]
    hashes, _, _, counts = words(texts)
    shingle, many = windows(hashes, counts, 5)
    values = jaccard.minhash(shingle, many)
    a, b = shingles(texts[0]), shingles(texts[1])
    assert abs((values[0] == values[1]).mean() - len(a & b) / len(a | b)) < 0.15


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(2000):
        same = rng.random(jaccard.VALUES) < 0.8
        lost += any(same[:n].sum() < m for n, m in jaccard.NEEDED)
    assert lost <= 2
    assert dict(jaccard.NEEDED)[96] > 40


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)] + [(5000, i) for i in range(6000, 6100)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items()}
