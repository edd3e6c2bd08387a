import random

import numpy as np
import pytest

from panelwise.llm import decontam
from panelwise.llm.decontam import Index, search


def distance(pattern, text, anchored=False):
    """Least edit distance of the pattern to any piece of the text, by the full table."""
    row = [j if anchored else 0 for j in range(len(text) + 1)]
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_search_equals_the_table():
    rng = random.Random(0)
    for _ in range(100):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        t = "".join(rng.choice("abcd") for _ in range(rng.randrange(90)))
        if rng.random() < 0.5:
            t += p[:5] + "x" + p[6:] + t
        assert search(p, t)[0] == distance(p, t)
        assert search(p, t, anchored=True)[0] == distance(p, t, anchored=True)


VOCABULARY = ["".join(random.Random(i).choice("etaoinsrhldcum") for _ in range(4 + i % 6)) for i in range(300)] + ["the", "of", "and"] * 40


def text(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, item, edits):
    w = item.split()
    for _ in range(edits):
        k = rng.randrange(len(w))
        kind = rng.randrange(4)
        if kind == 0:
            w[k] = rng.choice(VOCABULARY)
        elif kind == 1:
            w.insert(k, rng.choice(VOCABULARY))
        elif kind == 2:
            w[k] = w[k][:1] + "x" + w[k][2:]
        else:
            del w[k]
    return " ".join(w)


def cases():
    rng = random.Random(7)
    items = [text(rng, n) for n in (5, 9, 12, 15, 25, 40, 60, 90)] + [text(rng, rng.randrange(15, 60)) for _ in range(12)]
    docs = []
    for i, item in enumerate(items):
        for edits in (0, 0, 1, 2, 4):
            if len(item.split()) < 12 and edits:
                continue
            docs.append(f"{text(rng, rng.randrange(80))} {edited(rng, item, edits)}\n{text(rng, rng.randrange(60))}")
    docs += [text(rng, rng.randrange(1, 300)) for _ in range(40)]
    return items, docs


def test_equals_brute_force():
    items, docs = cases()
    index = Index.of(list(range(len(items))), items)
    got = {(d, row[k]): row[k + 1] for d, row in enumerate(index.hits(docs)) for k in range(0, len(row), 4)}
    lower = [" ".join(d.lower().split()) for d in docs]
    want = {}
    for d, t in enumerate(lower):
        for i, item in enumerate(items):
            best, _ = search(item, t)
            if best <= decontam.RATE * len(item):
                want[d, i] = best
    assert set(got) <= set(want) and len(set(want) - set(got)) <= 0.03 * len(want)
    assert all(got[k] == want[k] for k in got)
    exact = {k for k, v in want.items() if v == 0}
    assert exact <= set(got)


def test_spans_cover_the_passage():
    items, docs = cases()
    index = Index.of([0], [items[5]])
    row = index.hits([f"one two  three {items[5]} four"])[0]
    assert row == [0, 0, 3, len(items[5].split())]


@pytest.mark.parametrize("part", [20_000_000, 60])
def test_nulls_repeats_clashes_and_empty_tables(spark, monkeypatch, part):
    monkeypatch.setattr(decontam, "PART_CHARS", part)
    item = "a passage of the benchmark that has quite a few words in it to be found again"
    rows = [(1, f"Before. {item.upper()} after", 9), (2, None, 9), (3, "", 9), (None, item, 9), (1, f"Before. {item} after", 9), (5, "x y z " * 30000 + item, 9), (6, "clean text " * 10, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(7, item, "x"), (7, item, "x"), (8, None, "x"), (None, item, "x"), (9, "", "x"), (10, "after", "x")], "item_id bigint, text string, doc_id string")
    got = sorted(((r.doc_id or 0, r.item_id, r.distance) for r in decontam.contaminated(docs, bench).collect()))
    assert got == [(0, 7, 0)] * 2 + [(1, 7, 0)] * 4 + [(5, 7, 0)] * 2
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 6]
    assert decontam.contaminated(docs.where("false"), bench).count() == 0
    assert decontam.contaminated(docs, bench.where("false")).count() == 0
    assert decontam.clean(docs, bench.where("false")).count() == len(rows)


@pytest.mark.parametrize("kinds", ["s", "sdi"])
@pytest.mark.parametrize("n", [5, 14, 20, 30, 45])
def test_recall_up_to_the_full_rate(n, kinds):
    """Of passages with 12 to 20 % of their characters edited, in texts of other words, nine of ten are found."""
    rng = random.Random(n)
    letters = "etaoinsrhldcum"
    items = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n)) for _ in range(60)]
    index = Index.of(list(range(len(items))), items)
    for rate in (0.12, 0.15, decontam.RATE):
        docs = []
        for item in items:
            chars = list(item)
            for k in sorted(rng.sample(range(len(item)), int(rate * len(item))), reverse=True):
                kind = rng.choice(kinds)
                chars[k : k + (kind != "i")] = [] if kind == "d" else [rng.choice(letters)]
            docs.append(f"{text(rng, 20)} {''.join(chars)} {text(rng, 20)}")
        found = sum(i in row[::4] for i, row in enumerate(index.hits(docs)))
        assert found >= 0.9 * len(items), (rate, found)


def spread(rng, item, share, letters="etaoinsrhldcum"):
    """The item with that share of its characters changed, at even distances."""
    chars, edits = list(item), int(share * len(item))
    for k in range(edits):
        at = k * len(item) // edits + len(item) // edits // 2
        chars[at] = rng.choice([c for c in letters if c != chars[at]])
    return "".join(chars)


@pytest.mark.parametrize("n", [5, 14, 30, 60, 200])
def test_evenly_spread_edits_are_found(n):
    """No run of untouched characters is longer than five; nine of ten are found all the same."""
    rng = random.Random(n)
    items = [" ".join("".join(rng.choice("etaoinsrhldcum") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for _ in range(40)]
    index = Index.of(list(range(len(items))), items)
    for share in (0.12, 1 / 6, decontam.RATE):
        found = sum(i in row[::4] for i, row in enumerate(index.hits([f"{text(rng, 20)} {spread(rng, x, share)} {text(rng, 20)}" for x in items])))
        assert found >= 0.9 * len(items), (share, found)


def test_keys_are_samples_of_embeddings():
    """A key reads only the sampled places of a walk; all keys of an embedding are different samples."""
    item = text(random.Random(3), 40)
    index = Index.of([0], [item])
    for embedding in index.embeddings:
        assert all(len(t.places) < embedding.steps for t in embedding.tables)
        assert len({t.places for t in embedding.tables}) == len(embedding.tables) > 1


def test_filters_keep_whatever_is_within_the_rate(monkeypatch):
    """Candidates at the true place pass the gram counts and the screen, wherever the edits are."""
    monkeypatch.setattr(decontam, "FEW", 0)
    rng = random.Random(5)
    for n in (4, 6, 12, 40):
        items = [text(rng, n) for _ in range(20)]
        index = Index.of(list(range(20)), items)
        docs = [f"{text(rng, 9)} {spread(rng, x, decontam.RATE)} {text(rng, 9)}" for x in items]
        codes, at = decontam.code_points([d + "\n" for d in docs])
        symbols = decontam.symbols_of(decontam.np.concatenate([codes, decontam.np.zeros(64, decontam.np.uint32)]))
        places = [len(d) - len(d.split(" ", 9)[9]) for d in docs]
        some = decontam.np.array([[i, i, p, p + 3] for i, p in enumerate(places)])
        assert len(index.near(index.likely(some, symbols, at), symbols, at)) == 20


def test_screen_equals_the_search():
    rng = random.Random(2)
    patterns = sorted(("".join(rng.choice("abcd") for _ in range(rng.choice([1, 5, 63, 64, 65, 128, 129, 192, 193, 300]))) for _ in range(40)), key=len)
    texts = [("".join(rng.choice("abcd") for _ in range(30)) + p[:40] + "d" + p[42:] + "c" * 400)[:350] for p in patterns]
    symbols = decontam.np.array([list(t.encode()) for t in texts], decontam.np.uint8)
    got = decontam.least_distances([decontam.np.frombuffer(p.encode(), decontam.np.uint8) for p in patterns], symbols)
    assert got.tolist() == [search(p, t)[0] for p, t in zip(patterns, texts, strict=True)]


@pytest.mark.parametrize("n", [3, 63, 64, 65, 128, 150, 200, 330])
def test_pieces_bound_the_distance(n):
    """No candidate is dropped whose surroundings hold the item within the allowed edits, and few others are left."""
    rng = random.Random(n)
    letters = "etaoinsrhldcum "
    items, docs, places = [], [], []
    for _ in range(40):
        item = "".join(rng.choice(letters) for _ in range(n + rng.randrange(6))).strip().replace("  ", " ")
        item = " ".join((item + " a b c d").split())
        body = list(item)
        for _ in range(rng.randrange(int(0.4 * len(item)) + 2)):
            k = rng.randrange(len(body))
            body[k] = rng.choice(["", "x", body[k] + "y"])
        before = "".join(rng.choice(letters) for _ in range(rng.randrange(300)))
        items.append(item)
        places.append(len(before))
        docs.append(before + "".join(body) + "".join(rng.choice(letters) for _ in range(rng.randrange(300))) + "\n")
    index = Index.of(list(range(len(items))), items)
    codes, at = decontam.code_points(docs)
    symbols = decontam.symbols_of(codes)
    some, fine = [], set()
    for t, (doc, place) in enumerate(zip(docs, places, strict=True)):
        for i in (t, (t + 1) % len(items)):
            allowed = int(0.2 * len(index.texts[i]))
            first = place - rng.randrange(allowed + 1)
            some.append((t, i, first, first + max(4, allowed) - 1))
            body = doc[max(0, first - allowed) : first + max(4, allowed) - 1 + len(index.texts[i]) + allowed]
            if search(index.texts[i], body)[0] <= allowed:
                fine.add((t, i))
    kept = {(t, i) for t, i, _, _ in index.close(np.array(some), symbols, at).tolist()}
    assert fine and fine <= kept
    assert len(kept - fine) <= len(some) // 3
