import random
import re
from collections import Counter, defaultdict

import duckdb

from panelwise.llm import linefreq

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, max_documents, min_left=20, min_share=0.3):
    documents = defaultdict(set)
    norm = lambda line: " ".join(WORD.findall(line)).lower()
    for i, (_, text, host) in enumerate(rows):
        for line in (text or "").split("\n"):
            if WORD.search(line):
                documents[host, norm(line)].add(i)
    out = []
    for i, text, host in rows:
        t = text or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {p + k for p in range(len(w) - 2) if c[tuple(w[p : p + 3])] > 1 for k in range(3)}
        gone = sum(len(WORD.findall(x)) for x in lines if len(documents[host, norm(x)]) > max_documents)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        left = len(w) - gone
        kept = not failed and not (gone and (left < min_left or left < min_share * len(w)))
        out.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered), failed, gone, kept))
    return sorted(out, key=repr)


def made(n=200):
    rng = random.Random(5)
    words = ["a", "b", "Cc", "é", "#x", "<y>", "zz"] + [f"w{i}" for i in range(60)]
    common = ["Same line here for all", "  other   COMMON\tline "]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 5))]
        lines += rng.sample(common, rng.randrange(3)) + ["", " \t"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["h1", "h2", None])))
    return rows + [(900, None, "h1"), (901, "", None), (902, "x " * 30000, "h1"), (903, "a b c\n" * 3 + "a b", "h2"), rows[0], rows[0], (None, "q", "h1")]


def test_equals_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, h string, row int")
    got = sorted((tuple(r) for r in linefreq.judged(df, max_documents=10).collect()), key=repr)
    assert got == brute(rows, 10)


def test_copies_and_near_copies_count_alike(spark):
    text = "only line of this text " * 12
    rows = [(i, text, "copies") for i in range(40)] + [(100 + i, f"{text}\nand a line of its own number {i}, long enough to keep", "near") for i in range(40)]
    rows += [(200 + i, text, f"host {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.n_removed, r.base_failed) for r in linefreq.judged(df, max_documents=39).collect()}
    assert {got[i][0] for i in range(140) if i in got} == {60} and {got[200 + i][0] for i in range(40)} == {0}
    assert {r.n_removed for r in linefreq.judged(df, max_documents=40).collect()} == {0}


def test_query_sql_with_a_limit_that_acts_on_the_table(spark):
    """At sf0.01 no line is in more than 50 documents of its host; with a limit of 3, lines go."""
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.execute(linefreq.SQL.replace("> 50)", "> 3)")).fetchall())
    got = sorted(tuple(r) for r in linefreq.judged(spark.read.parquet(f"{folder}/documents.parquet"), max_documents=3).collect())
    assert got == want
    assert sum(r[7] > 0 for r in got) > 10


def test_cleaned_texts(spark):
    df = spark.createDataFrame([(i, f"Menu  bar\nown {i}\n", "h") for i in range(5)] + [(9, None, "h")], "doc_id bigint, text string, source string")
    got = {r.doc_id: r.text for r in linefreq.cleaned(df, max_documents=3).collect()}
    assert got == {**{i: f"own {i}\n" for i in range(5)}, 9: None}


def test_empty_table_and_plan_without_python(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    out = linefreq.judged(df)
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
