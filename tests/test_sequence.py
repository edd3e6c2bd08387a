import random

import pytest
from helpers import bag, table
from pyspark.sql import functions as F

from panelwise.operators import sequence


@pytest.fixture(scope="module")
def seq(frame):
    rows = [
        (1, 1, None, "x"), (1, 2, "neg", "y"), (1, 3, "pos", "z"), (1, 4, "neg", None),
        (2, 1, "pos", "x"), (2, 2, "neg", "x"), (3, 1, "neg", "w"), (4, 2, None, "q"),
        (5, None, "pos", "last"), (5, 3, "neg", "first"),
    ]
    return frame(rows, "id int, ord int, r string, other string")


def test_first_known_and_companion(seq):
    out = table(sequence.first_results(seq, "id", ["ord"], "r", "other"), "id")
    assert out == {1: ("neg", "y"), 2: ("pos", "x"), 3: ("neg", "w"), 4: (None, None), 5: ("neg", "first")}


def test_incident_ignores_unknown_before_lag(seq):
    (row,) = sequence.incident_tests(seq, "id", ["ord"], "r", "pos", "neg").collect()
    # after a negative: id 1 visit 3 (pos), id 5 visit NULL (pos, sorted last)
    assert (row.n, row.num_pos, row.num_neg, row.pct_pos) == (2, 2, 0, 1.0)
    (comp,) = sequence.incident_with_companion(seq, "id", ["ord"], "r", "other", "z", "q").collect()
    assert comp.n == 0
    (comp,) = sequence.incident_with_companion(seq.withColumn("r", F.when(F.col("r") == "pos", "P").otherwise(F.col("r"))),
                                               "id", ["ord"], "r", "other", "P", "neg").collect()
    assert comp.n == 2


def test_followup_counts(seq):
    (row,) = sequence.followup_summary(seq, "id", F.col("ord") == 1, "r", "pos", "neg").collect()
    assert (row.n_cohort, row.n_tests, row.persons_tested, row.pct_pos) == (1, 0, 0, None)
    rows = sequence.followup_rows(seq, "id", F.col("ord") == 1, "r", "pos")
    assert bag(rows.select("id", "ord")) == ["(2, 2)"]
    rest = sequence.exclude_baseline_positive(seq, "id", F.col("ord") == 1, "r", "pos")
    assert {r.id for r in rest.collect()} == {1, 3, 4, 5}


def test_split_path_equals_window(frame):
    rnd = random.Random(1)
    rows = [(None if i % 50 == 0 else 7 if rnd.random() < 0.5 else rnd.randrange(40),
             rnd.choice([None, 1, 2, 3]), i, rnd.choice(["P", "N", None])) for i in range(1500)]
    df = frame(rows, "id int, ord int, k int, r string")
    plain = sequence.number_within(df, ["id"], ["ord", "k"], "r")
    split = sequence.number_within(df, ["id"], ["ord", "k"], "r", max_rows=20)
    assert "__seg" in split._jdf.queryExecution().toString()
    assert bag(plain) == bag(split.select(plain.columns))
    a = sequence.incident_tests(df, "id", ["ord", "k"], "r", "P", "N")
    b = sequence.incident_tests(df, "id", ["ord", "k"], "r", "P", "N", max_rows=20)
    assert bag(a) == bag(b)


def test_average_rank_shares_ties(frame):
    df = frame([(1, 0), (1, 3), (1, 3), (1, None), (2, 5)], "id int, v int")
    assert bag(sequence.average_rank(df, ["id"], "v")) == bag(frame(
        [(1, 0, 1.0), (1, 3, 2.5), (1, 3, 2.5), (1, None, 4.0), (2, 5, 1.0)], "id int, v int, rank double"))


def test_repeated_samples(frame):
    rows = [(1, 0, "P"), (1, 3, "P"), (2, 0, "N"), (2, 6, "P"), (3, 0, "P"), (3, 1, "N"), (3, 3, "N"),
            (4, 0, "N"), (5, 0, "N"), (5, 0, "P"), (6, 0, "N"), (6, 1, "N"), (6, 3, "N")]
    df = frame(rows, "id int, v int, r string")
    (a,) = sequence.always_never(df, "id", "r", "P", "N").collect()
    assert (a.n_persons, a.n_always, a.n_never) == (5, 1, 1)
    (i,) = sequence.initial_vs_later(df, "id", "v", "r", "P", "N").collect()
    assert (i.n_init_neg_later_pos, i.n_init_pos_later_neg, i.n_tied, i.n_persons) == (1, 1, 1, 5)
    assert i.pct_init_neg_later_pos == 0.2
    pairs = table(sequence.pivot_repeat(df, "id", ["v", "r"], "r"), "id")
    assert pairs == {1: ("P", "P"), 2: ("N", "P"), 5: ("N", "P")}
    assert table(sequence.paired_agreement(df, "id", ["v", "r"], "r"), "swab_1", "swab_2") == {("P", "P"): 1, ("N", "P"): 2}
    triple = table(sequence.pivot_repeat(df, "id", ["v"], "r", repeats=3), "id")
    assert triple[6] == ("N", "N", "N")


def test_random_row_is_one_existing_row_per_id(frame):
    rows = [(i % 7, i, f"v{i}") for i in range(100)]
    df = frame(rows, "id int, k int, v string")
    out = sequence.one_random_row(df, "id", ["k"], seed=3)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == 7 and set(got) <= set(rows) and bag(out) == bag(sequence.one_random_row(df.repartition(5), "id", ["k"], seed=3))
    assert bag(out) != bag(sequence.one_random_row(df, "id", ["k"], seed=4))


def test_repeats_and_counts(frame):
    df = frame([(1, None, 1), (1, None, 2), (1, "a", 3), (None, "a", 4), (None, "a", 5)], "id int, v string, k int")
    assert bag(sequence.repeated_rows(df, ["id", "v"], "k").select("k")) == ["(2,)", "(5,)"]
    ties = frame([(1, "a", 1), (1, "a", None), (1, "a", 1), (2, "b", None), (2, "b", None), (3, "c", 1)], "id int, v string, k int")
    assert bag(sequence.repeated_rows(ties, ["id", "v"], "k")) == bag(frame([(1, "a", 1), (1, "a", None), (2, "b", None)], "id int, v string, k int"))
    assert table(sequence.add_count(df, ["id"]).select("k", "n"), "k") == {1: 3, 2: 3, 3: 3, 4: 2, 5: 2}
    assert table(sequence.first_in_group(df, ["id"], ["k"], "v").select("k", "first_result"), "k") == {1: None, 2: None, 3: None, 4: "a", 5: "a"}


def test_repeated_rows_equal_a_window(frame):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 1, 2, 3, *range(10, 300)]), rnd.choice(["a", "b", None]), rnd.choice([None, 1, 1, 2, 3]), rnd.choice(["x", "y", None])) for _ in range(800)]
    rows += [(1, "a", 0, f"hot{i % 50}") for i in range(2000)]
    df = frame(rows, "id int, v string, k int, w string")
    out = sequence.repeated_rows(df, ["id", "v"], "k")
    assert out.columns == df.columns
    order = lambda r: (r[2] is None, r[2] or 0, r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2] is None, r[3] is None, r[3] or "")
    by = {}
    for r in rows:
        by.setdefault(r[:2], []).append(r)
    left = [r for group in by.values() for r in sorted(group, key=order)[1:]]
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, left))
