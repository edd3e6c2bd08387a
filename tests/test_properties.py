"""Randomised checks against plain Python."""

import math
from collections import defaultdict

import numpy as np
from helpers import bag, table
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwise.functions import intervals, tails
from panelwise.operators import describe, sequence
from panelwise.operators.contingency import fisher_exact_2x2, fisher_exact_rx2

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
visits = st.lists(st.tuples(st.integers(1, 4), st.sampled_from([None, 1, 2, 3]), st.sampled_from(["P", "N", None])), min_size=1, max_size=40)


@SLOW
@given(visits)
def test_incident_and_first_results(frame, rows):
    rows = [(i, o, k, v) for k, (i, o, v) in enumerate(rows)]
    df = frame(rows, "id int, ord int, k int, v string")
    seen = defaultdict(list)
    for i, o, k, v in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2])):
        if v is not None:
            seen[i].append(v)
    pairs = [b for x in seen.values() for a, b in zip(x, x[1:]) if a == "N"]
    for cap in (1000, 3):
        (row,) = sequence.incident_tests(df, "id", ["ord", "k"], "v", "P", "N", max_rows=cap).collect()
        assert (row.n, row.num_pos, row.num_neg) == (len(pairs), pairs.count("P"), pairs.count("N"))
    first = table(sequence.first_results(df, "id", ["ord", "k"], "v"), "id")
    assert first == {i: (seen[i][0] if seen[i] else None) for i, *_ in rows}


@SLOW
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([1.0, 2.0])), min_size=1, max_size=60), st.floats(0, 1))
def test_any_quantile(frame, xs, p):
    known = [x for x in xs if x is not None]
    (row,) = describe.exact_quantiles(frame([(x,) for x in xs], "x double"), "x", [p]).collect()
    if known:
        assert math.isclose(row[0], float(np.quantile(known, p)), rel_tol=1e-9, abs_tol=1e-9)
    else:
        assert row[0] is None


@SLOW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["x", "y", None])), min_size=1, max_size=50))
def test_shares_add_up(frame, rows):
    df = frame(rows, "g string, v string")
    sums = describe.group_share_within(df, "g", "v").groupBy("g").agg(F.sum("pct").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in sums)
    assert abs(describe.group_share(df, "g").agg(F.sum("pct")).first()[0] - 1) < 1e-12
    counts = table(describe.freq(df, "g", ["a", "b", "zz"], include_na=True), "g")
    assert counts == {k: sum(g == k for g, _ in rows) for k in ("a", "b", "zz", None)}


@SLOW
@given(st.lists(st.integers(0, 200), min_size=1, max_size=20))
def test_score_interval_contains_the_share(frame, xs):
    df = frame([(i, x, 200) for i, x in enumerate(xs)], "i int, x int, n int")
    for r in intervals.bind_wilson(df, "x", "n").collect():
        assert r.lower - 1e-12 <= r.x / r.n <= r.upper + 1e-12 and -1e-12 <= r.lower and r.upper <= 1 + 1e-12


@settings(max_examples=60, deadline=None)
@given(*[st.integers(0, 25)] * 4)
def test_exact_tests_agree(a, b, c, d):
    if min(a + b, c + d, a + c, b + d) > 0:
        one, two = fisher_exact_2x2(a, b, c, d), fisher_exact_rx2(np.array([[a, b], [c, d]]))
        assert math.isclose(one["p_value"], two, rel_tol=1e-9)
        assert one["ci_lower"] <= one["odds_ratio"] <= one["ci_upper"]
        swapped = fisher_exact_2x2(c, d, a, b)
        assert math.isclose(one["p_value"], swapped["p_value"], rel_tol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.floats(0.01, 300), st.integers(1, 40))
def test_tail_of_even_degrees_is_a_poisson_sum(x, k):
    want = sum(math.exp(-x / 2 + i * math.log(x / 2) - math.lgamma(i + 1)) for i in range(k))
    assert math.isclose(tails.chi2_upper(x, 2 * k), want, rel_tol=1e-9, abs_tol=1e-13)


def test_rows_are_never_lost(frame):
    df = frame([(i % 3 or None, i) for i in range(30)], "id int, k int")
    assert bag(sequence.add_count(df, ["id"]).select("k")) == bag(df.select("k"))
