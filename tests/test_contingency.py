import itertools
import math

import numpy as np
import pytest
from helpers import table
from pyspark.sql import functions as F

from panelwise.operators import contingency, exact
from panelwise.operators.contingency import Pair, fisher_exact_2x2, fisher_exact_rx2


def cells(frame, tables):
    rows = [(t, f"r{i}", f"c{j}", int(n)) for t, m in tables.items() for i, line in enumerate(m) for j, n in enumerate(line) if n]
    return frame(rows, "test string, row string, col string, n bigint")


def brute(m):
    m = np.array(m)
    rows, k, n = m.sum(1), m[:, 0].sum(), m.sum()
    prob = lambda a: math.prod(math.comb(int(r), int(x)) for r, x in zip(rows, a)) / math.comb(int(n), int(k))
    obs = prob(m[:, 0])
    every = (prob(a) for a in itertools.product(*[range(r + 1) for r in rows]) if sum(a) == k)
    return sum(p for p in every if p <= obs * (1 + 1e-7))


def test_chisq_statistics(frame):
    out = table(contingency.chisq_test(cells(frame, {
        "yates": [[9, 3], [2, 8]], "empty": [[5, 0, 3], [2, 4, 6]], "one": [[3, 4]], "zero22": [[6, 0], [2, 4]],
    })), "test")
    a, b, c, d = 9, 3, 2, 8
    n = a + b + c + d
    assert abs(out["yates"][0] - n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))) < 1e-9
    assert out["yates"][1:3] == (1, 22) and abs(out["yates"][3] - math.erfc(math.sqrt(out["yates"][0] / 2))) < 1e-12
    m = np.array([[5, 0, 3], [2, 4, 6]])
    e = np.outer(m.sum(1), m.sum(0)) / m.sum()
    assert abs(out["empty"][0] - ((m - e) ** 2 / e).sum()) < 1e-9 and out["empty"][1] == 2
    assert out["one"][0] is None and out["one"][1] is None
    m = np.array([[6, 0], [2, 4]])
    e = np.outer(m.sum(1), m.sum(0)) / m.sum()
    assert abs(out["zero22"][0] - ((np.abs(m - e) - 0.5) ** 2 / e).sum()) < 1e-9
    plain = table(contingency.chisq_test(cells(frame, {"x": [[9, 3], [2, 8]]}), correct=False), "test")
    assert abs(plain["x"][0] - n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))) < 1e-9


def test_fisher_published_example(frame):
    # The lady tasting tea, two-sided: p 0.4857, odds ratio 6.408309, interval 0.2117329 to 621.9337505.
    out = table(contingency.fisher_2x2(cells(frame, {"tea": [[3, 1], [1, 3]], "zero": [[5, 0], [1, 4]]})), "test")
    n, p, est, lo, hi, _ = out["tea"]
    assert n == 8 and abs(p - 0.4857142857) < 1e-9 and abs(est - 6.408309) < 1e-4
    # the published upper bound is a root on the reciprocal scale with tolerance 1e-4
    assert abs(lo - 0.2117329) < 1e-4 and abs(1 / hi - 1 / 621.9337505) < 1e-4
    assert out["zero"][2] == math.inf and out["zero"][4] == math.inf and out["zero"][3] > 0


@pytest.mark.parametrize("m", [[[3, 1], [1, 3]], [[10, 2], [3, 15]], [[0, 5], [6, 1]], [[7, 7], [7, 7]]])
def test_fisher_2x2_equals_enumeration(m):
    (a, b), (c, d) = m
    assert abs(fisher_exact_2x2(a, b, c, d)["p_value"] - brute(m)) < 1e-12
    assert abs(fisher_exact_rx2(np.array(m)) - brute(m)) < 1e-12


def test_fisher_huge_counts_are_finite_and_consistent():
    n = 10**9
    even = fisher_exact_2x2(n, n, n, n)
    assert even["p_value"] == pytest.approx(1.0, abs=1e-4) and even["odds_ratio"] == pytest.approx(1.0, rel=1e-6)
    shift = 40_000
    out = fisher_exact_2x2(n + shift, n - shift, n - shift, n + shift)
    z = 4 * shift / math.sqrt(4 * n)
    assert out["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=0.01)
    assert out["ci_lower"] < out["odds_ratio"] < out["ci_upper"]
    assert out["odds_ratio"] == pytest.approx(((n + shift) / (n - shift)) ** 2, rel=1e-6)


@pytest.mark.parametrize("m", [[[2, 3], [4, 1], [0, 5]], [[3, 3], [1, 6], [5, 0], [2, 2]], [[4, 0], [0, 0], [1, 3]]])
def test_fisher_rx2_equals_enumeration(m):
    assert abs(fisher_exact_rx2(np.array(m)) - brute([r for r in m if sum(r)])) < 1e-12


def test_fisher_rx2_through_rows_of_states(frame, monkeypatch):
    tables = {"three": [[1500, 1500], [1400, 1600], [1450, 1550]], "four": [[150, 150], [130, 170], [160, 140], [155, 145]], "five": [[50, 50], [40, 60], [45, 55], [60, 40], [52, 48]],
              "equal": [[9, 1], [8, 2], [7, 3], [3, 7], [9, 1], [2, 8]], "wide": [[1, 2, 3], [3, 2, 1]], "small": [[2, 3], [4, 1], [0, 5]], "column": [[3, 0], [2, 0]], "row": [[3, 4]]}
    alone = {k: fisher_exact_rx2(np.array(tables[k])) for k in ("three", "four", "five", "small", "equal")}
    assert all(0.03 < alone[k] < 0.08 for k in ("three", "four", "five"))
    # States leave their task, are merged and dealt anew.
    monkeypatch.setattr(contingency, "STATES", 20)
    monkeypatch.setattr(contingency, "STATES_OF_WORK", 50)
    out = table(contingency.fisher_rx2(cells(frame, tables)), "test")
    assert [out[k][2] for k in alone] == [None] * len(alone)
    assert out["wide"][1:] == (None, "not two columns") and out["column"][2] == "not two columns" and out["row"][1] == 1.0
    assert all(out[k][1] == pytest.approx(alone[k], rel=1e-9) for k in alone)


def test_fisher_rx2_at_large_counts(frame):
    """Close to the chi-square tail where counts are large; the reference of chi-square comes from its own closed forms."""
    n = 10**8
    shift = 9000
    three = np.array([[n // 2, n // 2], [n // 2 + shift, n // 2 - shift], [n // 2 - shift, n // 2 + shift]])
    m = 10**4
    five = np.array([[m // 2 + s, m // 2 - s] for s in (0, 80, -80, 60, -60)])
    out = table(contingency.fisher_rx2(cells(frame, {"three": three, "five": five})), "test")
    x3 = 4 * 2 * shift**2 / n
    x5 = 4 * (2 * 80**2 + 2 * 60**2) / m
    assert out["three"][1] == pytest.approx(math.exp(-x3 / 2), rel=1e-3)
    assert out["five"][1] == pytest.approx(math.exp(-x5 / 2) * (1 + x5 / 2), rel=1e-2)


@pytest.mark.parametrize("seed", range(4))
def test_fisher_rx2_of_random_tables_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        m = rng.integers(0, 7, (int(rng.integers(2, 6)), 2))
        if m.sum(0).all():
            assert fisher_exact_rx2(m) == pytest.approx(brute(m[m.sum(1) > 0]), rel=1e-9)


def test_rare_results_keep_their_digits():
    m = np.array([[40, 0], [0, 35], [30, 1]])
    assert fisher_exact_rx2(m) == pytest.approx(brute(m), rel=1e-8)
    a, b, c, d = 60, 0, 1, 70
    assert fisher_exact_2x2(a, b, c, d)["p_value"] == pytest.approx(brute([[a, b], [c, d]]), rel=1e-9)


def test_wide_spreads_sum_over_a_grid_as_over_all_points():
    for a, b, c, d in ((60_000, 59_000, 61_500, 62_000), (10_000, 900_000, 11_000, 870_000)):
        got = fisher_exact_2x2(a, b, c, d)
        r1, r2, k = a + b, c + d, a + c
        x = np.arange(max(0, k - r2), min(r1, k) + 1)
        lw = exact.log_hypergeometric(x, r1, r2, k)
        at = a - x[0]
        assert got["p_value"] == pytest.approx(np.exp(lw[lw <= lw[at] + 1e-7]).sum(), rel=1e-9)
        for t, part, target in ((math.log(got["ci_lower"]), x >= a, 0.025), (math.log(got["ci_upper"]), x <= a, 0.025)):
            z = lw + (x - a) * t
            z = np.exp(z - z.max())
            assert z[part].sum() / z.sum() == pytest.approx(target, rel=1e-7)
        z = lw + (x - a) * math.log(got["odds_ratio"])
        z = np.exp(z - z.max())
        assert (z * x).sum() / z.sum() == pytest.approx(a, rel=1e-9)


def test_a_test_of_very_many_labels_is_not_gathered(spark, frame):
    many = spark.range(300_000).select(F.lit("many").alias("test"), F.col("id").cast("string").alias("row"), (F.col("id") % 2).cast("string").alias("col"), F.lit(1).cast("bigint").alias("n"))
    out = contingency.fisher_2x2(many.unionByName(cells(frame, {"tea": [[3, 1], [1, 3]], "line": [[3, 1]]})))
    rows = table(out, "test")
    assert rows["many"] == (300_000, None, None, None, None, "not a 2x2 table") and rows["line"][5] == "not a 2x2 table"
    assert abs(rows["tea"][1] - 0.4857142857) < 1e-9
    assert "collect" not in out._jdf.queryExecution().executedPlan().toString()


def test_interval_of_a_strong_association_at_large_counts():
    for n in (10**11, 10**12):
        m, a = 10**7, 5 * 10**6
        cells_ = (a, m - a, m - a, n - 2 * m + a)
        odds, se = cells_[0] * cells_[3] / cells_[1] / cells_[2], sum(1 / x for x in cells_) ** 0.5
        got = fisher_exact_2x2(*cells_)
        assert abs(got["ci_lower"] / odds / np.exp(-1.959964 * se) - 1) < 1e-3 and abs(got["ci_upper"] / odds / np.exp(1.959964 * se) - 1) < 1e-3


def test_counts_use_complete_pairs_and_masks(frame):
    df = frame([("a", 1, True), ("a", None, True), (None, 1, True), ("b", 0, None), ("b", 1, False)], "g string, y int, k boolean")
    out = table(contingency.contingency_counts(df, [Pair("all", F.col("g"), F.col("y")), Pair("kept", F.col("g"), F.col("y"), F.col("k"))]),
                "test", "row", "col")
    assert out == {("all", "a", "1"): 1, ("all", "b", "0"): 1, ("all", "b", "1"): 1, ("kept", "a", "1"): 1}
