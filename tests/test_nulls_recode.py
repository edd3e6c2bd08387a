import math

from helpers import table
from pyspark.sql import functions as F

from panelwise.functions import intervals, nulls, recode, tails


def test_any_all_three_valued(frame):
    df = frame([(1, "P"), (1, None), (2, "N"), (2, None), (3, None), (4, "N"), (4, "N"), (5, "P"), (5, "P")], "g int, v string")
    c = F.col("v") == "P"
    out = table(df.groupBy("g").agg(
        nulls.any_true(c).alias("any"), nulls.any_true(c, True).alias("any_rm"),
        nulls.all_true(c).alias("all"), nulls.sum_na(nulls.ind(c)).alias("s"), nulls.mean_na(nulls.ind(c), True).alias("m"),
    ), "g")
    assert out[1] == (True, True, None, None, 1.0)
    assert out[2] == (None, False, False, None, 0.0)
    assert out[3] == (None, False, None, None, None)
    assert out[4] == (False, False, False, 0, 0.0)
    assert out[5] == (True, True, True, 2, 1.0)


def test_flags_keep_unknown(frame):
    df = frame([(1, 1, None), (2, 0, None), (3, 1, 1), (4, None, None)], "i int, a int, b int")
    out = table(df.select("i", nulls.both("a", "b"), nulls.either("a", "b"), nulls.complement("b")), "i")
    assert out == {1: (None, 1, None), 2: (0, None, None), 3: (1, 1, 0), 4: (None, None, None)}


def test_safe_numbers(frame):
    texts = ["3", "2.7", "-2.7", " 4 ", "1e3", "1d", "0x1A", "REFUS", "", None, "99999999999", "NaN", "5."]
    df = frame(list(enumerate(texts)), "i int, t string")
    out = table(df.select("i", nulls.safe_int("t"), nulls.safe_double("t")), "i")
    assert [out[i][0] for i in range(len(texts))] == [3, 2, -2, 4, 1000, None, None, None, None, None, None, None, 5]
    assert out[1][1] == 2.7 and out[10][1] == 99999999999.0 and out[5][1] is None


def test_membership_never_unknown(frame):
    df = frame([(1, "a"), (2, "b"), (3, None)], "i int, v string")
    out = table(df.select("i", nulls.in_set("v", ["a"]), nulls.not_in_set("v", ["a"])), "i")
    assert out == {1: (True, False), 2: (False, True), 3: (False, True)}


def test_cut_is_right_closed(frame):
    ages = [17.0, 17.5, 29.0, 29.5, 49.0, 50.0, None, float("nan")]
    df = frame(list(enumerate(ages)), "i int, a double")
    out = table(df.select("i", recode.cut("a", (17, 29, 39, 49, math.inf), ("<30", "30-39", "40-49", "50+"))), "i")
    assert [out[i] for i in range(8)] == [None, "<30", "<30", "30-39", "40-49", "50+", None, None]


def test_labels_overrides_and_gates(frame):
    df = frame([(1, "1", None), (2, "1.0", "word"), (3, "77", "other"), (4, None, "word")], "i int, c string, t string")
    label = recode.code_labels("c", {1: "one", 99: "rest"})
    out = table(df.select("i", label.alias("l"), recode.override(label, F.col("t") == "word", "fixed").alias("o"),
                          recode.gate_zero(F.lit(1), F.col("t") == "word").alias("g")), "i")
    assert out == {1: ("one", "one", 1), 2: ("one", "fixed", 0), 3: (None, None, 1), 4: (None, "fixed", 0)}


def test_site_from_id(frame):
    df = frame([(2001,), (9001,)], "id long")
    out = table(df.select("id", recode.leading_digit_label("id", {"2": "south"})), "id")
    assert out == {2001: "south", 9001: "9"}


def test_interval_edges(frame):
    df = frame([(0, 0, 10), (1, 10, 10), (2, 0, 0), (3, 32, 131)], "i int, x int, n int")
    out = table(intervals.bind_wilson(df, "x", "n").select("i", "lower", "upper"), "i")
    assert abs(out[0][0]) < 1e-12 and abs(out[1][1] - 1) < 1e-12 and out[2] == (None, None)
    assert abs(out[3][0] - 0.1789) < 5e-4 and abs(out[3][1] - 0.3247) < 5e-4
    for i in (0, 1, 3):
        x, n = [(0, 10), (10, 10), None, (32, 131)][i]
        assert out[i][0] - 1e-12 <= x / n <= out[i][1] + 1e-12


def test_chi2_tail_known_points():
    for df, x, p in [(1, 3.841458820694124, 0.05), (4, 9.487729036781154, 0.05), (10, 18.307038053275146, 0.05), (2, 2.0, math.exp(-1))]:
        assert abs(tails.chi2_upper(x, df) - p) < 1e-12
    assert tails.chi2_upper(0.0, 3) == 1.0 and tails.chi2_upper(None, 1) is None
    assert abs(tails.normal_two_sided(1.959963984540054) - 0.05) < 1e-12
