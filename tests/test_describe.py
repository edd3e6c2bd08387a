import math
import random

import numpy as np
import pytest
from helpers import bag, table
from pyspark.sql import functions as F

from panelwise.operators import clean, describe, joins
from panelwise.operators.describe import Item


@pytest.fixture(scope="module")
def rows(frame):
    return frame([("a", "P"), ("a", "N"), ("a", None), (None, "P"), ("b", "P"), ("b", None)], "g string, v string")


def test_tables_with_missing(rows):
    assert table(describe.freq(rows, "g", ["a", "b", "c"]), "g") == {"a": 3, "b": 2, "c": 0}
    assert table(describe.freq(rows, "g", include_na=True), "g") == {"a": 3, "b": 2, None: 1}
    assert table(describe.freq_pct(rows, "g", include_na=True), "g") == {"a": (3, 0.5, 0.6), "b": (2, 2 / 6, 0.4), None: (1, 1 / 6, None)}
    assert table(describe.freq_2way(rows, "g", "v"), "g", "v") == {("a", "P"): 1, ("a", "N"): 1, ("b", "P"): 1}


def test_unknown_predicate_rows_count_as_missing(rows):
    cond = F.col("g") == "a"
    assert table(describe.freq_filtered(rows, "v", cond), "v") == {"P": 1, "N": 1, None: 1}
    assert table(describe.freq_filtered(rows, "v", cond, na_rows="count"), "v") == {"P": 1, "N": 1, None: 2}


def test_denominator_is_the_first_key(rows):
    out = table(describe.group_share_within(rows, "g", "v"), "g", "v")
    assert out["b", "P"] == (1, 0.5) and out["a", None] == (1, 1 / 3) and out[None, "P"] == (1, 1.0)
    known = table(describe.group_share_within(rows, "g", "v", known_only=True), "g", "v")
    assert known["a", "P"] == (1, 0.5) and known["b", "P"] == (1, 1.0)


def test_shares_sum_to_one(rows):
    out = describe.table_two(rows, [Item("g", F.col("g")), Item("sub", F.col("g"), F.col("g") == "a")], "v")
    sums = out.groupBy("variable", "level").agg(F.sum("pct").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in sums) and {r.variable for r in sums} == {"g", "sub"}


def test_table_one_denominators(rows):
    out = table(describe.table_one(rows, [Item("v", F.col("v")), Item("v_of_a", F.col("v"), F.col("g") == "a")]), "variable", "level")
    assert out["v", "P"] == (3, 0.5, 0.75) and out["v", None] == (2, 2 / 6, None)
    assert out["v_of_a", None] == (1, 1 / 3, None)


@pytest.mark.parametrize("kind", ["continuous", "few", "hot", "tiny"])
def test_quantiles_equal_numpy(frame, kind):
    rnd = random.Random(kind)
    n = 3 if kind == "tiny" else 4000
    pick = {
        "continuous": lambda: rnd.gauss(0, 1e6), "few": lambda: float(rnd.randrange(5)),
        "hot": lambda: 7.0 if rnd.random() < 0.8 else rnd.random(), "tiny": lambda: rnd.random(),
    }[kind]
    data = [(rnd.choice(["a", "b", None]), pick() if rnd.random() > 0.1 else None) for _ in range(n)]
    df = frame(data, "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    out = table(describe.exact_quantiles(df, "x", probs, ["g"]), "g")
    for g in {d[0] for d in data}:
        xs = [x for k, x in data if k == g and x is not None]
        if xs:
            assert np.allclose(out[g], np.quantile(xs, probs), rtol=1e-12, atol=0)
    (all_,) = describe.exact_quantiles(df, "x", probs).collect()
    assert np.allclose(tuple(all_), np.quantile([x for _, x in data if x is not None], probs), rtol=1e-12, atol=0)


def test_moments_count_missing_rows(frame):
    df = frame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None)], "g string, x double")
    out = table(describe.group_moments(df, ["g"], "x").select("g", "mean", "median", "n", "n_known"), "g")
    assert out == {"a": (2.0, 2.0, 3, 2), "b": (None, None, 1, 0)}


def test_person_level_rates(frame):
    df = frame([(1, "P"), (1, "N"), (2, "N"), (3, None), (3, "N"), (4, None)], "id int, v string")
    (strict,) = describe.ever_positive(df, "id", "v", "P").collect()
    assert (strict.num_positive, strict.pct, strict.n) == (None, None, 4)
    (tot,) = describe.any_totals(df, "id", {"v": ("v", "P")}).collect()
    assert (tot.pos_v, tot.tested_v) == (1, 3)
    assert table(describe.repeat_distribution(df, "id"), "n") == {1: (2, 0.5), 2: (2, 0.5)}
    assert describe.count_distinct(df, "v").first()[0] == 3


def test_availability_and_presence(frame):
    df = frame([("s", "a", "b"), ("s", None, "b"), ("t", "a", None)], "v string, x string, y string")
    out = table(describe.availability(df, "v", {"x": "x", "y": "y"}, ("x", "y"), 4), "v")
    assert out["s"] == (1, 2, 1, 0.25, 0.5, 0.25)
    pres = frame([("s", 1), ("s", 0), ("t", None)], "visit string, presence int")
    assert table(describe.presence_summary(pres, "visit"), "visit") == {"s": (1, 1, 2, 0.5, 0.5), "t": (None, None, 1, None, None)}
    assert describe.all_missing(frame([(None, None), (None, 1)], "a int, b int"), ["a", "b"]).first()[0] == 1


def test_null_keys_meet_in_joins(frame):
    a = frame([(1, None), (1, "x"), (2, "x")], "id int, v string")
    b = frame([(1, None, 10), (1, "x", 20)], "id int, v string, w int")
    assert table(joins.attach(a, b, ["id", "v"]), "id", "v") == {(1, None): 10, (1, "x"): 20, (2, "x"): None}
    ids = frame([(1,), (None,)], "id int")
    c = frame([(1,), (2,), (None,)], "id int")
    assert bag(joins.keep_ids(c, ids, "id")) == ["(1,)"]
    assert bag(joins.drop_ids(c, ids, "id")) == ["(2,)", "(None,)"]


def test_corrections(frame):
    df = frame([(1, "s", "N"), (1, "t", "N"), (2, "s", "U"), (3, "s", None)], "id int, visit string, v string")
    one = clean.correct_cell(df, "v", "id", {1: "P"}, also=F.col("visit") == "t")
    assert table(one, "id", "visit")[1, "t"] == "P" and table(one, "id", "visit")[1, "s"] == "N"
    fixes = frame([(1, "P")], "id int, new string")
    every = table(clean.correct_from_table(df, "v", fixes, ["id"], "new"), "id", "visit")
    assert every[1, "s"] == every[1, "t"] == "P" and every[3, "s"] is None
    assert {r.id for r in clean.remap_key(df, "id", {3: 9}).collect()} == {1, 2, 9}
    assert clean.drop_value(df, "v", "U").count() == 2
    assert clean.keep_or_unknown(df, F.col("v") == "N").count() == 3


def test_quantiles_of_many_groups_join_by_shuffle(spark, frame):
    rnd = random.Random(5)
    data = [(i % 300, rnd.random()) for i in range(3000)]
    df = frame(data, "g int, x double")
    small = table(describe.exact_quantiles(df, "x", [0.5], ["g"]), "g")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert table(describe.exact_quantiles(df, "x", [0.5], ["g"]), "g") == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert small[7] == pytest.approx(np.median([x for g, x in data if g == 7]))


def test_order_bits_are_the_bits_of_a_double(frame):
    rng = np.random.default_rng(1)
    xs = np.concatenate([
        rng.integers(-(2**63), 2**63 - 1, 4000, dtype=np.int64).view(np.float64), 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1000, 1024), 0),
        np.nextafter(2.0 ** np.arange(-1000, 1023), np.inf), [0.0, np.inf, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.5],
    ])
    xs = xs[~np.isnan(xs)]
    got = frame([(float(x),) for x in xs], "x double").select("x", describe.order_bits(F.col("x")).alias("k")).collect()
    for r in got:
        bits = int(np.float64(abs(r.x)).view(np.int64))
        assert r.k == (-bits if r.x < 0 else bits)


def test_quantiles_of_far_and_close_values(frame):
    xs = [-math.inf, -1e308, -5e-324, 0.0, 5e-324, 1.0, 1 + 2**-52, 1 + 2**-51, 1e308, math.inf]
    df = frame([(x,) for x in xs], "x double")
    for k in range(len(xs)):
        assert describe.exact_quantiles(df, "x", [k / (len(xs) - 1)]).first()[0] == xs[k]


def test_quantiles_without_values(frame):
    df = frame([(None,), (float("nan"),)], "x double")
    assert [tuple(r) for r in describe.exact_quantiles(df, "x", [0.5]).collect()] == [(None,)]
