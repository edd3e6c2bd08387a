import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import gee, glm, wide
from panelwise.operators.design import Factor, Model, WideFactor, discover_levels


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(3000):
        g, x, k = int(rng.integers(0, 12)), float(rng.normal(202_000, 3)), "abc"[int(rng.integers(0, 3))]
        eta = -0.4 + 0.2 * (g % 5 - 2) + 0.3 * (x - 202_000) / 3 + (k == "b") * 0.5
        y = int(rng.random() < 1 / (1 + math.exp(-eta)))
        out.append((None if i % 97 == 0 else f"g{g:02d}", x, k, None if i % 101 == 0 else y, 5 * eta + float(rng.normal()) + 1e6))
    return spark.createDataFrame(out, "g string, x double, k string, y int, z double").persist()


LEVELS = tuple(f"g{i:02d}" for i in range(12))


@pytest.mark.parametrize("response,family,link,terms", [
    ("y", "binomial", "logit", ()),
    ("y", "binomial", "logit", ("x", Factor("k", ("a", "b", "c")))),
    ("y", "binomial", "log", ()),
    ("z", "gaussian", "identity", ("x", Factor("k", ("a", "b", "c")))),
])
def test_wide_factor_equals_dense_fit(rows, response, family, link, terms):
    dense = glm.fit_glm(rows, Model("m", response, (*terms, Factor("g", LEVELS)), family, link), tol=1e-13)
    got = wide.fit_wide(rows, Model("m", response, (*terms, WideFactor("g")), family, link), tol=1e-13)
    assert got.columns == dense.columns
    mine, theirs = ({r.term: r for r in d.collect()} for d in (got, dense))
    assert mine.keys() == theirs.keys()
    for t, b in theirs.items():
        a = mine[t]
        assert a.estimate == pytest.approx(b.estimate, rel=1e-6, abs=1e-6) and a.std_error == pytest.approx(b.std_error, rel=1e-6)
        assert a.p_value == pytest.approx(b.p_value, abs=1e-7) and a.n == b.n and a.deviance == pytest.approx(b.deviance, rel=1e-8) and a.converged


def test_twenty_thousand_levels(spark):
    k = 20_000
    df = spark.range(10 * k).select(
        F.concat(F.lit("l"), F.lpad((F.col("id") % k).cast("string"), 5, "0")).alias("g"), (F.xxhash64("id") % 1000 / 500).alias("x"),
        ((F.floor(F.col("id") / k) + F.col("id") % 3) % 4 < 2).cast("int").alias("y"), (F.xxhash64("id", F.lit(1)) % 100).alias("e"),
    ).withColumn("z", 2 * F.col("x") + F.substring("g", 2, 5).cast("int") / 1000 + F.col("e") / 1000)
    got = wide.fit_wide(df, Model("m", "z", ("x", WideFactor("g")), "gaussian", "identity"))
    assert got.count() == k + 1
    few = {r.term: r for r in got.where(F.col("term").isin("x", "(Intercept)", "gl19999")).collect()}
    assert few["x"].estimate == pytest.approx(2, abs=1e-3) and few["gl19999"].estimate == pytest.approx(19.999, abs=0.1) and few["x"].converged
    # Within-level regression of the gaussian model, by plain aggregates.
    means = df.groupBy("g").agg(F.avg("x").alias("mx"), F.avg("z").alias("mz"))
    part = df.join(means, "g").select((F.col("x") - F.col("mx")).alias("a"), (F.col("z") - F.col("mz")).alias("b"))
    slope = part.agg(F.sum(F.col("a") * F.col("b")) / F.sum(F.col("a") * F.col("a"))).first()[0]
    assert few["x"].estimate == pytest.approx(slope, rel=1e-9)
    logit = wide.fit_wide(df, Model("m", "y", (WideFactor("g"),)), tol=1e-12)
    sample = {r.term: r.estimate for r in logit.where("term IN ('(Intercept)', 'gl00001', 'gl13337')").collect()}
    rate = {r.g: r.p for r in df.groupBy("g").agg(F.avg("y").alias("p")).where("g IN ('l00000', 'l00001', 'l13337')").collect()}
    odds = {g: math.log(p / (1 - p)) for g, p in rate.items()}
    assert sample["(Intercept)"] == pytest.approx(odds["l00000"], abs=1e-6)
    for g in ("l00001", "l13337"):
        assert sample["g" + g] == pytest.approx(odds[g] - odds["l00000"], abs=1e-6)


def test_levels_of_one_outcome_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", 1), ("c", 0), ("c", 1)], "g string, y int")
    got = {r.term: r for r in wide.fit_wide(df, Model("m", "y", (WideFactor("g"),))).collect()}
    assert got["gb"].estimate > 5 and got["gc"].estimate == pytest.approx(0, abs=1e-9)
    none = wide.fit_wide(df.where("y > 5"), Model("m", "y", (WideFactor("g"),))).collect()
    assert [(r.term, r.estimate, r.n) for r in none] == [("(Intercept)", None, 0)]
    with pytest.raises(ValueError):
        wide.fit_wide(df, Model("m", "y", ("g",)))


def test_discovered_levels_have_no_limit(rows):
    few, many = discover_levels(rows, ["k", "g"], most=5)
    assert few.levels == ("a", "b", "c") and isinstance(many, WideFactor) and many.label == "g"
    both = glm.fit_glm(rows, [Model("few", "y", (few,)), Model("many", "y", (many,))]).groupBy("model").count().collect()
    assert {r["model"]: r["count"] for r in both} == {"few": 3, "many": 12}


def test_gee_reports_a_wide_factor_without_a_result(rows):
    got = gee.fit_gee(rows.withColumn("c", F.floor(F.rand(1) * 50)), [Model("wide", "y", (WideFactor("g"),)), Model("x", "y", ("x",))], "c").collect()
    assert [(r.estimate, r.n, r.converged) for r in got if r.model == "wide"] == [(None, 0, False)] and len(got) == 3
