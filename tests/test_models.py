import math
import random

import numpy as np
import pytest
from helpers import table
from pyspark.sql import functions as F

from panelwise.operators import gee, glm
from panelwise.operators.design import Factor, Model, cells

LEVELS = ("a", "b", "c")


def simulate(n_clusters=60, seed=0):
    rnd = random.Random(seed)
    rows = []
    for c in range(n_clusters):
        shift = rnd.gauss(0, 0.8)
        for _ in range(rnd.choice([1, 2, 3, 6])):
            x, g = round(rnd.uniform(-1, 2), 1), rnd.choice(LEVELS)
            eta = -0.8 + 0.5 * x + (0.4 if g == "b" else 0) + shift
            y = int(rnd.random() < 1 / (1 + math.exp(-eta)))
            rows.append((c, x, g, y, eta + rnd.gauss(0, 0.3)))
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def data():
    return simulate()


@pytest.fixture(scope="module")
def df(frame, data):
    return frame(data + [(5, None, "a", 1, 0.1), (6, 0.5, None, 0, 0.2), (7, 0.1, "other", 1, 0.3)],
                 "cl int, x double, g string, y int, z double")


def design(data):
    x = np.array([[1.0, r[1], r[2] == "b", r[2] == "c"] for r in data], dtype=float)
    return x, np.array([r[3] for r in data], float), np.array([r[4] for r in data]), np.array([r[0] for r in data])


def link(kind, eta):
    if kind == "identity":
        return eta, np.ones_like(eta), np.ones_like(eta)
    mu = 1 / (1 + np.exp(-eta)) if kind == "logit" else np.exp(eta)
    return mu, mu * (1 - mu) if kind == "logit" else mu, mu * (1 - mu)


def dense_gee(x, y, cl, kind, exchangeable=True):
    """Textbook matrix form of the estimating equations."""
    beta, alpha = np.zeros(x.shape[1]), 0.0
    if kind == "log":
        beta[0] = math.log(y.mean())
    for _ in range(200):
        mu, d, v = link(kind, x @ beta)
        e = (y - mu) / np.sqrt(v)
        phi = (e**2).mean()
        groups = [np.flatnonzero(cl == c) for c in np.unique(cl)]
        num = sum((e[i].sum() ** 2 - (e[i] ** 2).sum()) / 2 for i in groups)
        den = sum(len(i) * (len(i) - 1) / 2 for i in groups)
        alpha = num / (den * phi) if exchangeable and den else 0.0
        b, u, m = 0, 0, 0
        for i in groups:
            r = np.full((len(i), len(i)), alpha)
            np.fill_diagonal(r, 1.0)
            w = np.linalg.inv(np.sqrt(np.diag(v[i])) @ r @ np.sqrt(np.diag(v[i])))
            dd = d[i][:, None] * x[i]
            b, ui = b + dd.T @ w @ dd, dd.T @ w @ (y[i] - mu[i])
            u, m = u + ui, m + np.outer(ui, ui)
        step = np.linalg.solve(b, u)
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    inv = np.linalg.inv(b)
    return beta, np.sqrt(np.diag(inv @ m @ inv)), alpha, phi


@pytest.mark.parametrize("kind", ["identity", "logit", "log"])
def test_gee_equals_matrix_form(df, data, kind):
    x, y, z, cl = design(data)
    g = Factor("g", LEVELS)
    if kind == "log":
        x, model = x[:, [0, 2, 3]], Model("m", "y", (g,), "binomial", "log")
    else:
        model = Model("m", "z" if kind == "identity" else "y", ("x", g), "gaussian" if kind == "identity" else "binomial", kind)
    beta, se, alpha, phi = dense_gee(x, z if kind == "identity" else y, cl, kind)
    # one row without x is complete for the model that does not use x
    frame_ = df if kind != "log" else df.where("x IS NOT NULL")
    rows = gee.fit_gee(frame_, model, "cl", tol=1e-11).collect()
    assert all(r.converged for r in rows) and rows[0].n == len(data)
    assert np.allclose([r.estimate for r in rows], beta, atol=1e-8)
    assert np.allclose([r.std_error for r in rows], se, atol=1e-8)
    assert abs(rows[0].alpha - alpha) < 1e-8 and abs(rows[0].phi - phi) < 1e-8


def test_many_models_at_once_equal_single_fits(df):
    models = gee.screen_models("y", ["x", Factor("g", LEVELS)], {"x": F.col("x") > 0})
    models.append(Model("z", "z", ("x",), "gaussian", "identity"))
    together = {(r.model, r.term): r for r in gee.fit_gee(df, models, "cl", tol=1e-10).collect()}
    for m in models:
        for r in gee.fit_gee(df, m, "cl", tol=1e-10).collect():
            t = together[m.name, r.term]
            assert t.n == r.n and abs(t.estimate - r.estimate) < 1e-8 and abs(t.std_error - r.std_error) < 1e-8


def test_singleton_clusters_are_a_glm_with_robust_errors(frame, data):
    d = frame([(i, *r[1:]) for i, r in enumerate(data)], "cl int, x double, g string, y int, z double")
    m = Model("m", "y", ("x",))
    a = table(gee.fit_gee(d, m, "cl").select("term", "estimate", "alpha"), "term")
    b = table(glm.fit_glm(d, m).select("term", "estimate"), "term")
    assert all(abs(a[t][0] - b[t]) < 1e-8 and a[t][1] == 0.0 for t in b)


def test_duplicated_rows_keep_robust_errors_under_independence(frame, data):
    schema = "cl int, x double, g string, y int, z double"
    m = Model("m", "y", ("x",))
    one = table(gee.fit_gee(frame(data, schema), m, "cl", corr="independence").select("term", "estimate", "std_error"), "term")
    two = table(gee.fit_gee(frame(data * 2, schema), m, "cl", corr="independence").select("term", "estimate", "std_error"), "term")
    assert all(np.allclose(one[t], two[t], atol=1e-8) for t in one)


def test_binary_predictor_gives_the_cross_product_ratio(frame):
    rows = [(1, 1)] * 9 + [(1, 0)] * 3 + [(0, 1)] * 2 + [(0, 0)] * 8
    d = frame(rows, "x int, y int")
    out = table(glm.fit_glm(d, Model("m", "y", ("x",))).select("term", "estimate", "std_error", "p_value"), "term")
    est, se, p = out["x"]
    assert abs(est - math.log(9 * 8 / (3 * 2))) < 1e-8 and abs(se - math.sqrt(1 / 9 + 1 / 3 + 1 / 2 + 1 / 8)) < 1e-8
    assert abs(p - math.erfc(est / se / math.sqrt(2))) < 1e-9
    risk = table(glm.fit_glm(d, Model("m", "y", ("x",), "binomial", "log")).select("term", "estimate"), "term")
    assert abs(risk["x"] - math.log((9 / 12) / (2 / 10))) < 1e-8


def test_log_link_steps_back_from_the_boundary(frame):
    rows = [(x / 10, int(i < 1 + 9 * x / 10)) for x in range(11) for i in range(10)]
    d = frame(rows, "x double, y int")
    out = glm.fit_glm(d, Model("m", "y", ("x",), "binomial", "log"), max_iter=60).collect()
    assert all(math.isfinite(r.estimate) for r in out)
    assert sum(r.estimate for r in out) <= 1e-9  # fitted mean at x = 1 stays a probability


def test_unused_and_aliased_columns(df, frame):
    m = Model("m", "y", (Factor("g", ("missing", "a", "b", "c")), "x", "x2"))
    out = table(glm.fit_glm(df.withColumn("x2", F.col("x") * 2), m).select("term", "estimate"), "term")
    assert list(out) == ["(Intercept)", "gb", "gc", "x", "x2"] and out["x2"] is None
    base = table(glm.fit_glm(df, Model("m", "y", (Factor("g", LEVELS), "x"))).select("term", "estimate"), "term")
    assert all(abs(out[t] - base[t]) < 1e-7 for t in base)


def test_separation_is_reported_not_hidden(frame):
    d = frame([(0, 0)] * 5 + [(1, 1)] * 5 + [(2, i % 2) for i in range(10)], "x int, y int")
    out = table(glm.fit_glm(d, Model("m", "y", (Factor("x", (2, 0, 1)),))).select("term", "std_error"), "term")
    assert out["x0"] > 10 and out["x1"] > 10 and out["(Intercept)"] < 1


def test_gaussian_glm_equals_least_squares(df, data):
    x, _, z, _ = design(data)
    out = glm.fit_glm(df, Model("m", "z", ("x", Factor("g", LEVELS)), "gaussian", "identity")).collect()
    beta, rss, *_ = np.linalg.lstsq(x, z, rcond=None)
    s2 = ((z - x @ beta) ** 2).sum() / (len(z) - x.shape[1])
    assert np.allclose([r.estimate for r in out], beta, atol=1e-8)
    assert np.allclose([r.std_error for r in out], np.sqrt(np.diag(s2 * np.linalg.inv(x.T @ x))), atol=1e-8)


def test_profile_bounds_reach_the_deviance_target(df, data):
    x, y, _, _ = design(data)
    x = x[:, :2]

    def fit(offset, cols):
        b = np.zeros(len(cols))
        for _ in range(100):
            mu = 1 / (1 + np.exp(-(offset + x[:, cols] @ b)))
            b = b + np.linalg.solve(x[:, cols].T @ (x[:, cols] * (mu * (1 - mu))[:, None]), x[:, cols].T @ (y - mu))
        mu = 1 / (1 + np.exp(-(offset + x[:, cols] @ b)))
        return -2 * np.sum(y * np.log(mu) + (1 - y) * np.log(1 - mu))

    low = fit(0, [0, 1])
    only = df.where("x IS NOT NULL AND g IN ('a', 'b', 'c')")
    for j, row in enumerate(glm.profile_interval(only, Model("m", "y", ("x",))).collect()):
        assert row.converged and row.lower < row.estimate < row.upper
        for bound in (row.lower, row.upper):
            assert abs(fit(x[:, j] * bound, [1 - j]) - low - 3.841458820694124) < 1e-6


def test_cells_lose_nothing(df, data):
    total = cells(df, [Model("m", "y", ("x", Factor("g", LEVELS)))], "cl").agg(F.sum("n"), F.sum("sy")).first()
    assert tuple(total) == (len(data), sum(r[3] for r in data))


def test_trend_is_the_time_row(df):
    out = gee.trend_test(df, [("y", "binomial"), ("z", "gaussian")], "x", "cl", (Factor("g", LEVELS),)).collect()
    assert [(r.model, r.term) for r in out] == [("trend:y", "x"), ("trend:z", "x")]
    row = gee.with_interval(gee.trend_test(df, [("y", "binomial")], "x", "cl")).first()
    assert abs(row.est - math.exp(row.estimate)) < 1e-12 and row.lwr < row.est < row.upr


def test_model_without_rows_is_reported(df):
    empty = Model("none", "y", ("x",), where=F.lit(False))
    for out in (glm.fit_glm(df, [empty, Model("m", "y", ("x",))]), gee.fit_gee(df, [Model("m", "y", ("x",)), empty], "cl")):
        rows = {(r.model, r.term): r for r in out.collect()}
        assert rows["none", "x"].estimate is None and rows["none", "x"].n == 0 and not rows["none", "x"].converged
        assert rows["m", "x"].converged
    assert {r.n for r in glm.fit_glm(df, empty).collect()} == {0}
    assert [r.lower for r in glm.profile_interval(df, empty).collect()] == [None, None]


def test_large_means_lose_no_digits(df):
    """Shifting response and predictors changes neither slopes nor errors nor scale."""
    plain = df.withColumn("w", F.col("x") * 3)
    moved = plain.withColumns({"z": F.col("z") + 1e9, "x": F.col("x") + 202000.0})
    linear = Model("m", "z", ("x", Factor("g", LEVELS)), "gaussian", "identity")
    logit = Model("l", "y", ("x", Factor("g", LEVELS)))
    a, b = (table(gee.fit_gee(d, [linear], "cl").select("term", "estimate", "std_error", "phi", "alpha"), "term") for d in (plain, moved))
    for term in a:
        if term != "(Intercept)":
            assert np.allclose(a[term], b[term], rtol=1e-6, atol=1e-9)
    for model in (linear, logit):
        a, b = (table(glm.fit_glm(d, model).select("term", "estimate", "std_error", "converged"), "term") for d in (plain, moved))
        for term in a:
            if term != "(Intercept)":
                assert np.allclose(a[term][:2], b[term][:2], rtol=1e-5, atol=1e-8) and b[term][2]


def test_spread_clusters_give_the_same_fit(df):
    models = [Model("m", "z", ("x", Factor("g", LEVELS)), "gaussian", "identity"), Model("l", "y", ("x",))]
    a, b = (table(gee.fit_gee(df, models, "cl", large=n).select("model", "term", "estimate", "std_error", "alpha", "n_clusters"), "model", "term") for n in (200_000, 3))
    assert set(a) == set(b) and all(np.allclose(a[k], b[k], rtol=1e-7, atol=1e-9) for k in a)


def test_a_pass_needs_no_exchange_per_cluster(df):
    model = [Model("l", "y", ("x",))]
    layout = gee.laid_out(cells(df, model, "cl"), 2, 200_000)
    layout.plain.count()
    sums = layout.sums(model, {0: [-0.5, 0.0]}, 2)
    assert sums.count() == 60 and layout.spread is None
    top = sums._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert "Exchange" not in top
    layout.plain.unpersist()


def test_profile_interval_does_not_depend_on_the_origin_of_a_predictor(spark):
    rng = np.random.default_rng(9)
    rows = [(float(x), int(rng.random() < 1 / (1 + math.exp(-(0.4 * x - 0.5)))), "ab"[i % 2]) for i, x in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "x double, y int, g string").persist()
    got = {}
    for shift in (0.0, 202_000.0, 1e9):
        # Whole multiples of 2^-10 stay exact after the shift.
        moved = df.withColumn("x", F.round(F.col("x") * 1024) / 1024 + shift)
        out = glm.profile_interval(moved, Model("m", "y", ("x", Factor("g", ("a", "b")))))
        got[shift] = {r.term: r for r in out.collect()}
        assert all(r.converged for r in got[shift].values())
    for t in ("x", "gb"):
        for shift in (202_000.0, 1e9):
            for field in ("estimate", "lower", "upper"):
                assert got[shift][t][field] == pytest.approx(got[0.0][t][field], abs=1e-6)
    # Each bound by a search along the profile: the deviance there is the least one plus 3.84.
    x, y, g = (np.array(v) for v in zip(*[(round(r[0] * 1024) / 1024, r[1], float(r[2] == "b")) for r in rows]))
    plain = got[0.0]

    def deviance(fixed, value):
        columns = np.stack([np.ones_like(x), x, g], 1)
        free = [k for k in range(3) if k != fixed]
        b = np.zeros(3)
        b[fixed] = value
        for _ in range(60):
            mu = 1 / (1 + np.exp(-columns @ b))
            f = columns[:, free]
            b[free] += np.linalg.solve((f * (mu * (1 - mu))[:, None]).T @ f, f.T @ (y - mu))
        mu = 1 / (1 + np.exp(-columns @ b))
        return -2 * np.sum(y * np.log(mu) + (1 - y) * np.log(1 - mu))

    for k, t in enumerate(("(Intercept)", "x", "gb")):
        least = deviance(k, plain[t].estimate)
        for bound in (plain[t].lower, plain[t].upper):
            assert deviance(k, bound) - least == pytest.approx(3.841458820694124, abs=1e-5)
