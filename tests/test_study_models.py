"""The study's adjusted and multi-level models on the derived sheet against the matrix form of the equations."""

import math
from collections import Counter

import numpy as np
import pytest
from test_models import dense_gee

from panelwise.catalog import QUERIES
from panelwise.catalog.study_models import _study
from panelwise.operators import gee
from panelwise.operators.design import Model
from panelwise.plans import prep, reports
from panelwise.plans import values as v

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def study(spark):
    return _study(spark, FOLDER)


def dense(rows, response, columns, kind):
    """Fit of complete rows; columns are functions of a row, None where unknown."""
    known = [([1.0, *[c(r) for c in columns]], r[response], r["id"]) for r in rows]
    known = [k for k in known if k[1] is not None and None not in k[0]]
    x, y, cl = (np.array(z, float) for z in zip(*known, strict=True))
    return (*dense_gee(x, y, cl, kind), len(y))


def dummies(column, levels):
    return [lambda r, lv=lv: None if r[column] not in levels else float(r[column] == lv) for lv in levels[1:]]


def test_adjusted_trends(spark, study):
    rows = [r.asDict() for r in prep.trend_frame(study).collect()]
    got = {}
    for r in QUERIES["study_trends"](spark, FOLDER).collect():
        got.setdefault(r.model, []).append(r)
    assert len(got) == 6
    columns = [lambda r: r["visit_num"], lambda r: r["age"], *dummies("ethnic_group_cat", v.ETHNIC_GROUP_LEVELS), *dummies("edu", v.EDU_LEVELS)]
    for response, family in reports.TREND_OUTCOMES:
        mine = got[f"trend:{response}"]
        if not any(r[response] is not None for r in rows):
            assert all(r.estimate is None and r.n == 0 for r in mine)
            continue
        beta, se, alpha, phi, n = dense(rows, response, columns, "identity" if family == "gaussian" else "logit")
        assert [r.term for r in mine][:3] == ["(Intercept)", "visit_num", "age"] and len(mine) == len(beta) and {r.n for r in mine} == {n}
        np.testing.assert_allclose([r.estimate for r in mine], beta, atol=2e-6)
        np.testing.assert_allclose([r.std_error for r in mine], se, atol=2e-6)
        np.testing.assert_allclose([mine[0].alpha, mine[0].phi], [alpha, phi], rtol=1e-4, atol=2e-6)


def test_baseline_predictors(spark, study):
    rows = [r.asDict() for r in prep.predictor_frame(study).collect()]
    got = {}
    for r in QUERIES["study_baseline_predictors"](spark, FOLDER).collect():
        got.setdefault(r.model, []).append(r)
    levels = {"age_cat": v.AGE_LEVELS, "registered": v.REGISTERED_LEVELS, "ethnic_group_cat": v.ETHNIC_GROUP_LEVELS, "edu": v.EDU_LEVELS}
    levels["site"] = tuple(sorted({r["site"] for r in rows if r["site"] is not None}))
    assert got.keys() == levels.keys()
    for name, own in levels.items():
        beta, se, *_, n = dense(rows, "yc_result", dummies(name, own), "logit")
        assert [r.term for r in got[name]] == ["(Intercept)", *[f"{name}{lv}" for lv in own[1:]]] and got[name][0].n == n
        np.testing.assert_allclose([r.estimate for r in got[name]], beta, atol=2e-6)
        # A level of one person has a robust variance of zero, up to rounding.
        np.testing.assert_allclose([r.std_error for r in got[name]], np.nan_to_num(se), atol=2e-6)


def test_one_row_exact_tests(spark):
    """Against sums over all tables in whole numbers."""
    small = "/root/testdata/sf0.001"
    study = _study(spark, small)
    rows = [r.asDict() for r in prep.predictor_frame(study, random_one=True).collect()]
    answers = {(r["id"], r["visit"]): r for r in study.behaviour.collect()}
    got = {r.test: r for r in QUERIES["study_one_row_fisher"](spark, small).collect()}

    def level(name, r):
        if name == "clients_fine":
            n = answers[r["id"], r["visit"]]["NbreClieDernSemaine"]
            return None if n is None else min(n, 4)
        return r[name] if name in r else answers[r["id"], r["visit"]][name]

    for name in ("age_cat", "ethnic_group_cat", "edu", "FreqUtilPreservatif", "clients_fine"):
        counts = Counter((level(name, r), r["value"] == v.POSITIVE) for r in rows if r["value"] is not None and level(name, r) is not None)
        sizes = {k: counts[k, True] + counts[k, False] for k, _ in counts}
        ways = {(0, 1): 1}
        for size in sizes.values():
            new = Counter()
            for (total, weight), many in ways.items():
                for x in range(size + 1):
                    new[total + x, weight * math.comb(size, x)] += many
            ways = new
        k, seen = sum(counts[c, True] for c in sizes), math.prod(math.comb(n, counts[c, True]) for c, n in sizes.items())
        p = sum(w * many for (total, w), many in ways.items() if total == k and w <= seen) / math.comb(sum(sizes.values()), k)
        assert got[name].n == sum(sizes.values()) and got[name].p_value == pytest.approx(p, abs=1e-8)


def test_separated_outcome_does_not_end_the_other_fits(spark):
    rows = [(c, float(x), int(x > 0), (7 * c + 3 * i + c * i) % 5 % 2) for c in range(30) for i, x in enumerate((-1, 1, 2, -3))]
    df = spark.createDataFrame(rows, "id int, x double, y int, z int")
    out = gee.fit_gee(df, [Model("separated", "y", ("x",)), Model("fine", "z", ("x",))], "id").collect()
    assert {r.converged for r in out if r.model == "separated"} == {False} and {r.converged for r in out if r.model == "fine"} == {True}
