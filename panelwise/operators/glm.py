"""Generalised linear models by iteratively reweighted least squares.

Each iteration is one aggregation over the cells of all models: the weighted
cross products come back as one row per model (p(p+1)/2 + p + a few numbers),
the new coefficients go out as literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.functions.tails import normal_two_sided
from panelwise.operators.design import (
    Model,
    WideFactor,
    active,
    back,
    by_kind,
    cells,
    centring,
    linear_predictor,
    mean_of,
    used_columns,
    working_weight,
)
from panelwise.operators.linalg import free_columns, pairs, symmetric

# Fixed value: 95% quantile of chi-square with one degree of freedom.
CHI2_95 = 3.841458820694124

COEF_SCHEMA = (
    "model string, term string, estimate double, std_error double, statistic double, p_value double, "
    "n bigint, deviance double, iterations int, converged boolean"
)
PROFILE_SCHEMA = "model string, term string, estimate double, lower double, upper double, converged boolean"


def _deviance(models: Sequence[Model], eta: str = "eta", mu: str = "mu") -> str:
    """Minus twice the log-likelihood of a cell (binary response) or its squared error."""
    softplus = f"(greatest({eta}, 0D) + log1p(exp(-abs({eta}))))"
    fail = f"CASE WHEN n > sy THEN (n - sy) * log1p(-least({mu}, 1D - 1e-16D)) ELSE 0D END"

    def kind(family: str, link: str) -> str:
        if family == "gaussian":
            return f"syy - 2 * {mu} * sy + n * {mu} * {mu}"
        return f"-2 * (sy * {eta} - n * {softplus})" if link == "logit" else f"-2 * (sy * {eta} + {fail})"

    return by_kind(models, kind)


def _sums(frame: DataFrame, models: Sequence[Model], beta: dict[int, np.ndarray], width: int) -> dict[int, dict]:
    """Score, information and deviance of every model at its coefficients."""
    weight, score = working_weight(models)
    aggs = [f"sum(x{a} * x{b} * w * n) AS h{a}_{b}" for a, b in pairs(width)]
    aggs += [f"sum(x{a} * r) AS u{a}" for a in range(width)]
    aggs += [f"sum({_deviance(models)}) AS dev", "max(eta) AS top", "sum(n) AS n"]
    rows = (
        frame.where(active(len(models), beta))
        .selectExpr("*", f"{linear_predictor(beta, width, len(models))} AS eta")
        .selectExpr("*", f"{mean_of(models)} AS mu")
        .selectExpr("*", f"{weight} AS w", f"(sy - n * mu) * {score} AS r")
        .groupBy("model")
        .agg(*[F.expr(a) for a in aggs])
        .collect()  # one row per model
    )
    out = {}
    for row in rows:
        out[row["model"]] = {
            "H": symmetric({(a, b): row[f"h{a}_{b}"] for a, b in pairs(width)}, width),
            "U": np.array([row[f"u{a}"] for a in range(width)], dtype=float),
            "dev": math.inf if row["dev"] is None else row["dev"],
            "top": row["top"], "n": row["n"],
        }
    return out


def first_look(frame: DataFrame, models: Sequence[Model], width: int) -> dict[int, dict]:
    """Start values and usable columns of every model, from one pass over the cells."""
    aggs = [f"sum(x{a} * x{b} * n) AS g{a}_{b}" for a, b in pairs(width)]
    out = {}
    for row in frame.groupBy("model").agg(F.expr("sum(sy) AS s"), *[F.expr(a) for a in aggs]).collect():  # one row per model
        m = models[row["model"]]
        gram = symmetric({(a, b): row[f"g{a}_{b}"] for a, b in pairs(width)}, width)
        mean = row["s"] / gram[0, 0]
        b = np.zeros(width)
        if m.link != "identity":
            mean = min(max(mean, 1e-6), 1 - 1e-6)
        b[0] = mean if m.link == "identity" else math.log(mean) if m.link == "log" else math.log(mean / (1 - mean))
        keep = used_columns(m, gram)
        out[row["model"]] = {"beta": b, "keep": keep, "free": free_columns(gram, keep), "iter": 0, "converged": False}
    return out


def _valid(m: Model, s: dict) -> bool:
    return math.isfinite(s["dev"]) and not (m.link == "log" and m.family == "binomial" and s["top"] >= 0)


def fit_cells(frame: DataFrame, models: Sequence[Model], width: int, tol: float = 1e-10,
              max_iter: int = 25) -> dict[int, dict]:
    """Fisher scoring for all models at once; a step that leaves the mean range is halved."""
    state = first_look(frame, models, width)
    todo = set(state)
    for i, s in _sums(frame, models, {i: state[i]["beta"] for i in state}, width).items():
        state[i].update(s)
    for step in range(1, max_iter + 1):
        if not todo:
            break
        trial, delta = {}, {}
        for i in todo:
            s = state[i]
            idx = s["free"]
            d = np.zeros(width)
            d[idx] = np.linalg.lstsq(s["H"][np.ix_(idx, idx)], s["U"][idx], rcond=None)[0]
            delta[i] = d
            trial[i] = s["beta"] + d
        new = _sums(frame, models, trial, width)
        for _ in range(20):
            bad = [
                i for i in trial
                if not _valid(models[i], new[i]) or new[i]["dev"] > state[i]["dev"] + 1e-7 * (abs(state[i]["dev"]) + 1)
            ]
            if not bad:
                break
            for i in bad:
                delta[i] = delta[i] / 2
                trial[i] = state[i]["beta"] + delta[i]
            new.update(_sums(frame, models, {i: trial[i] for i in bad}, width))
        for i in list(todo):
            old = state[i]["dev"]
            state[i].update(new[i], beta=trial[i], iter=step)
            if abs(new[i]["dev"] - old) / (abs(new[i]["dev"]) + 0.1) < tol:
                state[i]["converged"] = True
                todo.discard(i)
    return state


def _cached(df: DataFrame, models: Sequence[Model], centre: list[dict] | None = None) -> DataFrame:
    """Cells kept on the executors; a lost block is recomputed from the input."""
    return cells(df, models, None, centre).persist(StorageLevel.MEMORY_AND_DISK)


def fit_glm(df: DataFrame, models: Model | Sequence[Model], tol: float = 1e-10, max_iter: int = 25) -> DataFrame:
    """Coefficient frame of one or many models: estimate, standard error, test, p.

    Models with a wide factor are fitted one by one, with their levels as a table; all others share every pass.
    """
    models = [models] if isinstance(models, Model) else list(models)
    wide = [m for m in models if any(isinstance(t, WideFactor) for t in m.terms)]
    if wide:
        from panelwise.operators.wide import fit_wide

        parts = [fit_wide(df, m, tol, max_iter) for m in wide]
        if rest := [m for m in models if m not in wide]:
            parts.insert(0, fit_glm(df, rest, tol, max_iter))
        return reduce(DataFrame.unionByName, parts)
    width = max(len(m.names) for m in models)
    centre = centring(df, models)
    frame = _cached(df, models, centre)
    try:
        state = fit_cells(frame, models, width, tol, max_iter)
    finally:
        frame.unpersist()
    # A model without a complete row is reported, not dropped.
    rows = [(m.name, t, *[None] * 4, 0, None, 0, False) for i, m in enumerate(models) if i not in state for t in m.names]
    for i, s in sorted(state.items()):
        m, idx = models[i], s["free"]
        cov = np.full((width, width), np.nan)
        phi = 1.0
        if m.family == "gaussian":
            phi = s["dev"] / max(s["n"] - len(idx), 1)
        cov[np.ix_(idx, idx)] = np.linalg.pinv(s["H"][np.ix_(idx, idx)]) * phi
        matrix, constant = back(m, centre[i], width)
        beta = matrix @ s["beta"] + constant
        cov = matrix[:, idx] @ cov[np.ix_(idx, idx)] @ matrix[:, idx].T
        for j in s["keep"]:
            term = m.names[j]
            est = float(beta[j]) if j in idx else None
            se = float(math.sqrt(max(cov[j, j], 0.0))) if j in idx else None
            z = est / se if se else None
            rows.append((m.name, term, est, se, z, normal_two_sided(z), int(s["n"]), float(s["dev"]), s["iter"], s["converged"]))
    return _result(df.sparkSession, rows, COEF_SCHEMA)


def _result(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Result frame of driver-side numbers: one row per coefficient."""
    return spark.createDataFrame(rows, schema)


def profile_interval(df: DataFrame, model: Model, tol: float = 1e-8, max_iter: int = 40) -> DataFrame:
    """Profile-likelihood interval of every coefficient.

    For each coefficient and side the bound solves "score of the other
    coefficients is zero, deviance is the minimum plus 3.84" with Newton steps
    on both conditions at once (Venzon and Moolgavkar 1988). All bounds share
    one aggregation per step: each bound is a column set with its own literals.

    Rows are centred and scaled as in a fit. A plain coefficient is a linear function of the centred ones, so a bound is
    sought in coordinates of which that function is one and the other coefficients are the rest.
    """
    m = model
    p = len(m.names)
    centre = centring(df, [m])
    frame = _cached(df, [m], centre)
    try:
        fit = fit_cells(frame, [m], p).get(0)
        if fit is None:
            return _result(df.sparkSession, [(m.name, t, None, None, None, False) for t in m.names], PROFILE_SCHEMA)
        idx = fit["free"]
        matrix, constant = back(m, centre[0], p)
        plain = matrix @ fit["beta"] + constant
        info = fit["H"][np.ix_(idx, idx)]
        target = fit["dev"] + CHI2_95
        bounds, turns, spread = {}, {}, {}
        errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(info)), 1e-300))
        for j in idx:
            # c = to_c (b - fit) swaps the coefficient that weighs most in the plain one for it; b = fit + to_b c.
            pos = int(np.argmax(np.abs(matrix[j, idx]) * errors))
            to_c = np.eye(len(idx))
            to_c[pos] = matrix[j, idx]
            to_b = np.linalg.inv(to_c)
            turns[j] = pos, to_b
            h = to_b.T @ info @ to_b
            cov = np.linalg.pinv(h)
            spread[j] = np.sqrt(np.maximum(np.diag(cov), 1e-300))
            others = [k for k in range(len(idx)) if k != pos]
            direction = np.zeros(len(idx))
            direction[pos] = 1.0
            if others:
                direction[others] = -np.linalg.solve(h[np.ix_(others, others)], h[others, pos])
            for side in (-1, 1):
                bounds[j, side] = {"c": side * math.sqrt(CHI2_95 * cov[pos, pos]) * direction, "done": False}
        for _ in range(max_iter):
            todo = [k for k, v in bounds.items() if not v["done"]]
            if not todo:
                break
            sums = _many_sums(frame, m, idx, [fit["beta"][idx] + turns[k[0]][1] @ bounds[k]["c"] for k in todo], p)
            for k, s in zip(todo, sums):
                pos, to_b = turns[k[0]]
                score, h = to_b.T @ s["U"], to_b.T @ s["H"] @ to_b
                # In units of each coordinate's standard error, so that the equations are alike in size.
                unit = spread[k[0]]
                score, h = score * unit, h * np.outer(unit, unit)
                rows_ = [q for q in range(len(idx)) if q != pos]
                jac = np.vstack([h[rows_], 2 * score[None, :]])
                res = np.concatenate([score[rows_], [s["dev"] - target]])
                # Score has derivative -H, deviance has derivative -2 U.
                step = np.linalg.lstsq(jac, res, rcond=None)[0]
                size = np.max(np.abs(step))
                if abs(step[pos]) > 4:
                    step *= 4 / abs(step[pos])
                bounds[k]["c"] = bounds[k]["c"] + step * unit
                bounds[k]["done"] = bool(size < tol)
    finally:
        frame.unpersist()
    rows = []
    for j in fit["keep"]:
        term = m.names[j]
        if j not in idx:
            rows.append((m.name, term, None, None, None, None))
            continue
        pos, lo, hi = turns[j][0], bounds[j, -1], bounds[j, 1]
        ok = lo["done"] and hi["done"]
        rows.append((m.name, term, float(plain[j]), float(plain[j] + lo["c"][pos]), float(plain[j] + hi["c"][pos]), ok))
    return _result(df.sparkSession, rows, PROFILE_SCHEMA)


def _many_sums(frame: DataFrame, m: Model, idx: list[int], betas: list[np.ndarray], width: int) -> list[dict]:
    """Sums of one model at several coefficient vectors in a single pass."""
    aggs, etas, mus = [], [], []
    p, each = len(idx), range(len(betas))
    for t in each:
        eta, mu = f"eta{t}", f"mu{t}"
        etas.append(f"{linear_predictor({0: _full(betas[t], idx, width)}, width, 1)} AS {eta}")
        mus.append(f"{mean_of([m], eta)} AS {mu}")
        weight, score = working_weight([m], mu)
        aggs += [f"sum(x{idx[a]} * x{idx[b]} * {weight} * n) AS h{t}_{a}_{b}" for a, b in pairs(p)]
        aggs += [f"sum(x{idx[a]} * (sy - n * {mu}) * {score}) AS u{t}_{a}" for a in range(p)]
        aggs.append(f"sum({_deviance([m], eta, mu)}) AS d{t}")
    row = frame.selectExpr("*", *etas).selectExpr("*", *mus).selectExpr(*aggs).first()
    return [
        {
            "H": symmetric({(a, b): row[f"h{t}_{a}_{b}"] for a, b in pairs(p)}, p),
            "U": np.array([row[f"u{t}_{a}"] for a in range(p)]),
            "dev": row[f"d{t}"],
        }
        for t in each
    ]


def _full(b: np.ndarray, idx: list[int], width: int) -> np.ndarray:
    out = np.zeros(width)
    out[idx] = b
    return out
