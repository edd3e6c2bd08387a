"""Generalised estimating equations with exchangeable correlation (Liang and Zeger 1986).

The inverse of an exchangeable correlation matrix has a closed form, so a
cluster enters the equations through sums over its rows only. One iteration is

1. ``groupBy(model, cluster)``: p(p+1)/2 + 2p + 4 sums per cluster,
2. ``groupBy(model)``: the matrices B, U and the sum of U U',
3. p x p algebra on the driver; coefficients and correlation go back as literals.

Cells are laid out once by (model, cluster) and kept, so step 1 needs no exchange
in any pass. Clusters with very many distinct design rows lie apart, spread over
tasks, and their partial sums are added.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.intervals import coef_interval
from panelwise.functions.tails import normal_two_sided
from panelwise.operators.design import (
    Model,
    active,
    back,
    cells,
    centring,
    linear_predictor,
    mean_of,
    pearson_scale,
    per_model,
)
from panelwise.operators.glm import first_look
from panelwise.operators.linalg import pairs, symmetric

GEE_SCHEMA = (
    "model string, term string, estimate double, std_error double, wald double, p_value double, "
    "n bigint, n_clusters bigint, alpha double, phi double, iterations int, converged boolean"
)


def cluster_sums(frame: DataFrame, models: Sequence[Model], beta: dict[int, np.ndarray], width: int) -> DataFrame:
    """Sums of standardised design rows and residuals per cluster."""
    z, e = pearson_scale(models)
    aggs = [f"sum(n * z * z * x{a} * x{b}) AS zz{a}_{b}" for a, b in pairs(width)]
    for a in range(width):
        aggs += [f"sum(n * z * x{a}) AS z{a}", f"sum(z * r * x{a}) AS ze{a}"]
    aggs += ["sum(n) AS m", "sum(r) AS e", "sum(s * s * (syy - 2 * mu * sy + n * mu * mu)) AS ee", "max(eta) AS top"]
    return (
        frame.where(active(len(models), beta))
        .selectExpr("*", f"{linear_predictor(beta, width, len(models))} AS eta")
        .selectExpr("*", f"{mean_of(models)} AS mu")
        .selectExpr("*", f"{z} AS z", f"{e} AS s")
        .selectExpr("*", "s * (sy - n * mu) AS r")
        .groupBy("model", "cluster")
        .agg(*[F.expr(a) for a in aggs])
    )


class Layout(NamedTuple):
    """Cells by cluster: ordinary clusters whole in one partition, very large ones spread."""

    plain: DataFrame
    spread: DataFrame | None

    def sums(self, *args) -> DataFrame:
        """Cluster sums of both parts; the plain part needs no exchange."""
        own = cluster_sums(self.plain, *args)
        return own if self.spread is None else own.unionByName(cluster_sums(self.spread, *args))


def laid_out(frame: DataFrame, width: int, large: int) -> Layout:
    """One exchange for all passes of a fit. Clusters of more than `large` cells would fill one task, so they lie by range
    of their cells, and their partial sums are added in every pass; which ones they are is counted once."""
    huge = frame.groupBy("model", "cluster").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > large).select("model", "cluster")
    if huge.limit(1).count() == 0:
        return Layout(frame.repartition("model", "cluster").persist(StorageLevel.MEMORY_AND_DISK), None)
    rest = frame.join(huge, ["model", "cluster"], "left_anti").repartition("model", "cluster")
    wide = frame.join(huge, ["model", "cluster"], "left_semi").repartitionByRange("model", "cluster", *[f"x{i}" for i in range(1, width)])
    return Layout(rest.persist(StorageLevel.MEMORY_AND_DISK), wide.persist(StorageLevel.MEMORY_AND_DISK))


def equation_sums(layout: Layout, models: Sequence[Model], beta: dict[int, np.ndarray],
                  alpha: dict[int, float], width: int) -> dict[int, dict]:
    """B, U, sum of U U' and the moments behind scale and correlation, per model."""
    a = per_model(alpha, len(models))
    aggs = []
    for i, j in pairs(width):
        aggs += [f"sum(zz{i}_{j} - c * z{i} * z{j}) AS b{i}_{j}", f"sum(u{i} * u{j}) AS m{i}_{j}"]
    aggs += [f"sum(u{j}) AS u{j}" for j in range(width)]
    aggs += [
        "sum(ee) AS ee", "sum((e * e - ee) / 2) AS cross", "sum(m * (m - 1) / 2) AS pairs", "sum(m) AS n",
        "max(m) AS largest", "count(*) AS clusters", "max(top) AS top", "count_if(c IS NULL) AS undefined",
    ]
    rows = (
        layout.sums(models, beta, width)
        .selectExpr("*", f"try_divide({a}, 1 + (m - 1) * {a}) AS c")
        .selectExpr("*", *[f"ze{j} - c * z{j} * e AS u{j}" for j in range(width)])
        .groupBy("model")
        .agg(*[F.expr(x) for x in aggs])
        .collect()  # one row per model
    )
    out = {}
    for row in rows:
        d = {k: row[k] for k in ("ee", "cross", "pairs", "n", "largest", "clusters", "top", "undefined")}
        for name in "bm":
            d[name.upper()] = symmetric({(i, j): row[f"{name}{i}_{j}"] for i, j in pairs(width)}, width)
        d["U"] = np.array([row[f"u{j}"] for j in range(width)], dtype=float)
        out[row["model"]] = d
    return out


def _moments(s: dict, p: int, df_correct: bool) -> tuple[float, float]:
    """Scale and exchangeable correlation from standardised residuals."""
    lost = p if df_correct else 0
    phi = s["ee"] / max(s["n"] - lost, 1)
    if s["pairs"] - lost <= 0 or phi == 0:
        return phi, 0.0
    return phi, s["cross"] / ((s["pairs"] - lost) * phi)


def _finite(s: dict) -> bool:
    return s["ee"] is not None and bool(np.isfinite(s["B"]).all() and np.isfinite(s["U"]).all() and np.isfinite(s["M"]).all())


def fit_gee(df: DataFrame, models: Model | Sequence[Model], cluster: str, tol: float = 1e-8, max_iter: int = 50,
            corr: str = "exchangeable", df_correct: bool = False, large: int = 200_000) -> DataFrame:
    """Fit one or many models with robust standard errors.

    A cluster is every row with the same key, wherever the rows are. ``corr`` may
    be ``"independence"``. A correlation outside its valid range, a singular
    system or no convergence is reported through ``converged``.
    """
    models = [models] if isinstance(models, Model) else list(models)
    width = max(len(m.names) for m in models)
    centre = centring(df, models, cluster)
    frame = cells(df, models, cluster, centre).persist(StorageLevel.MEMORY_AND_DISK)
    layout = None
    try:
        layout = laid_out(frame, width, large)
        state = _iterate(frame, layout, models, width, tol, max_iter, corr, df_correct)
    finally:
        for kept in (frame, *(layout or ())):
            if kept is not None:
                kept.unpersist()
    # A model without a complete row is reported, not dropped.
    rows = [(m.name, t, *[None] * 4, 0, 0, None, None, 0, False) for i, m in enumerate(models) if i not in state for t in m.names]
    for i, s in sorted(state.items()):
        m, idx = models[i], s["free"]
        bread = np.linalg.pinv(s["B"][np.ix_(idx, idx)])
        matrix, constant = back(m, centre[i], width)
        beta = matrix @ s["beta"] + constant
        cov = matrix[:, idx] @ bread @ s["M"][np.ix_(idx, idx)] @ bread @ matrix[:, idx].T
        valid = s["converged"] and not s["undefined"] and (s["largest"] <= 1 or s["alpha"] > -1 / (s["largest"] - 1)) and s["alpha"] < 1
        for j in s["keep"]:
            term = m.names[j]
            est = se = None
            if j in idx:
                est, se = float(beta[j]), float(math.sqrt(max(cov[j, j], 0.0)))
            wald = (est / se) ** 2 if se else None
            p = normal_two_sided(est / se) if se else None
            rows.append((m.name, term, est, se, wald, p, int(s["n"]), int(s["clusters"]),
                         float(s["alpha"]), float(s["phi"]), s["iter"], bool(valid)))
    return df.sparkSession.createDataFrame(rows, GEE_SCHEMA)


def _iterate(frame, layout, models, width, tol, max_iter, corr, df_correct) -> dict[int, dict]:
    state = first_look(frame, models, width)
    start = {i: s["beta"] for i, s in state.items()}
    for i, s in equation_sums(layout, models, start, dict.fromkeys(start, 0.0), width).items():
        state[i].update(s, used=0.0)
    todo = set(state)
    for step in range(1, max_iter + 1):
        if not todo:
            break
        delta, trial, used, behind = {}, {}, {}, {}
        for i in todo:
            s = state[i]
            idx = s["free"]
            d = np.zeros(width)
            d[idx] = np.linalg.lstsq(s["B"][np.ix_(idx, idx)], s["U"][idx], rcond=None)[0]
            delta[i], trial[i], behind[i] = d, s["beta"] + d, s["used"]
            # Weights of the next evaluation use the correlation at the current
            # coefficients; the first steps stay independent until that settles.
            phi, a = _moments(s, len(idx), df_correct)
            used[i] = a if corr == "exchangeable" and step > 1 else 0.0
        new = equation_sums(layout, models, trial, used, width)
        for _ in range(20):
            bad = [i for i in trial if models[i].family == "binomial" and models[i].link == "log" and new[i]["top"] >= 0]
            if not bad:
                break
            for i in bad:
                delta[i] = delta[i] / 2
                trial[i] = state[i]["beta"] + delta[i]
            new.update(equation_sums(layout, models, {i: trial[i] for i in bad}, {i: used[i] for i in bad}, width))
        for i in list(todo):
            if not _finite(new[i]):
                # The outcome is separated: fitted means reach 0 or 1. The last coefficients stay, not converged.
                phi, a = _moments(state[i], len(state[i]["free"]), df_correct)
                state[i].update(iter=step, phi=phi, alpha=a)
                todo.discard(i)
                continue
            change = float(np.max(np.abs(delta[i])))
            phi, a = _moments(new[i], len(state[i]["free"]), df_correct)
            a = a if corr == "exchangeable" else 0.0
            # Settled only if the step itself was computed under this correlation.
            settled = change < tol and abs(a - behind[i]) < tol * 100
            state[i].update(new[i], beta=trial[i], iter=step, phi=phi, alpha=a, used=used[i])
            if settled:
                state[i]["converged"] = True
                todo.discard(i)
    return state


def with_interval(coefs: DataFrame, exponentiate: bool = True, linear: Sequence[str] = ()) -> DataFrame:
    """Coefficient frame plus estimate and interval.

    With ``exponentiate`` they are on the ratio scale, except for the models
    named in ``linear``.
    """
    plain = coef_interval("estimate", "std_error")
    ratio = coef_interval("estimate", "std_error", exponentiate=True)
    use_ratio = F.lit(exponentiate) & ~F.col("model").isin(*linear) if linear else F.lit(exponentiate)
    names = ("est", "lwr", "upr")
    return coefs.withColumns({n: F.when(use_ratio, b).otherwise(a) for n, a, b in zip(names, plain, ratio)})


def trend_models(outcomes: Sequence[tuple[str, str]], time: str, adjust: Sequence = (), prefix: str = "trend") -> list[Model]:
    """One linear-trend model per (outcome, family)."""
    out = []
    for outcome, family in outcomes:
        link = "identity" if family == "gaussian" else "logit"
        out.append(Model(f"{prefix}:{outcome}", outcome, (time, *adjust), family, link))
    return out


def trend_test(df: DataFrame, outcomes: Sequence[tuple[str, str]], time: str, cluster: str,
               adjust: Sequence = (), **options) -> DataFrame:
    """Trend coefficient of every outcome, adjusted or not, from one keyed fit."""
    models = trend_models(outcomes, time, adjust)
    return fit_gee(df, models, cluster, **options).where(F.col("term") == time)


def screen_models(response: str, predictors: Sequence, where: dict[str, Column] | None = None,
                  family: str = "binomial", link: str = "logit") -> list[Model]:
    """One univariate model per predictor, some on a restricted subset."""
    out = []
    for p in predictors:
        name = p if isinstance(p, str) else p.label
        out.append(Model(name, response, (p,), family, link, (where or {}).get(name)))
    return out


def predictor_screen(df: DataFrame, response: str, predictors: Sequence, cluster: str,
                     where: dict[str, Column] | None = None, **options) -> DataFrame:
    return fit_gee(df, screen_models(response, predictors, where), cluster, **options)
