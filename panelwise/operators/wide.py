"""Generalised linear models with one factor of any number of levels.

The factor's block of the cross products is diagonal, so it is eliminated level by level instead of being summed as a matrix:

1. cells (level, design row of the other terms) are laid out by level once,
2. a pass sums, per level, its weight d, the weighted design row b of the other terms and both scores,
3. the sums of  a - b b' / d  and  g - b u / d  over levels are the equations of the other terms alone (their Schur complement);
   only these, one row of q(q+1)/2 + q numbers, reach the driver,
4. a level's own step is  (u - b step) / d  and stays with the level.

Levels and their coefficients are a table; no list of levels is gathered, sent out or compiled into a plan. The fit uses one mean
per level; coefficients against the least level, with their errors, follow at the end from the same sums.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.functions.tails import chi2_sf
from panelwise.operators.design import RESPONSE, Factor, Model, WideFactor, centring, mean_of, number_array, working_weight
from panelwise.operators.glm import COEF_SCHEMA, _deviance, _valid
from panelwise.operators.linalg import pairs, symmetric
from panelwise.session import ensure_checkpoint_dir


def _split(model: Model) -> tuple[WideFactor, Model]:
    """The wide factor of a model, and the model of its other terms."""
    wide = [t for t in model.terms if isinstance(t, WideFactor)]
    if len(wide) != 1:
        raise ValueError(f"{model.name}: exactly one wide factor is supported, got {len(wide)}")
    rest = tuple(t for t in model.terms if t is not wide[0])
    where = F.col(wide[0].column).isNotNull()
    where = where if model.where is None else where & F.coalesce(model.where, F.lit(False))
    return wide[0], Model(model.name, model.response, rest, model.family, model.link, where)


def wide_cells(df: DataFrame, factor: WideFactor, rest: Model, centre: dict) -> DataFrame:
    """(level, x0.., n, sy, syy): cells of the complete rows, x the other terms without the intercept."""
    xs = rest.columns(centre)[1:]
    shift = centre.get(RESPONSE, (0.0, 1.0))[0]
    rows = df.where(rest.complete(None)).select(
        F.col(factor.column).cast("string").alias("level"), (F.col(rest.response).cast("double") - shift).alias("y"),
        *[x.alias(f"x{i}") for i, x in enumerate(xs)],
    )
    return rows.groupBy("level", *[f"x{i}" for i in range(len(xs))]).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")
    )


class _Fit:
    """State of a fit: coefficients of the other terms on the driver, those of the levels in a table."""

    def __init__(self, frame: DataFrame, rest: Model, width: int):
        self.frame, self.rest, self.width = frame, rest, width

    def levels(self, table: DataFrame, delta: np.ndarray, step: np.ndarray, part: float) -> DataFrame:
        """Sums of every level at coefficients delta + part * step; table has (level, gamma, move)."""
        weight, score = working_weight([self.rest])
        q = range(self.width)
        values = number_array(list(delta + part * step) + [part])
        # The array is indexed by a column, so the generated code does not depend on the numbers.
        linear = " + ".join(["gamma + move * v[zero + " + str(self.width) + "]", *[f"x{i} * v[zero + {i}]" for i in q]])
        now = self.frame.join(table.select("level", "gamma", "move"), "level").selectExpr("*", f"{values} AS v").selectExpr("*", f"{linear} AS eta")
        now = now.selectExpr("*", f"{mean_of([self.rest])} AS mu").selectExpr("*", f"{weight} * n AS w", f"(sy - n * mu) * {score} AS r")
        aggs = ["sum(w) AS d", "sum(r) AS u", "sum(n) AS n", f"sum({_deviance([self.rest])}) AS dev", "max(eta) AS top"]
        aggs += [f"sum(w * x{i}) AS b{i}" for i in q] + [f"sum(r * x{i}) AS g{i}" for i in q]
        aggs += [f"sum(w * x{i} * x{j}) AS a{i}_{j}" for i, j in pairs(self.width)]
        out = now.groupBy("level").agg(F.expr(f"max(gamma + move * {part!r}D) AS gamma"), *[F.expr(a) for a in aggs])
        return out.checkpoint()

    def equations(self, levels: DataFrame) -> dict:
        """Schur complement and score of the other terms: one row."""
        q = range(self.width)
        aggs = ["sum(dev) AS dev", "max(top) AS top", "sum(n) AS n", "count(*) AS levels"]
        aggs += [f"sum(a{i}_{j} - coalesce(try_divide(b{i} * b{j}, d), 0D)) AS s{i}_{j}" for i, j in pairs(self.width)]
        aggs += [f"sum(g{i} - coalesce(try_divide(b{i} * u, d), 0D)) AS t{i}" for i in q]
        row = levels.agg(*[F.expr(a) for a in aggs]).first()
        return {
            "dev": math.inf if row["dev"] is None else row["dev"], "top": row["top"], "n": row["n"], "levels": row["levels"],
            "S": symmetric({(i, j): row[f"s{i}_{j}"] for i, j in pairs(self.width)}, self.width), "T": np.array([row[f"t{i}"] for i in q], float),
        }

    def moved(self, levels: DataFrame, step: np.ndarray) -> DataFrame:
        """(level, gamma, move): the step of every level, given that of the other terms."""
        own = " - ".join(["u", *[f"b{i} * ({float(s)!r}D)" for i, s in enumerate(step)]])
        return levels.selectExpr("level", "gamma", f"coalesce(try_divide({own}, d), 0D) AS move")


def fit_wide(df: DataFrame, model: Model, tol: float = 1e-10, max_iter: int = 25) -> DataFrame:
    """Coefficient frame of a model with one wide factor, like `fit_glm`'s: one row per term and per level but the least.

    Rows that miss a used value are left out. A model without a complete row gives one row for the intercept.
    """
    ensure_checkpoint_dir(df.sparkSession)
    factor, rest = _split(model)
    centre = centring(df, [rest])[0]
    width = len(rest.names) - 1
    frame = wide_cells(df, factor, rest, centre).repartition("level").withColumn("zero", F.lit(0) * F.size(F.array("n"))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fitted(frame, model, factor, rest, centre, width, tol, max_iter)
    finally:
        frame.unpersist()


def _fitted(frame, model, factor, rest, centre, width, tol, max_iter) -> DataFrame:
    spark = frame.sparkSession
    fit = _Fit(frame, rest, width)
    mean = frame.agg(F.sum("sy") / F.sum("n")).first()[0]
    if mean is None:
        return spark.createDataFrame([(model.name, "(Intercept)", *[None] * 4, 0, None, 0, False)], COEF_SCHEMA)
    if rest.link != "identity":
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        mean = math.log(mean) if rest.link == "log" else math.log(mean / (1 - mean))
    none, delta = np.zeros(width), np.zeros(width)
    start = frame.select("level").distinct().select("level", F.lit(float(mean)).alias("gamma"), F.lit(0.0).alias("move"))
    levels = fit.levels(start, delta, none, 0.0)
    now, converged, step_no = fit.equations(levels), False, 0
    for step_no in range(1, max_iter + 1):
        step = np.linalg.lstsq(now["S"], now["T"], rcond=None)[0] if width else none
        table, part = fit.moved(levels, step), 1.0
        for _ in range(20):
            trial = fit.levels(table, delta, step, part)
            new = fit.equations(trial)
            if _valid(rest, new) and new["dev"] <= now["dev"] + 1e-7 * (abs(now["dev"]) + 1):
                break
            part /= 2
        delta, old, levels, now = delta + part * step, now["dev"], trial, new
        if abs(now["dev"] - old) / (abs(now["dev"]) + 0.1) < tol:
            converged = True
            break
    return _coefficients(levels, now, model, factor, rest, centre, delta, width, step_no, converged)


def _coefficients(levels, now, model, factor, rest, centre, delta, width, steps, converged) -> DataFrame:
    spark = levels.sparkSession
    names, q = rest.names[1:], range(width)
    free = [i for i in q if now["S"][i, i] > 1e-9 * max(1.0, float(np.max(np.abs(now["S"]))))] if width else []
    inverse = np.zeros((width, width))
    inverse[np.ix_(free, free)] = np.linalg.pinv(now["S"][np.ix_(free, free)]) if free else 0
    phi = now["dev"] / max(now["n"] - now["levels"] - len(free), 1) if rest.family == "gaussian" else 1.0
    # Back to the plain scale of the other terms; their shifts only move the intercept.
    scale, shift, pos = np.ones(width), np.zeros(width), 0
    for t in rest.terms:
        if isinstance(t, Factor):
            pos += len(t.levels) - 1
        else:
            shift[pos], scale[pos] = centre.get(t, (0.0, 1.0))
            pos += 1
    base = levels.orderBy("level").first()
    v0 = np.array([base[f"b{i}"] / base["d"] if base["d"] else 0.0 for i in q])
    plain = delta / scale
    rows = [(model.name, name, float(plain[i]) if i in free else None, float(math.sqrt(max(phi * inverse[i, i], 0)) / scale[i]) if i in free else None) for i, name in enumerate(names)]
    # The intercept is the least level's mean where all other terms are zero, that is at -shift / scale.
    at = v0 + shift / scale
    intercept = base["gamma"] + centre.get(RESPONSE, (0.0, 1.0))[0] - float(shift @ plain)
    rows.insert(0, (model.name, "(Intercept)", float(intercept), float(math.sqrt(phi * ((1 / base["d"] if base["d"] else 0.0) + at @ inverse @ at)))))
    few = spark.createDataFrame(rows, "model string, term string, estimate double, std_error double")

    # Every other level against the base: 1/d + 1/d0 + (v - v0)' S^-1 (v - v0), in the JVM, one row a level.
    diff = [f"(b{i} / d - ({float(v0[i])!r}D))" for i in q]
    quad = " + ".join([f"({float(inverse[i, j] * (1 if i == j else 2))!r}D) * {diff[i]} * {diff[j]}" for i, j in pairs(width)] or ["0D"])
    variance = f"({phi!r}D) * (1 / d + ({1 / base['d'] if base['d'] else 0.0!r}D) + {quad})"
    many = levels.where(F.col("level") > base["level"]).select(
        F.lit(model.name).alias("model"), F.concat(F.lit(factor.label), "level").alias("term"),
        (F.col("gamma") - base["gamma"]).alias("estimate"), F.expr(f"CASE WHEN d > 0 THEN sqrt(greatest({variance}, 0D)) END").alias("std_error"),
    )
    out = few.unionByName(many).withColumn("statistic", F.expr("try_divide(estimate, std_error)"))
    return out.select(
        "model", "term", "estimate", "std_error", "statistic", chi2_sf(F.pow("statistic", F.lit(2)), F.lit(1)).alias("p_value"), F.lit(int(now["n"])).cast("bigint").alias("n"),
        F.lit(float(now["dev"])).alias("deviance"), F.lit(steps).alias("iterations"), F.lit(converged).alias("converged"),
    )
