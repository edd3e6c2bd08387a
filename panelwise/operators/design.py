"""Model frames: from a formula-like spec to weighted cells.

Every fit works on *cells*: distinct combinations of (model, cluster, design
row) with the number of rows and the sums of the response. Collapsing rows to
cells is one aggregation with map-side combining and loses nothing, so many
models over the same table share one scan and a very large cluster shrinks to
its distinct design rows before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Factor:
    """Categorical term, treatment coded; the first level is the reference."""

    column: str
    levels: tuple
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or self.column


@dataclass(frozen=True)
class WideFactor(Factor):
    """Categorical term of any number of levels, which stay a table; the least level found is the reference (see `wide`)."""

    levels: tuple = ()


def discover_levels(df: DataFrame, columns: Sequence[str], most: int = 100) -> list[Factor]:
    """A factor of every column, its levels being the sorted values found in the data.

    A column with more than ``most`` values becomes a wide factor, whose levels are not gathered: they are counted first.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    found = df.select(F.inline(pairs)).where("v IS NOT NULL").distinct()
    sizes = {r["c"]: r["k"] for r in found.groupBy("c").agg(F.count("*").alias("k")).collect()}
    listed = [c for c in columns if sizes.get(c, 0) <= most]
    values = found.where(F.col("c").isin(listed)).collect() if listed else []
    return [Factor(c, tuple(sorted(r["v"] for r in values if r["c"] == c))) if c in listed else WideFactor(c) for c in columns]


@dataclass(frozen=True)
class Model:
    """One regression: response, terms (column names or factors) and a row filter."""

    name: str
    response: str
    terms: tuple
    family: str = "binomial"  # or "gaussian"
    link: str = "logit"  # "log", "identity"
    where: Column | None = field(default=None, compare=False)

    @property
    def names(self) -> list[str]:
        out = ["(Intercept)"]
        for t in self.terms:
            out += [f"{t.label}{lv}" for lv in t.levels[1:]] if isinstance(t, Factor) else [t]
        return out

    @property
    def used(self) -> list[str]:
        return [self.response, *[t.column if isinstance(t, Factor) else t for t in self.terms]]

    def columns(self, centre: dict[str, tuple[float, float]] | None = None) -> list[Column]:
        """Design columns; numeric terms named in ``centre`` are shifted and scaled by it."""
        out = [F.lit(1.0)]
        for t in self.terms:
            if isinstance(t, Factor):
                out += [(F.col(t.column) == F.lit(lv)).cast("double") for lv in t.levels[1:]]
            else:
                shift, scale = (centre or {}).get(t, (0.0, 1.0))
                out.append((F.col(t).cast("double") - shift) / scale if (shift, scale) != (0.0, 1.0) else F.col(t).cast("double"))
        return out

    @property
    def numeric(self) -> list[str]:
        return [t for t in self.terms if not isinstance(t, Factor)]

    def complete(self, cluster: str | None) -> Column:
        """Rows without a missing value in any used column; unlisted levels count as missing."""
        conds = [F.col(c).isNotNull() for c in self.used]
        for t in self.terms:
            if isinstance(t, Factor):
                conds.append(F.coalesce(F.col(t.column).isin(*t.levels), F.lit(False)))
        if cluster:
            conds.append(F.col(cluster).isNotNull())
        if self.where is not None:
            conds.append(F.coalesce(self.where, F.lit(False)))
        return reduce(lambda a, b: a & b, conds)


def used_columns(model: Model, gram: np.ndarray) -> list[int]:
    """Design columns of the levels that occur, from the cross products of the design.

    The diagonal of a dummy column is its row count, so unused levels need no
    scan of their own. Without rows at the reference level the first used level
    takes its place.
    """
    n, keep, pos = gram[0, 0], [0], 1
    for t in model.terms:
        if not isinstance(t, Factor):
            keep.append(pos)
            pos += 1
            continue
        dummies = range(pos, pos + len(t.levels) - 1)
        used = [c for c in dummies if gram[c, c] > 0]
        if used and sum(gram[c, c] for c in used) >= n:
            used = used[1:]
        keep += used
        pos += len(t.levels) - 1
    return keep


def centring(df: DataFrame, models: Sequence[Model], cluster: str | None = None) -> list[dict[str, tuple[float, float]]]:
    """Shift and scale of every numeric term, and shift of a gaussian response, per model: one aggregation, one row.

    Means and deviations are brought to powers of two and their multiples, so that shifting and scaling loses no digits.
    """
    aggs = []
    for i, m in enumerate(models):
        for j, t in enumerate([*m.numeric, *([m.response] if m.family == "gaussian" else [])]):
            value = F.when(m.complete(cluster), F.col(t).cast("double"))
            aggs += [F.avg(value).alias(f"a{i}_{j}"), F.stddev_pop(value).alias(f"d{i}_{j}")]
    if not aggs:
        return [{} for _ in models]
    row = df.agg(*aggs).first()
    out = []
    for i, m in enumerate(models):
        own: dict[str, tuple[float, float]] = {}
        for j, t in enumerate([*m.numeric, *([RESPONSE] if m.family == "gaussian" else [])]):
            mean, spread = row[f"a{i}_{j}"], row[f"d{i}_{j}"]
            known = mean is not None and spread is not None and np.isfinite(mean) and np.isfinite(spread) and spread > 0
            step = 2.0 ** round(np.log2(spread)) if known else 1.0
            own[t] = (round(mean / step) * step if known else mean or 0.0, 1.0 if t == RESPONSE else step)
        out.append(own)
    return out


#: Key of the response in a model's centring.
RESPONSE = "(response)"


def back(m: Model, centre: dict[str, tuple[float, float]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and constant that bring coefficients of the centred design to the plain one."""
    matrix, constant, pos = np.eye(width), np.zeros(width), 1
    constant[0] = centre.get(RESPONSE, (0.0, 1.0))[0]
    for t in m.terms:
        if isinstance(t, Factor):
            pos += len(t.levels) - 1
            continue
        shift, scale = centre.get(t, (0.0, 1.0))
        matrix[pos, pos] = 1 / scale
        matrix[0, pos] = -shift / scale
        pos += 1
    return matrix, constant


def cells(df: DataFrame, models: Sequence[Model], cluster: str | None = None,
          centre: list[dict[str, tuple[float, float]]] | None = None) -> DataFrame:
    """``model, [cluster], x0..xk, n, sy, syy`` with shorter designs padded by zeros."""
    centre = centre or [{} for _ in models]
    width = max(len(m.names) for m in models)
    xs = [f"x{i}" for i in range(width)]
    rows = []
    for i, m in enumerate(models):
        cols = m.columns(centre[i]) + [F.lit(0.0)] * (width - len(m.names))
        shift = centre[i].get(RESPONSE, (0.0, 1.0))[0]
        body = F.struct(
            F.lit(i).alias("model"),
            (F.col(m.response).cast("double") - shift if shift else F.col(m.response).cast("double")).alias("y"),
            *[c.alias(x) for c, x in zip(cols, xs)],
        )
        rows.append(F.when(m.complete(cluster), body))
    keep = [F.col(cluster).alias("cluster")] if cluster else []
    keys = ["model", *(["cluster"] if cluster else []), *xs]
    long = df.select(*keep, F.explode(F.array(*rows)).alias("__m")).where("__m IS NOT NULL")
    long = long.select(*(["cluster"] if cluster else []), "__m.*")
    return long.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("y").alias("sy"),
        F.sum(F.col("y") * F.col("y")).alias("syy"),
    )


KINDS = {("binomial", "logit"), ("binomial", "log"), ("gaussian", "identity")}

# The pieces below are SQL expressions over the columns of a cell, so one pass of
# a fit is a single SQL statement. Numbers from the driver travel as array
# literals indexed by the model number: the generated code does not contain them
# and all iterations of a fit share it.


def number_array(values: Sequence[float]) -> str:
    return "array(" + ", ".join(f"{float(x)!r}D" for x in values) + ")"


def per_model(values: dict[int, float], n_models: int) -> str:
    """Number looked up by model, for instance the current correlation."""
    return f"{number_array([values.get(i, 0.0) for i in range(n_models)])}[model]"


def active(n_models: int, chosen) -> str:
    """Condition that keeps the cells of the chosen models."""
    return f"{per_model({i: 1.0 for i in chosen}, n_models)} > 0"


def linear_predictor(beta: dict[int, Sequence[float]], width: int, n_models: int) -> str:
    """Sum of coefficient times design column."""
    flat = [beta[i][j] if i in beta else 0.0 for i in range(n_models) for j in range(width)]
    table = number_array(flat)
    return " + ".join(f"x{j} * {table}[model * {width} + {j}]" for j in range(width))


def by_kind(models: Sequence[Model], f) -> str:
    """One expression per (family, link), chosen by model number where they differ."""
    kinds = sorted({(m.family, m.link) for m in models})
    if not set(kinds) <= KINDS:
        raise ValueError(f"supported family and link pairs: {sorted(KINDS)}, got {kinds}")
    if len(kinds) == 1:
        return f"({f(*kinds[0])})"
    cases = []
    for kind in kinds:
        ids = ", ".join(str(i) for i, m in enumerate(models) if (m.family, m.link) == kind)
        cases.append(f"WHEN model IN ({ids}) THEN {f(*kind)}")
    return f"(CASE {' '.join(cases)} END)"


def _by_link(models: Sequence[Model], identity: str, logit: str, log: str) -> str:
    return by_kind(models, lambda _, link: {"identity": identity, "logit": logit, "log": log}[link])


def mean_of(models: Sequence[Model], eta: str = "eta") -> str:
    return _by_link(models, eta, f"1D / (1D + exp(-{eta}))", f"exp({eta})")


def working_weight(models: Sequence[Model], mu: str = "mu") -> tuple[str, str]:
    """Information weight of a row and the factor of its residual in the score."""
    return (
        _by_link(models, "1D", f"{mu} * (1D - {mu})", f"try_divide({mu}, 1D - {mu})"),
        _by_link(models, "1D", "1D", f"try_divide(1D, 1D - {mu})"),
    )


def pearson_scale(models: Sequence[Model], mu: str = "mu") -> tuple[str, str]:
    """Factors that turn a design row and a residual into standardised ones."""
    sd = f"sqrt({mu} * (1D - {mu}))"
    return (
        _by_link(models, "1D", sd, f"try_divide({mu}, {sd})"),
        _by_link(models, "1D", f"try_divide(1D, {sd})", f"try_divide(1D, {sd})"),
    )
