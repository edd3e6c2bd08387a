"""Exact tests in numpy, for the batches of a task: log probabilities, 2 x 2 tables, r x 2 tables.

Logarithms of binomial probabilities come from the deviance form (saddle-point expansion), which loses no digits however
large the counts are, unlike differences of log factorials. Sums over a support run over its spread, not over its
length: where the spread is wide, over a grid of some sixty points a standard deviation with end corrections
(Euler-Maclaurin), which agrees with the sum over all whole numbers to about 1e-12.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

# Relative slack when comparing table probabilities, confidence level.
SLACK = 1e-7
CONF = 0.95
#: Terms below exp(-FAINT) of what they are added to are left out.
FAINT = 45.0
#: Grid points a standard deviation.
GRID = 64
#: Array entries that a step works on at once.
ENTRIES = 1 << 20

_SMALL = np.array([0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)])


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """log n! less Stirling's formula, for n >= 1."""
    small = n < 16
    m = np.where(small, 16.0, n)
    i2 = 1.0 / (m * m)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - i2 / 1188) * i2) * i2) * i2) / m
    return np.where(small, _SMALL[np.where(small, n, 0).astype(np.int64)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x, for x > 0."""
    d = x - mean
    v = d / (x + mean)
    near = np.abs(v) < 0.1
    v2 = np.where(near, v * v, 0.0)
    tail = 1 / 19
    for k in (17, 15, 13, 11, 9, 7, 5, 3):
        tail = 1 / k + v2 * tail
    series = d * v + 2 * x * v * v2 * tail
    with np.errstate(divide="ignore", invalid="ignore"):
        far = x * np.log(x / mean) - d
    return np.where(near, series, far)


def log_binomial(x, m, q) -> np.ndarray:
    """log of C(m, x) q^x (1 - q)^(m - x); minus infinity outside 0..m."""
    x, m, q = np.broadcast_arrays(np.asarray(x, float), np.asarray(m, float), np.asarray(q, float))
    y = m - x
    inner = (x > 0) & (y > 0) & (q > 0) & (q < 1)
    a, b, p = np.where(inner, x, 1.0), np.where(inner, y, 1.0), np.where(inner, q, 0.5)
    t = a + b
    out = _stirling_error(t) - _stirling_error(a) - _stirling_error(b) - _deviance(a, t * p) - _deviance(b, t * (1 - p)) + 0.5 * np.log(t / (2 * np.pi * a * b))
    with np.errstate(divide="ignore", invalid="ignore"):
        none = np.where(m == 0, 0.0, m * np.log1p(-q))
        every = m * np.log(q)
    return np.where(inner, out, np.where(x == 0, none, np.where(y == 0, every, -np.inf)))


def log_hypergeometric(x, m1, m2, k) -> np.ndarray:
    """log probability that k draws from m1 + m2 hold x of the first kind."""
    m1, m2, k = (np.asarray(v, float) for v in (m1, m2, k))
    with np.errstate(divide="ignore", invalid="ignore"):
        q = np.where(m1 + m2 > 0, k / (m1 + m2), 0.0)
    return log_binomial(x, m1, q) + log_binomial(np.asarray(k, float) - x, m2, q) - log_binomial(k, m1 + m2, q)


def _variance(m: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    n1 = np.maximum(n, 1)
    return m * (k / n1) * (1 - k / n1) * (n - m) / np.maximum(n - 1, 1)


def _reach(e: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """Distance from the mean beyond which a tail is below exp(-e) (Bernstein)."""
    return e / 3 + np.sqrt(e * e / 9 + 2 * e * variance) + 1


def _spread_out(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of the entries of flat segments with these counts."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n) if len(owner) else np.zeros(n)


class _Draws:
    """A batch of hypergeometric distributions: k draws from r1 + r2."""

    def __init__(self, r1, r2, k):
        self.r1, self.r2, self.k, self.n = r1, r2, k, r1 + r2
        self.lo, self.hi = np.maximum(0, k - r2), np.minimum(r1, k)

    def log(self, x, who=slice(None)):
        return log_hypergeometric(x, self.r1[who], self.r2[who], self.k[who])

    def slopes(self, x):
        """First three derivatives of the log probability at x; precise where all cells are large, as wide spreads imply."""
        z = np.stack([x, self.r1 - x, self.k - x, self.r2 - self.k + x]) + 0.5
        sign = np.array([-1.0, 1.0, 1.0, -1.0])[:, None]
        return (sign * np.log(z)).sum(0), -(1 / z).sum(0), -(sign / z**2).sum(0)

    @staticmethod
    def corrected(total, h, slope, bend, twist):
        """Sum over whole numbers from one over every h-th, both in units of the first term; slopes are taken outwards."""
        third = slope**3 + 3 * slope * bend + twist
        return h * total - (h - 1) / 2 + (h * h - 1) / 12 * slope - (h**4 - 1) / 720 * third

    def tail(self, start, way):
        """Probability of start and all beyond it; way is 1 upwards, -1 downwards; 0 where start is outside the support."""
        n = len(start)
        inside = (start >= self.lo) & (start <= self.hi)
        x0 = np.clip(start, self.lo, self.hi)
        slope, bend, twist = self.slopes(x0)
        slope, twist = way * slope, way * twist
        sd = np.sqrt(_variance(self.r1, self.k, self.n))
        steep = np.maximum(np.abs(slope), 1e-300)
        h = np.maximum(1.0, np.floor(np.minimum(sd / GRID, 1 / (8 * steep))))
        far = np.where(slope < 0, np.minimum(_reach(FAINT, sd**2), FAINT / steep + 1), _reach(FAINT, sd**2))
        # Where the support is short all of it is taken.
        room = np.where(way > 0, self.hi - x0, x0 - self.lo)
        far = np.minimum(np.where(sd < GRID, np.maximum(far, np.minimum(room, 256)), far), room)
        owner, place = _spread_out(np.where(inside, np.floor(far / h) + 1, 0).astype(np.int64))
        first = self.log(x0)
        with np.errstate(invalid="ignore"):
            terms = np.exp(self.log(x0[owner] + way * place * h[owner], owner) - first[owner])
            out = np.exp(first) * self.corrected(_sums(terms, owner, n), h, slope, bend, twist)
        return np.where(inside, out, 0.0)

    def rare(self, observed):
        """Probability of all outcomes whose log probability is at most `observed`."""
        mode = np.clip(np.floor((self.r1 + 1) * (self.k + 1) / (self.n + 2)), self.lo, self.hi)
        # The last points below and the first above the mode that are no likelier than what was observed.
        sides = []
        for end, way in ((self.lo, -1), (self.hi, 1)):
            out, in_ = end + way, mode.copy()
            while (np.abs(out - in_) > 1).any():
                mid = np.floor((out + in_) / 2)
                rare = self.log(mid) <= observed
                move = np.abs(out - in_) > 1
                out, in_ = np.where(move & rare, mid, out), np.where(move & ~rare, mid, in_)
            sides.append(out)
        p = self.tail(sides[0], -1) + self.tail(sides[1], 1)
        return np.where(self.log(mode) <= observed, 1.0, np.minimum(1.0, p))


class _Tables2x2(_Draws):
    """A batch of 2 x 2 tables, none of them with a support of one point."""

    def __init__(self, a, b, c, d):
        self.cells = np.stack([np.asarray(v, float) for v in (a, b, c, d)])
        a, b, c, d = self.cells
        self.a = a
        super().__init__(a + b, c + d, a + c)

    def p_value(self):
        return self.rare(self.log(self.a) + SLACK)

    def odds(self):
        """Conditional estimate of the odds ratio and its interval."""
        n, alpha = len(self.a), (1 - CONF) / 2
        spread = 1 / np.sqrt((1 / (self.cells + 0.5)).sum(0))
        variance = _variance(self.r1, self.k, self.n)
        reach = np.floor(60 * np.maximum(spread, np.minimum(np.sqrt(variance), 50))) + 200
        h = np.maximum(1.0, np.floor(spread / GRID))
        up_n, down_n = np.floor(np.minimum(reach, self.hi - self.a) / h), np.floor(np.minimum(reach, self.a - self.lo) / h)
        owner, place = _spread_out((up_n + down_n + 1).astype(np.int64))
        step = (place - down_n[owner]) * h[owner]
        weight = self.log(self.a[owner] + step, owner) - self.log(self.a)[owner]
        slope, bend, twist = self.slopes(self.a)
        starts = np.concatenate([[0], np.cumsum((up_n + down_n + 1).astype(np.int64))[:-1]])
        at = starts + down_n.astype(np.int64)
        above, below = step >= 0, step <= 0

        def tilted(t):
            z = weight + step * t[owner]
            top = np.maximum.reduceat(z, starts)
            z = np.exp(z - top[owner])
            return z, z[at]

        def mean(t):
            z, _ = tilted(t)
            return _sums(z * step, owner, n) / _sums(z, owner, n)

        def side(t, part, way):
            z, one = tilted(t)
            whole = h * _sums(z, owner, n)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                end = self.corrected(0.0, h, way * (slope + t), bend, way * twist)
                end = np.where((h > 1) & (one > 0), end * one, 0.0)
            return (h * _sums(z * part, owner, n) + end) / whole

        def solve(f, target):
            """Roots of increasing functions, one a table: widen, then halve."""
            centre = np.clip(np.log(self.cells[0] + 0.5) + np.log(self.cells[3] + 0.5) - np.log(self.cells[1] + 0.5) - np.log(self.cells[2] + 0.5), -700, 700)
            width = 4 / spread
            left, right = centre - width, centre + width
            for _ in range(60):
                high, low = f(left) > target, f(right) < target
                if not (high | low).any():
                    break
                width = np.where(high | low, 2 * width, width)
                left, right = np.where(high, left - width, left), np.where(low, right + width, right)
            for _ in range(200):
                mid = (left + right) / 2
                if (right - left <= 1e-14 * np.maximum(1.0, np.abs(mid))).all():
                    break
                low = f(mid) < target
                left, right = np.where(low, mid, left), np.where(low, right, mid)
            return (left + right) / 2

        at_lo, at_hi = self.a == self.lo, self.a == self.hi
        with np.errstate(over="ignore"):
            estimate = np.where(at_lo, 0.0, np.where(at_hi, np.inf, np.exp(solve(mean, np.zeros(n)))))
            low = np.where(at_lo, 0.0, np.exp(solve(lambda t: side(t, above, 1), np.full(n, alpha))))
            high = np.where(at_hi, np.inf, np.exp(solve(lambda t: -side(t, below, -1), np.full(n, -alpha))))
        return estimate, low, high


def tests_2x2(a, b, c, d) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(p, odds ratio, lower, upper) of many tables at once; a support of one point gives 1, nan, 0, infinity."""
    a, b, c, d = (np.asarray(v, float) for v in (a, b, c, d))
    p, odds, low, high = np.ones(len(a)), np.full(len(a), np.nan), np.zeros(len(a)), np.full(len(a), np.inf)
    live = np.flatnonzero(np.minimum(a + b, a + c) > np.maximum(0, a - d))
    spread = 1 / np.sqrt(sum(1 / (v[live] + 0.5) for v in (a, b, c, d)))
    cost = np.minimum(2 * (60 * np.maximum(np.minimum(spread, GRID), 50) + 200), (np.minimum(a + b, a + c) - np.maximum(0, a - d))[live] + 1)
    cuts = np.flatnonzero(np.diff(np.cumsum(cost) // ENTRIES)) + 1
    for who in np.split(live, cuts):
        if len(who):
            t = _Tables2x2(a[who], b[who], c[who], d[who])
            p[who] = t.p_value()
            odds[who], low[who], high[who] = t.odds()
    return p, odds, low, high


class Rx2:
    """A batch of r x 2 tables whose partial tables are convolved row by row.

    A state is (table, cells of the first column so far, log weight, multiplicity). A row of the table takes a state to all values
    that the row's first cell can have. A child whose completions are all no likelier than the observed table is counted with
    their whole mass, which is known, and goes no further; children that agree in total and weight are merged. The last two
    rows follow by search in a unimodal distribution.
    """

    def __init__(self, sizes: list[np.ndarray], seen: list[np.ndarray]):
        order = [np.argsort(s, kind="stable") for s in sizes]
        self.sizes = [s[o][s[o] > 0].astype(float) for s, o in zip(sizes, order, strict=True)]
        seen = [v[o][s[o] > 0].astype(float) for s, v, o in zip(sizes, seen, order, strict=True)]
        self.rows = np.array([len(s) for s in self.sizes], np.int64)
        self.n = np.array([s.sum() for s in self.sizes])
        self.k = np.array([v.sum() for v in seen])
        with np.errstate(invalid="ignore"):
            self.q = np.where(self.n > 0, self.k / np.maximum(self.n, 1), 0.0)
        owner = np.repeat(np.arange(len(self.sizes)), self.rows)
        flat = np.concatenate([*self.sizes, np.zeros(0)])
        self.observed = _sums(log_binomial(np.concatenate([*seen, np.zeros(0)]), flat, self.q[owner]), owner, len(self.sizes)) + SLACK
        self.norm = log_binomial(self.k, self.n, self.q)
        self.low = np.zeros(len(self.sizes))

    def _row(self, of, layer):
        """Per table: size of this row, of all rows from it on, number and sum of log sizes of the rows after it."""
        got = [(s[layer], s[layer:].sum(), len(s) - layer - 1, np.log(s[layer + 1 :]).sum()) for s in (self.sizes[t] for t in of)]
        return np.array(got, float).reshape(-1, 4).T

    def start(self) -> tuple[np.ndarray, ...]:
        """The first states; tables of fewer than two rows have one outcome and are done."""
        self.low[self.rows < 2] = 1.0
        t = np.flatnonzero(self.rows >= 2)
        return t, np.zeros(len(t)), np.zeros(len(t)), np.ones(len(t))

    def _chunks(self, counts: np.ndarray) -> Iterator[slice]:
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(counts) // ENTRIES)) + 1).tolist(), len(counts)]
        yield from (slice(i, j) for i, j in zip(cuts, cuts[1:], strict=False) if j > i)

    def expand(self, layer: int, t, total, w, many) -> Iterator[tuple[np.ndarray, ...]]:
        """States after the next row, in chunks; finished mass goes to self.low."""
        of, at = np.unique(t, return_inverse=True)
        m, rest, later, logs = self._row(of, layer)
        m_, rest_ = m[at], rest[at]
        k = self.k[t] - total
        log_mass = w + log_binomial(k, rest_, self.q[t])
        e = np.maximum(log_mass - self.observed[t], 0) + FAINT
        mean, reach = m_ * k / rest_, _reach(e, _variance(m_, k, rest_))
        lo = np.maximum(np.maximum(0, k - (rest_ - m_)), np.floor(mean - reach))
        hi = np.minimum(np.minimum(m_, k), np.ceil(mean + reach))
        # Log weights of the row's cell and of what is left after it, once for each table and value.
        low_x, high_x = (np.full(len(of), v) for v in (np.inf, -np.inf))
        np.minimum.at(low_x, at, lo)
        np.maximum.at(high_x, at, hi)
        low_k, high_k = (np.full(len(of), v) for v in (np.inf, -np.inf))
        np.minimum.at(low_k, at, k - hi)
        np.maximum.at(high_k, at, k - lo)
        own, place = _spread_out((high_x - low_x + 1).astype(np.int64))
        cell, cell_at = log_binomial(low_x[own] + place, m[own], self.q[of][own]), np.cumsum(high_x - low_x + 1) - (high_x - low_x + 1)
        own, place = _spread_out((high_k - low_k + 1).astype(np.int64))
        left, size = low_k[own] + place, (rest - m)[own]
        mass, mass_at = log_binomial(left, size, self.q[of][own]), np.cumsum(high_k - low_k + 1) - (high_k - low_k + 1)
        share = np.where(size > 0, left / np.maximum(size, 1), 0.0)
        # No binomial probability exceeds 1 / sqrt(2 e m q (1 - q)), so no completion exceeds the product of these.
        with np.errstate(divide="ignore", invalid="ignore"):
            most = -0.5 * (later[own] * np.log(2 * math.e * share * (1 - share)) + logs[own])
            most = np.where(share * (1 - share) > 0, np.minimum(0.0, most) - log_binomial(left, size, share), 0.0)
        most = most + mass
        counts = (hi - lo + 1).astype(np.int64)
        for part in self._chunks(counts):
            own, place = _spread_out(counts[part])
            x = lo[part][own] + place
            a = at[part][own]
            w2 = w[part][own] + cell[(cell_at[a] + x - low_x[a]).astype(np.int64)]
            k2 = k[part][own] - x
            j = (mass_at[a] + k2 - low_k[a]).astype(np.int64)
            tables, several = t[part][own], many[part][own]
            done = w2 + most[j] <= self.observed[tables]
            np.add.at(self.low, tables[done], several[done] * np.exp(w2[done] + mass[j[done]] - self.norm[tables[done]]))
            stay = ~done
            yield merged(tables[stay], total[part][own][stay] + x[stay], w2[stay], several[stay])

    def finish(self, t, total, w, many) -> None:
        """States before their last two rows."""
        m1, m2 = (np.array([self.sizes[i][j] for i in t]) for j in (-2, -1)) if len(t) < 1000 else self._last_two(t)
        k = self.k[t] - total
        mass = w + log_binomial(k, m1 + m2, self.q[t])
        limit = self.observed[t] - mass
        scale = many * np.exp(mass - self.norm[t])
        share = np.ones(len(t))
        open_ = np.flatnonzero(limit < 0)
        keys = np.stack([m1[open_], m2[open_], k[open_]], 1)
        order = np.lexsort(keys.T)
        keys, open_ = keys[order], open_[order]
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(keys, axis=0) != 0).any(1)])) if len(keys) else np.zeros(0, np.int64)
        group = np.diff(np.append(begins, len(keys)))
        # Many states of the same two rows share one list of all outcomes; few states of a wide spread sum their tails.
        wide = np.sqrt(_variance(keys[begins, 0], keys[begins, 2], keys[begins, 0] + keys[begins, 1]))
        listed = wide < np.maximum(GRID, 40 * group)
        for i, size in zip(begins[listed], group[listed], strict=True):
            who = open_[i : i + size]
            share[who] = rare_share(*keys[i], limit[who])
        few = np.flatnonzero(np.repeat(~listed, group))
        for part in np.array_split(few, -(-len(few) // 1024) or 1):
            if len(part):
                share[open_[part]] = _Draws(*keys[part].T).rare(limit[open_[part]])
        np.add.at(self.low, t, scale * share)

    def _last_two(self, t):
        of, at = np.unique(t, return_inverse=True)
        return np.array([self.sizes[i][-2] for i in of])[at], np.array([self.sizes[i][-1] for i in of])[at]


def merged(t, total, w, many) -> tuple[np.ndarray, ...]:
    """States with equal table, total and weight as one."""
    if len(t) < 2:
        return t, total, w, many
    order = np.lexsort((w, total, t))
    t, total, w, many = t[order], total[order], w[order], many[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (total[1:] != total[:-1]) | (w[1:] - w[:-1] > 1e-11 * np.maximum(1.0, np.abs(w[1:])))])
    first = np.flatnonzero(new)
    return t[first], total[first], w[first], np.add.reduceat(many, first)


def rare_share(m1: float, m2: float, k: float, limits: np.ndarray) -> np.ndarray:
    """Probability of the outcomes of k draws from m1 + m2 whose log probability is at most a limit, for several limits."""
    n = m1 + m2
    mode = min(max(math.floor((m1 + 1) * (k + 1) / (n + 2)), max(0.0, k - m2)), min(m1, k))
    top = float(log_hypergeometric(mode, m1, m2, k))
    reach = float(_reach(np.asarray(FAINT - limits.min()), _variance(np.asarray(m1), np.asarray(k), np.asarray(n)))) + 1
    out = np.zeros(len(limits))
    everything = limits >= top
    for end, way in ((max(0.0, k - m2, mode - reach), -1), (min(m1, k, mode + reach), 1)):
        x = mode + way * np.arange(int(abs(end - mode)))
        if way > 0:
            ratio = (m1 - x) * (k - x) / ((x + 1) * (m2 - k + x + 1))
        else:
            ratio = x * (m2 - k + x) / ((m1 - x + 1) * (k - x + 1))
        logs = top + np.cumsum(np.log(ratio))
        tails = np.concatenate([np.cumsum(np.exp(logs)[::-1])[::-1], [0.0]])
        # logs fall, so the first that is small enough starts the tail.
        out += tails[np.searchsorted(-np.minimum.accumulate(logs), -limits, "left")] if len(logs) else 0.0
    return np.where(everything, 1.0, out)
