"""Small dense algebra on p x p matrices that Spark has already summed."""

from __future__ import annotations

import numpy as np


def pairs(p: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(p) for b in range(a, p)]


def symmetric(flat: dict[tuple[int, int], float], p: int) -> np.ndarray:
    m = np.zeros((p, p))
    for (a, b), v in flat.items():
        m[a, b] = m[b, a] = v
    return m


def free_columns(gram: np.ndarray, candidates: list[int], tol: float = 1e-9) -> list[int]:
    """Candidate columns that are not combinations of earlier ones."""
    kept: list[int] = []
    for j in candidates:
        if gram[j, j] <= 0:
            continue
        if kept:
            g = gram[np.ix_(kept, kept)]
            c = gram[kept, j]
            rest = gram[j, j] - c @ np.linalg.solve(g, c)
            if rest <= tol * gram[j, j]:
                continue
        kept.append(j)
    return kept
