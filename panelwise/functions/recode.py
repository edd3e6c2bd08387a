"""Recoding and categorisation expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from itertools import chain, pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwise.functions.nulls import _col, in_set


def lookup(c: Column | str, mapping: Mapping, default: Column | None = None) -> Column:
    """Value map from a small literal dictionary; unknown codes give ``default`` (NULL)."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    found = F.try_element_at(table, _col(c))
    return found if default is None else F.coalesce(found, default)


def leading_digit_label(c: Column | str, names: Mapping[str, str]) -> Column:
    """Label from the first character of an id; unmapped digits stay as they are."""
    digit = F.substring(_col(c).cast("string"), 1, 1)
    return lookup(digit, names, default=digit)


def _edges(x: Column, lo: float, hi: float) -> Column:
    cond = F.lit(True)
    if lo != -math.inf:
        cond = cond & (x > F.lit(lo))
    if hi != math.inf:
        cond = cond & (x <= F.lit(hi))
    return cond & x.isNotNull() & ~F.isnan(x)


def cut(c: Column | str, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(lo, hi]``; values outside every bin are NULL."""
    x = _col(c).cast("double")
    out = F.when(F.lit(False), F.lit(labels[0]))
    for (lo, hi), label in zip(pairwise(breaks), labels, strict=True):
        out = out.when(_edges(x, lo, hi), F.lit(label))
    return out


def ordinal(c: Column | str, levels: Sequence) -> Column:
    """1-based position in the level list; values outside it are NULL."""
    return lookup(c, {v: i for i, v in enumerate(levels, 1)})


def within_levels(c: Column | str, levels: Sequence) -> Column:
    """Keep values of the level list, blank out the others."""
    return F.when(in_set(c, levels), _col(c))


def code_labels(c: Column | str, codes: Mapping) -> Column:
    """Label of a code. Codes may arrive as text, so both sides compare as text."""
    text = _col(c).cast("string")
    text = F.regexp_replace(text, r"\.0+$", "")
    return lookup(text, {str(k): v for k, v in codes.items()})


def override(x: Column | str, cond: Column, value) -> Column:
    """Replace where the condition is TRUE; an unknown condition changes nothing."""
    return F.when(cond, F.lit(value)).otherwise(_col(x))


def default_missing(x: Column | str, value) -> Column:
    return F.coalesce(_col(x), F.lit(value))


def blank_out(x: Column | str, sentinels: Iterable) -> Column:
    """Sentinel answers become NULL."""
    return F.when(~in_set(x, sentinels), _col(x))


def replace_any(x: Column | str, wrong: Iterable, right) -> Column:
    """Several spellings to one value."""
    return F.when(in_set(x, wrong), F.lit(right)).otherwise(_col(x))


def recode(x: Column | str, mapping: Mapping) -> Column:
    """Rename listed values and keep the others."""
    return lookup(x, mapping, default=_col(x))


def gate_zero(flag: Column | str, gate_closed: Column) -> Column:
    """0 when the gate question says no; a missing gate answer leaves the flag."""
    return override(flag, gate_closed, 0)
