"""Missing-value rules as column expressions.

Missing answers are SQL NULL. Comparisons stay NULL when an operand is NULL, so
an indicator of an unknown answer is unknown rather than 0.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ind(cond: Column) -> Column:
    """1 / 0 / NULL from a three-valued condition."""
    return cond.cast("int")


def complement(flag: Column | str) -> Column:
    return F.lit(1) - _col(flag)


def both(a: Column | str, b: Column | str) -> Column:
    """1 when both flags are 1; a 0 on either side wins over NULL."""
    return ind((_col(a) == 1) & (_col(b) == 1))


def either(a: Column | str, b: Column | str) -> Column:
    """1 when one of the flags is 1; a 1 on either side wins over NULL."""
    return ind((_col(a) == 1) | (_col(b) == 1))


def any_true(cond: Column, na_rm: bool = False) -> Column:
    """Aggregate: a TRUE wins, otherwise NULL if something was unknown."""
    if na_rm:
        return F.coalesce(F.bool_or(cond), F.lit(False))
    return F.when(F.bool_or(cond), F.lit(True)).when(
        F.count(F.lit(1)) == F.count(cond), F.lit(False)
    )


def all_true(cond: Column, na_rm: bool = False) -> Column:
    """Aggregate: a FALSE wins, otherwise NULL if something was unknown."""
    if na_rm:
        return F.coalesce(F.bool_and(cond), F.lit(True))
    return F.when(F.count_if(~cond) > 0, F.lit(False)).when(
        F.count(F.lit(1)) == F.count(cond), F.lit(True)
    )


def _strict(agg: Column, x: Column, na_rm: bool) -> Column:
    return agg if na_rm else F.when(F.count(F.lit(1)) == F.count(x), agg)


def sum_na(x: Column, na_rm: bool = False) -> Column:
    """Sum that is NULL when any input is NULL, unless ``na_rm``."""
    total = F.sum(x)
    return F.coalesce(total, F.lit(0)) if na_rm else _strict(total, x, False)


def mean_na(x: Column, na_rm: bool = False) -> Column:
    return _strict(F.avg(x), x, na_rm)


def share_true(cond: Column, na_rm: bool = False) -> Column:
    """Mean of a condition."""
    return mean_na(ind(cond), na_rm)


def in_set(c: Column | str, values: Iterable) -> Column:
    """Membership that is never NULL."""
    return F.coalesce(_col(c).isin(*list(values)), F.lit(False))


def not_in_set(c: Column | str, values: Iterable) -> Column:
    return ~in_set(c, values)


def safe_double(c: Column | str) -> Column:
    """Number from dirty text; anything that is not a number becomes NULL."""
    text = _col(c).cast("string")
    return F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))


def safe_int(c: Column | str) -> Column:
    """Integer from dirty text, truncating decimals towards zero."""
    return safe_double(c).try_cast("int")


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))
