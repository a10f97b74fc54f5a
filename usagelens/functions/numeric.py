"""Arithmetic that keeps unknown values unknown (ANSI mode would raise on a zero denominator)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """`numerator / denominator`; null when the denominator is zero or either side is null."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def pct(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """A share in percent, null without a denominator."""
    return ratio(numerator, denominator) * 100


def pct_or_zero(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """A share in percent, zero without a denominator (chart series)."""
    return F.coalesce(pct(numerator, denominator), F.lit(0.0))


def pct_change(before: ColumnOrName, after: ColumnOrName) -> Column:
    """Percent change relative to `abs(before)`.

    Null when either side is null; from zero it is 0 when nothing changed and null otherwise.
    """
    before, after = col(before).cast("double"), col(after).cast("double")
    return F.when(before == 0, F.when(after == 0, F.lit(0.0))).otherwise(
        F.try_divide(after - before, F.abs(before)) * 100
    )


def rounded(c: ColumnOrName, digits: int = 6) -> Column:
    """Round for display or comparison; adding 0.0 turns a negative zero into zero."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)
