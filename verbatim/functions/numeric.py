"""Numeric expressions with the null and rounding rules of statistical software."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(x: Column | str, digits: int = 0) -> Column:
    return F.bround(_col(x), digits)


def strict_mean(x: Column | str) -> Column:
    """Mean that is null as soon as one value of the group is null."""
    x = _col(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b``; null when ``b`` is 0."""
    return _col(a).cast("double") / F.nullif(_col(b).cast("double"), F.lit(0.0))


def sign_label(a: Column | str, b: Column | str) -> Column:
    """'positive' when a > b, else 'negative'; null when either side is null."""
    above = _col(a) > _col(b)
    return F.when(above, "positive").when(~above, "negative")


def bin_centre(x: Column | str, width: float) -> Column:
    """Centre of the right-closed bin of ``width`` around a multiple of ``width``."""
    return (F.ceil((_col(x) - F.lit(width / 2.0)) / F.lit(float(width))) * F.lit(float(width))).cast("double")


def bin_index(x: Column | str, low: Column, width: Column) -> Column:
    """Index of the right-closed bin centred on ``low + index * width``; 0 if ``width`` is 0."""
    return F.when(width > 0, F.ceil((_col(x) - low) / width - F.lit(0.5))).otherwise(F.lit(0)).cast("long")
