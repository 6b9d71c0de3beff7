"""Casts that give NULL for bad input, and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL_TEXT = r"^\s*[+-]?[0-9]*\.[0-9]*\s*$"


def to_int(value: Column) -> Column:
    """Whole number, the fraction cut off; NULL where the text is no number.

    ``try_cast`` alone refuses texts such as ``3.0``, so these go through a decimal.
    """
    text = value.cast("string")
    return F.coalesce(
        value.try_cast("int"),
        F.when(text.rlike(_DECIMAL_TEXT), text.try_cast("decimal(38,9)").try_cast("int")),
    )


def to_double(value: Column) -> Column:
    return value.try_cast("double")


def _exact(value: Column) -> Column:
    """A double as a decimal with six places where that is the same number; else NULL."""
    exact = value.try_cast("decimal(24,6)")
    return F.when(exact.cast("double") == value, exact)


def money_sums(value: Column, name: str) -> list[Column]:
    """Aggregates ``name`` and ``name_rest`` that :func:`money` adds up.

    A sum of doubles depends on the order of addition, which differs from run to run; on
    large data the cents are lost.  A sum of decimals is exact and always the same.  Values
    that are no such decimal (NaN, infinity, beyond 18 digits, more than six places) are
    summed as doubles beside it, so that none is left out.
    """
    number = to_double(value)
    exact = _exact(number)
    return [
        F.sum(exact).alias(name),
        F.sum(F.when(exact.isNull(), number)).alias(f"{name}_rest"),
    ]


def money(name: str) -> Column:
    """The whole sum as a double; NULL where there was no value at all."""
    exact, rest = F.col(name).cast("double"), F.col(f"{name}_rest")
    return F.when(rest.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + rest)


def nonzero(value: Column) -> Column:
    return F.nullif(value, F.lit(0))


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, NULL for a whole of 0."""
    return part.cast("double") / nonzero(whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` as a double, unrounded, NULL for a whole of 0."""
    return part.cast("double") * F.lit(100.0) / nonzero(whole.cast("double"))


def two_places(value: Column) -> Column:
    return F.round(value, 2)
