"""Rounding, sentinels and strict numeric parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_AT_OR_BELOW = -900.0


def half_up(col: Column, digits: int = 0) -> Column:
    """Round halves towards +infinity (the browser rule): ``floor(x + 0.5)``."""
    scale = F.lit(float(10**digits))
    return F.floor(col * scale + F.lit(0.5)) / scale


# 2^27 + 1 cuts a double into two halves whose products are exact.
_CUT = 134_217_729.0


def half_even(col: Column, digits: int = 0) -> Column:
    """Round the exact binary value, exact halves to even (the Python rule).

    ``bround`` rounds the shortest decimal text instead and differs next to a half, so the rounding error
    of ``value * 10^digits`` is recovered exactly and decides on which side of the half the value lies.
    """
    value, scale = col.cast("double"), float(10**digits)
    scale_high = scale * _CUT - (scale * _CUT - scale)
    scale_low = scale - scale_high
    high = value * _CUT - (value * _CUT - value)
    low = value - high
    product = value * scale
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    whole = F.floor(product)
    above = (product - whole - 0.5) + error
    up = (above > 0) | ((above == 0) & (F.pmod(whole, F.lit(2)) == 1))
    return (whole + F.when(up, 1).otherwise(0)) / F.lit(scale)


def finite(col: Column) -> Column:
    """Null instead of NaN or an infinite value."""
    value = col.cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def sentinel_to_null(col: Column, fill: Column | float | None = None, floor: float = MISSING_AT_OR_BELOW) -> Column:
    """Provider sentinels (at or below ``floor``, the advertised fill value, blank, non-finite) become null."""
    if isinstance(fill, (int, float)):
        fill = F.lit(float(fill))
    value = finite(F.expr("null").cast("double") if col is None else col.try_cast("double"))
    keep = value > F.lit(float(floor))
    if fill is not None:
        keep = keep & F.coalesce(value != fill.cast("double"), F.lit(True))
    return F.when(keep, value)


def negative_to_null(col: Column) -> Column:
    """Negative readings are missing evidence; zero is a real reading."""
    return F.when(col >= 0, col)


def is_blank(col: Column) -> Column:
    return col.isNull() | (F.trim(col.cast("string")) == "")


def strict_number(col: Column) -> Column:
    """Numeric value of a text column; blanks are null, see ``strict_number_fault`` for the refusals."""
    return F.when(~is_blank(col), F.trim(col.cast("string")).try_cast("double"))


def strict_number_fault(col: Column, integer: bool = False) -> Column:
    """True for a non-blank text that is no number, or no integer where one is required."""
    return number_fault(col, strict_number(col), integer)


def number_fault(col: Column, number: Column, integer: bool = False) -> Column:
    """``strict_number_fault`` of a text whose ``strict_number`` is at hand."""
    fault = number.isNull() & ~is_blank(col)
    if integer:
        fault = fault | F.coalesce(F.pmod(number, F.lit(1.0)) != 0, F.lit(False))
    return fault


def downcast(df, doubles: list[str], bools: list[str] = ()):  # type: ignore[no-untyped-def]
    """Model-input copies of columns: doubles as float32, booleans as tinyint."""
    return df.withColumns(
        {**{c: F.col(c).cast("float") for c in doubles}, **{c: F.col(c).cast("tinyint") for c in bools}}
    )
