"""Scalar column expressions. Built-in functions only, so they stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86400
HOUR_S = 3600


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_numeric(c) -> Column:
    """Text to double; unparsable text becomes null (ANSI-safe ``try_cast``)."""
    return _c(c).try_cast("double")


def to_long(c) -> Column:
    return _c(c).try_cast("bigint")


def is_all_digits(c) -> Column:
    """True for non-empty ASCII digit text (drops ``>NNN``, negatives, decimals, blanks)."""
    return _c(c).rlike("^[0-9]+$")


def hms_to_seconds(c) -> Column:
    """``HH:MM:SS`` text to seconds since midnight; other shapes give null."""
    c = _c(c)
    ok = c.rlike("^[0-9]+:[0-9]+:[0-9]+$")
    h = F.split_part(c, F.lit(":"), F.lit(1)).try_cast("bigint")
    m = F.split_part(c, F.lit(":"), F.lit(2)).try_cast("bigint")
    s = F.split_part(c, F.lit(":"), F.lit(3)).try_cast("bigint")
    return F.when(ok, h * HOUR_S + m * 60 + s)


def days_to_seconds(c) -> Column:
    return _c(c).cast("bigint") * DAY_S


def first_token(c, sep: str) -> Column:
    """Text before the first ``sep`` (whole text when absent)."""
    return F.split_part(_c(c), F.lit(sep), F.lit(1))


def hours(c="time_s") -> Column:
    return _c(c) / float(HOUR_S)


def days(c="time_s") -> Column:
    return _c(c) / float(DAY_S)


def round_half_even(c, scale: int = 0) -> Column:
    """pandas / numpy rounding (banker's)."""
    return F.bround(_c(c), scale)


def o2_content(sat, hgb, po2) -> Column:
    """Blood oxygen content (mL/dL) from saturation (%), haemoglobin (g/dL) and PO2 (mmHg)."""
    # Haemoglobin binding 1.34 mL/g, dissolved O2 0.003 mL/dL/mmHg.
    return F.lit(1.34) * _c(sat) / 100.0 * _c(hgb) + F.lit(0.003) * _c(po2)


def safe_div(a, b) -> Column:
    """Division that yields null on a zero or null divisor (pandas gives inf; ANSI raises)."""
    return F.try_divide(_c(a), _c(b))
