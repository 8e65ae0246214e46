"""Rounding as numerical libraries do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(c: Column, places: int) -> Column:
    """Scaled, rounded to the nearest integer with ties to even, and scaled back, all in binary."""
    return F.rint(c * float(10**places)) / float(10**places)


def round_away(c: Column, places: int) -> Column:
    """Scaled, rounded to the nearest integer with ties away from zero, and scaled back, all in binary; for many rows, as Spark's own rounding makes a decimal number of each value. Never a negative zero."""
    v = c * float(10**places)
    r = F.rint(v)
    return F.when((v - r) * F.signum(v) == 0.5, r + F.signum(v)).otherwise(r) / float(10**places) + 0.0


def round_scaled(c: Column, places: int) -> Column:
    """As :func:`round_away`, with one copy of ``c``, for a long expression."""
    return F.round(c * float(10**places), 0) / float(10**places)
