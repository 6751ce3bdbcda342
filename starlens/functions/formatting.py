"""Rounding and number formatting used by every published table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starlens.functions import fixed_values as fv


def rounded(value: Column, places: int = 4) -> Column:
    """Half-up rounding that does not depend on the order a double sum was added in.

    The inner round removes the last-digit noise of a distributed sum, so a mean that lies
    on a rounding tie falls the same way in every run.
    """
    return F.round(F.round(value, 10), places)


def mean(value: Column, places: int = 4) -> Column:
    return rounded(F.avg(value), places)


def fixed(value: Column, places: int) -> Column:
    """``value`` with a fixed number of decimals."""
    return F.format_string(f"%.{places}f", F.round(value.cast("double"), places))


def thousands(value: Column) -> Column:
    """1234567 -> 1,234,567"""
    return F.format_number(value, 0)


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """``part`` of ``whole``; null of nothing."""
    return rounded(F.try_divide(F.lit(100.0) * part, whole), places)


def product_label(app: Column) -> Column:
    return F.replace(app, F.lit("_"), F.lit(" "))


def star_glyphs(avg_star: Column) -> Column:
    """Five glyphs; the mean is rounded half to even."""
    full = F.bround(avg_star, 0).cast("int")
    return F.concat(F.repeat(F.lit("★"), full), F.repeat(F.lit("☆"), F.lit(5) - full))


def sentiment_band(avg_sentiment: Column) -> Column:
    return F.when(avg_sentiment > fv.SENTIMENT_BAND, "pos").otherwise("neg")
