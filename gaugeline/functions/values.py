"""Strict decimal float parsing (what a 64-bit float parser accepts, finite only)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gaugeline.functions.text import _c

# Fixed value: accepted number syntax (sign, digits with optional fraction or
# a bare fraction, optional exponent).  No surrounding space, no type suffix,
# no NaN/Inf words, no hex floats.
FLOAT_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def is_strict_float(text) -> Column:
    """True when the text is a decimal number whose double value is finite."""
    t = _c(text)
    v = t.try_cast("double")
    ok = t.rlike(FLOAT_PATTERN) & v.isNotNull() & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce(ok, F.lit(False))
