"""Quantities: closed intervals with a unit, parsed from cells of limit tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number and range patterns, unit tokens.
NUMBER = r"(-?\d+(?:\.\d+)?)"
RANGE = rf"(?i)^\s*{NUMBER}\s*(?:to|through|\.\.\.|–|—|/)\s*{NUMBER}\s*$"
SCALAR = rf"^\s*{NUMBER}\s*$"
PRESSURE_UNITS = ("psig", "psia", "psi", "barg", "bar")
TOLERANCE = 1e-6


def parse_quantity(text: Column, unit: Column) -> Column:
    """struct(min, max, unit, raw) of one number or a range of two; null if it is neither."""
    lo, hi = (F.regexp_extract(text, RANGE, n).try_cast("double") for n in (1, 2))
    one = F.regexp_extract(text, SCALAR, 1).try_cast("double")
    build = lambda a, b: F.struct(F.least(a, b).alias("min"), F.greatest(a, b).alias("max"), unit.alias("unit"), F.trim(text).alias("raw"))
    return F.when(text.rlike(RANGE), build(lo, hi)).when(text.rlike(SCALAR), build(one, one))


def unit_from_header(header: Column) -> Column:
    """struct(field, unit) of a column header, by whole words; null if it names no known unit."""
    t = F.replace(F.lower(header), F.lit("°"), F.lit(" deg "))
    tokens = F.regexp_extract_all(t, F.lit("([a-z]+)"), F.lit(1))
    has = lambda w: F.array_contains(tokens, w)
    out = None
    make = lambda f, u: F.struct(F.lit(f).alias("field"), F.lit(u).alias("unit"))
    for u in PRESSURE_UNITS:
        out = F.when(has(u), make("pressure", u)) if out is None else out.when(has(u), make("pressure", u))
    hot = t.contains("temp")
    return out.when(hot & (has("c") | has("degc")), make("temperature", "degC")).when(hot, make("temperature", "degF"))


def matches(a_min, a_max, a_unit, b_min, b_max, b_unit) -> Column:
    return (a_unit == b_unit) & (F.abs(a_min - b_min) <= TOLERANCE) & (F.abs(a_max - b_max) <= TOLERANCE)
