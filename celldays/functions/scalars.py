"""Scalar expressions of weather, terrain and spectra. A missing input gives null; nothing raises under ANSI rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_half_even(x: Column, size: float = 0.1) -> Column:
    """Centre of the bin of a coordinate, halves to even."""
    return F.rint(x / size) * size


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def clipped(x: Column, low: float | None = None, high: float | None = None) -> Column:
    y = F.greatest(x, F.lit(low)) if low is not None else x
    return F.when(x.isNotNull(), F.least(y, F.lit(high)) if high is not None else y)


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def wind_from(u: Column, v: Column) -> Column:
    """Direction the wind comes from, degrees clockwise from north."""
    # calm air has the direction that a negative zero gives elsewhere
    return F.when((u == 0) & (v == 0), 180.0).otherwise(F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0)))


def ndvi(red: Column, nir: Column) -> Column:
    return F.try_divide(nir - red, nir + red)


def evi(red: Column, nir: Column, blue: Column) -> Column:
    return F.try_divide(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1)


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """(north-south, east-west) metres of one degree at a latitude."""
    return F.lit(111320.0), F.lit(111320.0) * F.cos(F.radians(lat))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def lookup(code: Column, table: dict, default) -> Column:
    """Small fixed table as a map literal, with a default for unknown and null codes."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), code), F.lit(default))


def number(text: Column) -> Column:
    """DOUBLE of a text that is one, finite; else null."""
    v = text.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def month_number(name: Column) -> Column:
    """1 to 12 of an English month name, its three-letter form or digits; null for all else."""
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    digits = F.when(name.rlike(r"^0?[1-9]$|^1[0-2]$"), name.try_cast("int"))
    return F.coalesce(digits, F.nullif(F.array_position(F.array(*map(F.lit, names)), F.lower(F.substring(F.trim(name), 1, 3))), F.lit(0)).cast("int"))
