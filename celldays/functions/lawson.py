"""Diurnal fine fuel moisture code: bilinear interpolation in tables of the noon code by time of day and humidity class.

The published tables are a parameter, which has no default: a Tables value or what read_tables() finds in a file. Before noon (6:00 to 11:59) the humidity class chooses the
table; else one main table holds. Humidity is rounded half to even and cut to 1..100, the code to the table's range. A
null code, humidity or time gives null.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tables:
    """axis: noon codes in ascending order; main, low, medium, high: rows of values by hour; limits: hour to (low, high) humidity."""

    axis: list[float]
    main: dict[int, list[float]]
    low: dict[int, list[float]]
    medium: dict[int, list[float]]
    high: dict[int, list[float]]
    limits: dict[int, tuple[int, int]]


def read_tables(path: str) -> Tables:
    """Tables from a JSON file of the caller's: axis, main, low, medium, high (hour to row) and limits (hour to two humidities)."""
    with open(path, encoding="utf-8") as f:
        x = json.load(f)
    hours = lambda t: {int(h): v for h, v in t.items()}
    return Tables([float(v) for v in x["axis"]], *(hours(x[k]) for k in ("main", "low", "medium", "high")), {h: tuple(v) for h, v in hours(x["limits"]).items()})


def _interpolated(table: dict[int, list[float]], axis: list[float], hour: Column, minute: Column, code: Column) -> Column:
    """Bilinear value between the table's rows of this and the next hour and the axis points around the code."""
    line = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    held = F.create_map(*(x for h, v in table.items() for x in (F.lit(h), line(v))))
    xs = line(axis)
    i = F.least(F.greatest(F.size(F.filter(xs, lambda x: x <= code)), F.lit(1)), F.lit(len(axis) - 1))
    part = (code - F.element_at(xs, i)) / (F.element_at(xs, i + 1) - F.element_at(xs, i))

    def at(h: Column) -> Column:
        row = F.try_element_at(held, h)
        a, b = F.try_element_at(row, i), F.try_element_at(row, i + 1)
        return a + (b - a) * part

    after = F.when(hour == 24, 1).otherwise(hour + 1)
    now, then = at(hour), at(after)
    return now + (F.coalesce(then, now) - now) * minute / 60.0


def diurnal_ffmc(df: DataFrame, tables: Tables, name: str = "diurnal_ffmc") -> DataFrame:
    """df (ffmc, rh, hour, minute) with the code at that time of day."""
    t = tables
    code = F.when(F.col("ffmc").isNotNull(), F.least(F.greatest(F.col("ffmc").cast("double"), F.lit(t.axis[0])), F.lit(t.axis[-1])))
    rh = F.when(F.col("rh").isNotNull(), F.least(F.greatest(F.rint(F.col("rh").cast("double")), F.lit(1.0)), F.lit(100.0)))
    hour = F.when(F.col("hour") == 0, 24).otherwise(F.col("hour")).cast("int")
    limit = lambda k: F.try_element_at(F.create_map(*(F.lit(x) for h, v in t.limits.items() for x in (h, v[k]))), hour)
    value = {n: _interpolated(getattr(t, n), t.axis, hour, F.col("minute"), code) for n in ("main", "low", "medium", "high")}
    before_noon = F.when(rh > limit(1), value["high"]).when(rh < limit(0), value["low"]).otherwise(value["medium"])
    return df.withColumn(name, F.when(rh.isNotNull(), F.when(F.col("hour").between(6, 11), before_noon).otherwise(value["main"])))
