"""Days, summers and cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_floor_seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp's day, in UTC."""
    return (F.floor(F.unix_seconds(ts.cast("timestamp")) / 86400) * 86400).cast("bigint")


def cyclic(day: Column, period: float = 365.0) -> tuple[Column, Column]:
    a = 2 * math.pi * F.dayofyear(day) / period
    return F.sin(a), F.cos(a)


def is_summer(day: Column, first: int = 6, last: int = 9) -> Column:
    return F.month(day).between(first, last)
