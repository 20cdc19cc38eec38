"""One set of equations, two evaluators: Spark columns (code generation) and NumPy arrays (state scans in Arrow batches)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class SparkMath:
    """Null is missing. A quotient by zero and a logarithm out of its domain are null, so no branch can raise."""

    exp, sqrt, sin, cos, absolute = staticmethod(F.exp), staticmethod(F.sqrt), staticmethod(F.sin), staticmethod(F.cos), staticmethod(F.abs)
    radians, degrees, acos, rint = staticmethod(F.radians), staticmethod(F.degrees), staticmethod(F.acos), staticmethod(F.rint)

    @staticmethod
    def num(x) -> Column:
        return x.cast("double") if isinstance(x, Column) else F.lit(x).cast("double")

    @staticmethod
    def where(c, a, b) -> Column:
        return F.when(c, a).otherwise(b)

    @staticmethod
    def log(x) -> Column:
        return F.ln(x)

    @staticmethod
    def power(x, y) -> Column:
        return F.pow(x, F.lit(y) if not isinstance(y, Column) else y)

    @staticmethod
    def div(a, b) -> Column:
        return F.try_divide(SparkMath.num(a), SparkMath.num(b))

    @staticmethod
    def clip(x, low=None, high=None) -> Column:
        y = x if low is None else F.greatest(x, F.lit(float(low)))
        y = y if high is None else F.least(y, SparkMath.num(high))
        return F.when(x.isNotNull(), y)  # greatest and least skip nulls

    @staticmethod
    def guard(value, *inputs) -> Column:
        """Null as soon as any input is."""
        ok = F.lit(True)
        for x in inputs:
            ok = ok & SparkMath.num(x).isNotNull()
        return F.when(ok, value)

    @staticmethod
    def pick(table: list, place) -> Column:
        return F.element_at(F.array(*(F.lit(float(x)) for x in table)), place.cast("int"))


class NumpyMath:
    """NaN is missing."""

    exp, sqrt, sin, cos, absolute, power = np.exp, np.sqrt, np.sin, np.cos, np.abs, np.power
    radians, degrees, acos, rint, log, where = np.radians, np.degrees, np.arccos, np.rint, np.log, np.where
    div = staticmethod(np.divide)

    @staticmethod
    def clip(x, low=None, high=None):
        return np.clip(x, low, high)

    @staticmethod
    def num(x):
        return np.asarray(x, dtype=np.float64)

    @staticmethod
    def guard(value, *inputs):
        bad = np.zeros(np.shape(value), bool)
        for x in inputs:
            bad = bad | np.isnan(NumpyMath.num(x))
        return np.where(bad, np.nan, value)

    @staticmethod
    def pick(table: list, place):
        return np.take(np.asarray(table, dtype=np.float64), np.asarray(place, dtype=int) - 1)
