"""How raw fields are read: one place for the spelling rules that every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = ["aoi_id", "target_date", "row", "col"]


def split_of(c: Column | str) -> Column:
    """train, val or test by the first two letters, spaces, tabs and case aside; null for everything else."""
    two = F.substring(F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[ \t]+", "")), 1, 2)
    return F.when(two == "tr", F.lit("train")).when(two == "va", F.lit("val")).when(two == "te", F.lit("test"))


def alnum_upper(c: Column | str) -> Column:
    """Upper case, A-Z and 0-9 only; null when nothing is left."""
    col = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.upper(col), "[^A-Z0-9]", ""), F.lit(""))


def source_of(c: Column | str) -> Column:
    """Source name without outer spaces, lower case; null when blank."""
    col = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.trim(col)), F.lit(""))


def label_fits(type_class: Column, label: Column) -> Column:
    """1 belongs to FIRE... classes and 0 to NOFIRE... classes."""
    want = F.when(type_class.startswith("FIRE"), F.lit(1)).when(type_class.startswith("NOFIRE"), F.lit(0))
    return F.coalesce(label == want, F.lit(False))


def missing(c: Column | str) -> Column:
    """Null or NaN; infinities are values, though never in range."""
    col = F.col(c) if isinstance(c, str) else c
    return col.isNull() | F.isnan(col)


def in_range(v: Column, low: Column, high: Column) -> Column:
    """Finite and within both limits, compared as DOUBLE; never null."""
    d = v.cast("double")
    ok = ~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))) & (d >= low) & (d <= high)
    return F.coalesce(ok, F.lit(False))
