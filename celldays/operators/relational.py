"""Joins, set operations, filters and checks on keyed tables that jobs share. Null keys never match in joins; in set operations they are equal."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def surrogate_cells(cells: DataFrame, width: int) -> DataFrame:
    """(row, col, cell): a number per distinct cell, computed from its place, so it is the same in every run. Columns must be below ``width``."""
    return cells.select("row", "col").distinct().withColumn("cell", F.col("row") * width + F.col("col"))


def full_outer(parts: list[DataFrame], on: list[str]) -> DataFrame:
    """Tables side by side, every key of any of them kept."""
    return reduce(lambda a, b: a.join(b, on, "full"), parts)


def on_rounded(left: DataFrame, right: DataFrame, places: int, keep: str, x: str = "x", y: str = "y") -> DataFrame:
    """Left rows with the least ``keep`` of the right rows of the same coordinates, both rounded half to even; null where there is none."""
    key = [F.bround(x, places).alias("_rx"), F.bround(y, places).alias("_ry")]
    r = right.groupBy(*key).agg(F.min(keep).alias(keep))
    return left.select("*", *key).join(r, ["_rx", "_ry"], "left").drop("_rx", "_ry")


def validated_left(left: DataFrame, right: DataFrame, on: list[str], suffix: str = "_right", check: bool = True) -> DataFrame:
    """Left join of one to one; clashing columns of the right get a suffix. With ``check`` a key that the right table repeats is an error."""
    if check and not right.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"the right table repeats keys of {on}")
    names = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(names), on, "left")


def with_and_without(df: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is among ``keys`` and rows whose key is not; a null key part is never among them."""
    k = keys.select(*on).distinct()
    return df.join(k, on, "left_semi"), df.join(k, on, "left_anti")


def united(parts: list[DataFrame], columns: list[str], distinct: bool = False) -> DataFrame:
    """Rows of all parts by name, repeated ones once with ``distinct``."""
    u = reduce(lambda a, b: a.unionByName(b), (p.select(*columns) for p in parts))
    return u.distinct() if distinct else u


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside (x_min, y_min, x_max, y_max), edges included."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def with_prehistory(day: Column, first: date, last: date, days: int = 0) -> Column:
    """From ``days`` before the first day to the last, both included."""
    return day.between(F.date_sub(F.lit(first), days), F.lit(last))


def complete_groups(df: DataFrame, keys: list[Column], kind: str, least: int, name: str = "kinds") -> DataFrame:
    """Groups with at least ``least`` different kinds, and how many."""
    return df.groupBy(*keys).agg(F.count_distinct(kind).alias(name)).where(F.col(name) >= least)


def from_first_valid(df: DataFrame, keys: list[str], order: str, valid: Column) -> DataFrame:
    """Rows of each entity from its first valid one on; an entity without one has none. The first is an aggregate, so no entity is sorted."""
    first = df.where(valid).groupBy(*keys).agg(F.min(order).alias("_first"))
    return df.join(first, keys).where(F.col(order) >= F.col("_first")).drop("_first")


def marked_first(df: DataFrame, mark: str, order: str, n: int) -> DataFrame:
    """The first n rows, marked ones (the greatest mark) before all others, nulls last."""
    return df.orderBy(F.desc_nulls_last(mark), order).limit(n)


def with_split(df: DataFrame, split: str, known: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """The rows as records of one split; a split that the table names already must be the same, else the row is given as ``clash``."""
    if split not in known:
        raise ValueError(f"{split} is none of {known}")
    own = F.lower(F.trim("split")) if "split" in df.columns else F.lit(None).cast("string")
    return df.withColumn("clash", F.coalesce(own != split, F.lit(False))).withColumn("split", F.lit(split))


def key_tuples(df: DataFrame, keys: list[str], name: str = "key", carry: list[str] = ()) -> DataFrame:
    """(name, carried columns): keys packed into one struct and its text form, other columns passed through; a null key part drops the row."""
    return df.dropna(subset=keys).select(F.struct(*keys).alias(name), F.concat_ws("_", *(F.col(k).cast("string") for k in keys)).alias(f"{name}_text"), *carry)


def agreement(cube: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """One row: places of both cubes, of one only, and places that either repeats. Sound cubes have zeros in all but ``both``."""
    n = lambda t, name: t.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    t = n(cube, "a").join(n(other, "b"), keys, "full")
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    a, b = F.col("a"), F.col("b")
    return t.agg(count(a.isNotNull() & b.isNotNull(), "both"), count(b.isNull(), "left_only"), count(a.isNull(), "right_only"), count((a > 1) | (b > 1), "repeated"))


def head_sizes(text: Column) -> tuple[Column, Column]:
    """Width and number of heads of "160x10", in any case and spacing; null for anything else."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"^\s*(\d{1,9})\s*[xX×*]\s*(\d{1,9})\s*$", i), F.lit("")).cast("int")
    return part(1), part(2)


def aspect_parts(degrees: Column) -> tuple[Column, Column]:
    """Sine and cosine of an aspect; flat ground (a negative aspect) has 0 and 0."""
    a = F.radians(degrees.cast("double"))
    return F.when(degrees >= 0, F.sin(a)).when(degrees < 0, 0.0), F.when(degrees >= 0, F.cos(a)).when(degrees < 0, 0.0)


def masked_scores(df: DataFrame, keys: list[str], scores: str, mask: str) -> DataFrame:
    """(keys, pixel, p) of the scores whose mask is true; a score without a mask element is out."""
    both = F.arrays_zip(F.col(scores).alias("p"), F.col(mask).alias("m"))
    return df.select(*keys, F.posexplode(both).alias("pixel", "x")).where("x.m").select(*keys, "pixel", F.col("x.p").alias("p"))


def shared_places(df: DataFrame, place: str, part: str) -> DataFrame:
    """(place, parts) of the places that lie in more than one part."""
    return df.where(F.col(part).isNotNull()).groupBy(place).agg(F.count_distinct(part).alias("parts")).where("parts > 1")
