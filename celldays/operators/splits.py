"""Splits by time with history guards, class ratios within splits, and checks that nothing leaks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celldays.operators.sampling import first_by_hash, ratio_units


def summer_bounds(year: Column, first_month: int = 6, last_month: int = 9) -> tuple[Column, Column]:
    return F.make_date(year, F.lit(first_month), F.lit(1)), F.last_day(F.make_date(year, F.lit(last_month), F.lit(1)))


def assign_summers(df: DataFrame, day: str, val_years: list[int], test_year: int, history: int = 64) -> DataFrame:
    """split by summers: val and test are those years' summers; a row is train if its history of ``history`` days touches none of them, else null."""
    t = F.col(day)
    out = F.lit("train")
    for y in [*val_years, test_year]:
        a, b = summer_bounds(F.lit(y))
        out = F.when((t >= a) & (F.date_sub(t, history) <= b), F.lit(None)).otherwise(out)
    for y in val_years:
        a, b = summer_bounds(F.lit(y))
        out = F.when(t.between(a, b), F.lit("val")).otherwise(out)
    a, b = summer_bounds(F.lit(test_year))
    out = F.when(t.between(a, b), F.lit("test")).otherwise(out)
    return df.withColumn("split", F.when(t.isNotNull(), out))


def choose_val_years(per_year: dict[int, int], test_year: int, target_share: float) -> list[int]:
    """The k most recent summers before the test year whose rows come nearest the target share of all; ties take fewer years."""
    years = sorted((y for y in per_year if y < test_year), reverse=True)
    whole = sum(per_year.values())
    best = min(range(1, len(years) + 1), key=lambda k: (abs(sum(per_year[y] for y in years[:k]) / whole - target_share), k), default=0)
    return sorted(years[:best])


def without_conflicts(df: DataFrame, keys: list[str], label: str, kind: str) -> DataFrame:
    """One row per key, keys with more than one label or class left out; a null beside a value is no conflict."""
    g = df.groupBy(*keys).agg(F.count_distinct(label).alias("_l"), F.count_distinct(kind).alias("_k"), F.min(kind).alias(kind), F.min(label).alias(label))
    return g.where("_l <= 1 and _k <= 1").select(*keys, kind, label)


def conflicts(df: DataFrame, keys: list[str], label: str, kind: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(label).alias("labels"), F.count_distinct(kind).alias("kinds")).where("labels > 1 or kinds > 1")


def by_ranges(df: DataFrame, day: str, ranges: dict[str, tuple[date, date]]) -> DataFrame:
    out = F.lit(None).cast("string")
    for name, (a, b) in ranges.items():
        out = F.when(F.col(day).between(F.lit(a), F.lit(b)), F.lit(name)).otherwise(out)
    return df.withColumn("split", out).where(F.col("split").isNotNull())


def ratio_splits(df: DataFrame, day: str, kind: str, keys: list[str], ratio: dict[str, int], ranges: dict[str, tuple[date, date]], seed: int = 42) -> DataFrame:
    """In each date range the largest sample whose classes stand exactly in the ratio; only class counts reach the driver."""
    rows = by_ranges(df.where(F.col(kind).isin(list(ratio))), day, ranges)
    have: dict[str, dict[str, int]] = {s: {} for s in ranges}
    for r in rows.groupBy("split", kind).count().collect():
        have[r[0]][r[1]] = r[2]
    n = F.lit(0)
    for s in ranges:
        k = ratio_units(have[s], ratio)
        for c, r in ratio.items():
            n = F.when((F.col("split") == s) & (F.col(kind) == c), F.lit(r * k)).otherwise(n)
    return first_by_hash(rows, ["split", kind], n, keys, seed)


def shared_days(df: DataFrame, day: str) -> DataFrame:
    """Days that occur in more than one split: empty for disjoint splits; one aggregation instead of pairwise joins."""
    return df.where("split is not null").groupBy(day).agg(F.count_distinct("split").alias("splits")).where("splits > 1")
