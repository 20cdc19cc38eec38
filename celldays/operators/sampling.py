"""Exact-size samples, quotas and their redistribution. Order is by seeded md5, which is the same on every engine and run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096


def order_hash(keys: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))


def unit(hashed: Column) -> Column:
    """A number in (0, 1) of an md5."""
    return (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)


def first_by_hash(df: DataFrame, group: list[str], n: Column | int, keys: list[str], seed: int = 42, place: str | None = None) -> DataFrame:
    """The n rows of each group with the least hash (n a number or a column of the group), all where it has fewer; ``place`` names their rank from 1.

    A histogram of hash ranges finds the range of each group's cutoff; ranges below it are taken whole, and only that range is
    ranked, so no group is sorted in one task and only its rows are shuffled. With ``place`` all rows taken are ranked, range by range.
    """
    h = df.withColumn("_h", order_hash(keys, seed)).withColumn("_r", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")).withColumn("_n", F.lit(n) if isinstance(n, int) else n)
    # a null group is a group: nulls are coded for the joins
    code = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}) if group else F.lit("")
    h = h.withColumn("_g", code)
    counts = h.groupBy("_g", "_r").agg(F.count(F.lit(1)).alias("c"))
    end = F.sum("c").over(Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    if not place:
        ends = h.groupBy("_g", "_r").agg(F.count(F.lit(1)).alias("c"), F.max("_n").alias("n")).withColumn("end", end)
        edge = F.min(F.when(F.col("end") >= F.col("n"), F.col("_r")))
        lines = ends.groupBy("_g").agg(F.coalesce(edge, F.lit(RANGES)).alias("_edge"), F.coalesce(F.max(F.when(F.col("end") < F.col("n"), F.col("end"))), F.lit(0)).alias("_before"))
        marked = h.join(lines, "_g")
        last = marked.where(F.col("_r") == F.col("_edge")).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_g").orderBy("_h", *keys))).where(F.col("_rank") <= F.col("_n")).drop("_rank")
        return marked.where(F.col("_r") < F.col("_edge")).unionByName(last).drop("_h", "_r", "_n", "_g", "_edge", "_before")
    placed = h.join(counts.withColumn("_before", end - F.col("c")).drop("c"), ["_g", "_r"])
    whole = placed.where(F.col("_before") < F.col("_n"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_g", "_r").orderBy("_h", *keys))
    taken = whole.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_n")).drop("_h", "_r", "_n", "_g", "_before")
    return taken.withColumnRenamed("_rank", place)


def weighted_key(weight: Column, hashed: Column) -> Column:
    """Efraimidis-Spirakis key: the n largest keys are a weighted sample without replacement."""
    return F.ln(unit(hashed)) / weight


def weighted_sample(df: DataFrame, group: list[str], n: Column | int, weight: Column, keys: list[str], seed: int = 42) -> DataFrame:
    """Top n (a number or a column of the group) of each group by weighted key, in two levels (per salt, then per group) so that no group is sorted whole."""
    w = df.withColumn("_h", order_hash(keys, seed)).withColumn("_k", weighted_key(weight, F.col("_h")))
    order = [F.desc("_k"), "_h", *keys]
    part = w.withColumn("_s", F.substring("_h", 1, 2)).withColumn("_a", F.row_number().over(Window.partitionBy(*group, "_s").orderBy(*order))).where(F.col("_a") <= n)
    return part.withColumn("_b", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_b") <= n).drop("_h", "_k", "_s", "_a", "_b")


def with_replacement(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n draws with replacement: draw i takes the row whose rank is a hash of i; ``draw`` numbers them."""
    total = df.count()
    if not total:
        return df.limit(0).withColumn("draw", F.lit(0))
    h = df.withColumn("_h", order_hash(keys, seed)).withColumn("_r", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = h.groupBy("_r").agg(F.count(F.lit(1)).alias("c"))
    end = F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))  # at most RANGES rows
    ranked = h.join(F.broadcast(counts.withColumn("_before", end - F.col("c")).drop("c")), "_r").withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy("_r").orderBy("_h", *keys)) - 1)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.lit(total)).alias("place"))
    return ranked.join(draws, "place").drop("_h", "_r", "_before", "place")


def quotas(total: int, parts: dict[str, float]) -> dict[str, int]:
    """Largest-remainder shares of a total by weight; ties go to the earlier name."""
    whole = sum(parts.values())
    exact = {k: total * v / whole for k, v in parts.items()}
    out = {k: math.floor(v) for k, v in exact.items()}
    names = list(parts)
    for k in sorted(names, key=lambda k: (out[k] - exact[k], names.index(k)))[: total - sum(out.values())]:
        out[k] += 1
    return out


def redistribute(want: dict[str, int], have: dict[str, int], order: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    """(taken, repeated): shortfalls go round-robin to classes with spare rows in the given order; what is left is drawn again."""
    take = {k: min(n, have.get(k, 0)) for k, n in want.items()}
    lack = sum(want.values()) - sum(take.values())
    spare = {k: have.get(k, 0) - take[k] for k in order}
    # whole rounds at once: between two classes running out, every open class gets the same
    while lack and (open_ := [k for k in order if spare[k]]):
        rounds = min(lack // len(open_), min(spare[k] for k in open_))
        for k in open_ if rounds else open_[:lack]:
            take[k] += rounds or 1
            spare[k] -= rounds or 1
            lack -= rounds or 1
    able = [k for k in order if have.get(k, 0)]
    again = dict.fromkeys(want, 0) | {k: lack // len(able) + (i < lack % len(able)) for i, k in enumerate(able)}
    return take, again


def ratio_units(have: dict[str, int], ratio: dict[str, int]) -> int:
    """Largest k with k times the ratio available in every class."""
    return min(have.get(c, 0) // r for c, r in ratio.items())


def required_per_unit(classes: dict[str, dict[str, int]]) -> dict[str, int]:
    """Smallest integer weights that keep each group's inner ratio and give all groups the same total."""
    sums = {g: sum(r.values()) for g, r in classes.items()}
    common = math.lcm(*sums.values())
    return {c: n * common // sums[g] for g, r in classes.items() for c, n in r.items()}
