"""Composite jobs over the label cube: history patterns, distance classes of negatives, balanced negatives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from celldays.operators.sampling import first_by_hash, order_hash, quotas, redistribute
from celldays.operators.spatial import nearest_event_distance
from celldays.operators.windows import pattern_class, trailing

#: fixed values: wanted ratio of the negative classes and the order in which shortfalls are made up
RATIO = {"0A": 1, "0B": 1, "0C": 2, "0D": 1}
REFILL = ["0C", "0A", "0B", "0D"]


def history_patterns(cube: DataFrame, window_days: int = 16, threshold: int = 3) -> DataFrame:
    """Fire cell-days of a dense cube (day, row, col, fire) with four whole windows: their flags and pattern class (null for no class)."""
    t = trailing(cube, "fire", ["row", "col"], "day", window_days, 4, threshold)
    whole = t.where("fire = 1 and w1 is not null and w2 is not null and w3 is not null and w4 is not null")
    return whole.withColumn("pattern_type", pattern_class(F.col("fire"), [F.col(f"w{k}") for k in range(1, 5)]))


def negative_class(distance: Column, history: Column) -> Column:
    """0A: (1, 5] without history; 0B: (1, 5] with; 0C: (5, 10] with; 0D: beyond 10; null for the gaps between."""
    return F.when(distance > 10, "0D").when((distance > 1) & (distance <= 5), F.when(history == 0, "0A").otherwise("0B")).when((distance > 5) & (distance <= 10) & (history == 1), "0C")


def negatives(cells: DataFrame, fires: DataFrame, cell_km: float = 4.0) -> DataFrame:
    """Fire-free cell-days (day, row, col, history) of days with fires, with their distance to the day's fires and class."""
    days = fires.select("day").distinct()
    near = nearest_event_distance(cells.join(days, "day", "left_semi"), fires, 10)
    return near.withColumn("class_name", negative_class(F.col("distance"), F.col("history"))).where("class_name is not null").withColumn("distance_km", F.col("distance") * cell_km)


def balanced_negatives(rows: DataFrame, totals: dict[tuple, int], group: list[str], keys: list[str], seed: int = 42) -> DataFrame:
    """totals[group] rows of each group (a split, a year ..) in the fixed ratio; shortfalls are refilled from the other classes in order.

    What the unique rows of a group can't give is drawn again with replacement, in the ratio of the classes that have rows:
    draw i of a class takes the row whose rank is a hash of i. A group without a negative of any class gives none.
    """
    have: dict[tuple, dict[str, int]] = {}
    for r in rows.groupBy(*group, "class_name").count().collect():
        have.setdefault(tuple(r[: len(group)]), {})[r["class_name"]] = r["count"]
    plan = []
    for g, counts in have.items():
        total = totals.get(g, 0)
        take, _ = redistribute(quotas(total, RATIO), counts, REFILL)
        able = {c: w for c, w in RATIO.items() if counts.get(c, 0)}
        again = quotas(total - sum(take.values()), able) if able else {}
        plan += [(*g, c, take[c], again.get(c, 0), counts.get(c, 0)) for c in RATIO]
    schema = StructType([*(rows.schema[c] for c in group), *(StructField(c, t) for c, t in (("class_name", StringType()), ("_take", LongType()), ("_again", LongType()), ("_have", LongType())))])
    by = [*group, "class_name"]
    p = rows.sparkSession.createDataFrame(plan, schema).select(*(F.col(c).alias(f"_{c}") for c in by), "_take", "_again", "_have")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    planned = rows.join(F.broadcast(p.select(*(f"_{c}" for c in by), "_take")), same).select(*rows.columns, "_take")
    unique = first_by_hash(planned, by, F.col("_take"), keys, seed, "_rank")
    # where rows are drawn again, all rows of the group are taken, so that the ranks run from 1 to _have
    block = 10_000
    draws = p.where("_again > 0").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_again - 1) div {block}"))))
    draws = draws.withColumn("_draw", F.explode(F.sequence(F.col("_b") * block, F.least(F.col("_again") - 1, F.col("_b") * block + block - 1))))
    hashed = F.conv(F.substring(order_hash([*(f"_{c}" for c in by), "_draw"], seed), 1, 15), 16, 10).cast("long")
    draws = draws.select(*(f"_{c}" for c in by), (F.pmod(hashed, F.col("_have")) + 1).alias("_place"))
    repeated = unique.join(draws, same & (F.col("_rank") == F.col("_place")))
    return unique.select(*rows.columns).unionByName(repeated.select(*(F.col(c) for c in rows.columns)))
