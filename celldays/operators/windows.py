"""Trailing windows anchored at each sample, their aggregates, and fills along time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = F.unix_date


def trailing(df: DataFrame, value: str, keys: list[str], day: str, size: int, count: int = 4, at_least: int = 1) -> DataFrame:
    """w1..wn: 1 where the k-th trailing window [t - k size, t - (k-1) size) has at least ``at_least`` of value = 1.

    Null where one of its days is absent. One shuffle by cell; a partition is one cell's calendar. Windows are differences
    of running totals, whose frames Spark extends row by row, where a sliding frame would be summed anew at every row.
    """
    w = Window.partitionBy(*keys).orderBy(F.unix_date(day))
    total = lambda x, k: F.coalesce(F.sum(x).over(w.rangeBetween(Window.unboundedPreceding, -size * k - 1)), F.lit(0))
    kept = df.columns
    df = df.withColumns({f"_{n}{k}": total(x, k) for k in range(count + 1) for n, x in (("s", F.col(value).cast("bigint")), ("n", F.lit(1)))})
    flag = lambda k: F.when(F.col(f"_n{k - 1}") - F.col(f"_n{k}") == size, (F.col(f"_s{k - 1}") - F.col(f"_s{k}") >= at_least).cast("int"))
    return df.select(*kept, *(flag(k).alias(f"w{k}") for k in range(1, count + 1)))


def pattern_class(fire: Column, w: list[Column]) -> Column:
    """Fire-5: fire in all windows; Fre-2: in the newest only; Fire-1: in none; null for the rest and for no fire."""
    none = (w[0] == 0) & (w[1] == 0) & (w[2] == 0) & (w[3] == 0)
    every = (w[0] == 1) & (w[1] == 1) & (w[2] == 1) & (w[3] == 1)
    newest = (w[0] == 1) & (w[1] == 0) & (w[2] == 0) & (w[3] == 0)
    return F.when(fire == 1, F.when(none, "Fire-1").when(every, "Fire-5").when(newest, "Fre-2"))


def window_ids(samples: DataFrame, daily: DataFrame, keys: list[str], size: int, count: int = 4) -> DataFrame:
    """Daily rows of the windows before each sample with their window_id (1 the newest): an interval join made an equi join.

    Samples and days meet on the cell and the block of size * count days, each sample in the two blocks its history touches.
    """
    span = size * count
    block = lambda c: F.floor(F.unix_date(c) / span)
    s = samples.withColumn("block", F.explode(F.array_distinct(F.array(block(F.date_sub("target_date", span)), block(F.date_sub("target_date", 1))))))
    d = daily.withColumn("block", block("day"))
    age = F.datediff("target_date", "day")
    return s.join(d, [*keys, "block"]).where(age.between(1, span)).drop("block").withColumn("window_id", (F.floor((age - 1) / size) + 1).cast("int"))


def ema(day: str, value: str, alpha: float) -> Column:
    """Exponential mean over a group in day order, seeded by the oldest value; a window's days bound the list."""
    seq = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(day).alias("d"), F.col(value).cast("double").alias("v")))))
    return F.when(F.size(seq) > 0, F.aggregate(F.slice(seq, 2, F.greatest(F.size(seq) - 1, F.lit(0))), seq[0]["v"], lambda a, x: alpha * x["v"] + (1 - alpha) * a))


def window_features(joined: DataFrame, keys: list[str], methods: dict[str, str], default: str = "mean", alpha: float = 0.3, least: int = 1) -> DataFrame:
    """One row per key and window: each feature by its method (mean, sum, min, max, ema); null below ``least`` valid days."""
    plain = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    aggs = []
    for name, method in methods.items():
        m = method or default
        value = ema("day", name, alpha) if m == "ema" else plain[m](F.col(name).cast("double"))
        aggs.append(F.when(F.count(name) >= least, value).alias(name))
    return joined.groupBy(*keys, "window_id").agg(*aggs)


def forward_fill(df: DataFrame, value: str, keys: list[str], order: str, name: str | None = None, block: Column | None = None) -> DataFrame:
    """Each row takes the last known value up to it.

    Without ``block`` an entity's whole series is one partition. block: a span of time that never decreases along the order (a day, a month); then a partition is
    one span of an entity, and what the spans before it hand on comes from one row per span, so a hot entity is spread over its spans.
    """
    if block is None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name or value, F.last(value, True).over(w))
    t = df.withColumn("_block", block)
    known = F.col(value).isNotNull()
    ends = t.groupBy(*keys, "_block").agg(F.max_by(F.when(known, F.col(value)), F.when(known, F.col(order))).alias("_end"))
    carried = F.last("_end", True).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_block").alias("_b"), carried.alias("_before"))
    on = t["_block"].eqNullSafe(F.col("_b"))
    for k in keys:
        on = on & t[k].eqNullSafe(F.col(f"_{k}"))
    w = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = t.join(ends, on, "left").withColumn("_out", F.coalesce(F.last(value, True).over(w), F.col("_before")))
    return filled.select(*(c for c in df.columns if c != (name or value)), F.col("_out").alias(name or value))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, block: str | None = None) -> DataFrame:
    """Left rows with the last right value at or before their time: a union ordered by time instead of a theta join.

    block: a unit of time (day, month); a partition is then one such span of an entity instead of its whole series.
    """
    r = right.select(*keys, F.col(right_time).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    both = left.withColumns({"_t": F.col(left_time), "_v": F.lit(None), "_side": F.lit(1)}).unionByName(r, allowMissingColumns=True)
    # a right row without a value is no news: the last known one holds
    both = both.withColumn("_o", F.struct("_t", "_side"))
    filled = forward_fill(both, "_v", keys, "_o", value, F.date_trunc(block, "_t") if block else None)
    return filled.where("_side = 1").select(*left.columns, value)


def pseudo_daily(windows: DataFrame, size: int = 16, count: int = 4) -> DataFrame:
    """Each window's row repeated on its days, index 0 the oldest day."""
    day = F.explode(F.sequence((count - F.col("window_id")) * size, (count - F.col("window_id")) * size + size - 1))
    return windows.where(F.col("window_id").between(1, count)).withColumn("i", day)


def history_tensor(df: DataFrame, keys: list[str], order: str, value: str, length: int) -> DataFrame:
    """The last ``length`` values up to each row as an array, only where the history is whole."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - length, 0)
    return df.withColumn("history", F.collect_list(value).over(w)).where(F.size("history") == length)
