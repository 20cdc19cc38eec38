"""Filling missing values from records of the same sample, cell, area or time, each filled value marked.

Numerics are filled in time order per cell: another delivery of the same cell and time, else linear interpolation
between the nearest observed neighbours, else the one neighbour within a gap limit, else the mean of the area in that
month of the year, of the area, of the month, of all records. The category window_id is filled first within its sample: the k-th row
without a window takes the k-th of the windows 1..4 that the sample lacks. What that leaves is carried in time along the cell: the newest window of
the sample itself, else of the last sample of the cell before it, else of the next one after it, both within the gap limit; beyond it
the most frequent window of the area, else of all records. Method and distance in days are recorded with every value.

Every sample is first reduced to one row (a partial aggregate) that holds a sum and a count per window and column; those rows are shuffled
by cell once, where they are laid out in time. So a cell that holds a third of all rows is a short series like any other, and only rows with
something to fill are joined back.

A window beyond the last counts as the last. Ties and repeated rows at one time are averaged; rows without a window add nothing to the series, as their time
isn't known. A row without aoi_id, row, col or date has no cell series and takes a mean or most frequent window; a row without feat_id can't be marked and
is left out. A value stays null, with method none, only where no record has a usable value. Empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celldays.functions.reading import in_range
from celldays.session import cut

CELL = ["aoi_id", "row", "col"]
SAMPLE = ["aoi_id", "target_date", "row", "col"]
WINDOWS = 4
WINDOW_DAYS = 16
GAP_DAYS = 64


def _gone(w: Column) -> Column:
    return w.isNull() | (w < 1)


def _whole() -> Column:
    whole = F.lit(True)
    for c in SAMPLE:
        whole = whole & F.col(c).isNotNull()
    return whole


def first_ranks(rows: DataFrame, key: list[str], order: str, n: int, salts: int = 64) -> DataFrame:
    """Rank 1..n of the first n rows of each key, null keys included, by a salted two-level top-n: no key is sorted whole in one task."""
    salt = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    part = salt.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "_salt").orderBy(order))).where(F.col("_r") <= n)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where(F.col("rank") <= n).drop("_salt", "_r")


def _beside(value: str, by: list[str], order: str) -> tuple[Column, Column]:
    """The nearest known values before and after each row of a series."""
    over = f"ignore nulls over (partition by {', '.join(by)} order by {order})"
    return F.expr(f"lag({value}) {over}"), F.expr(f"lead({value}) {over}")


def common_windows(features: DataFrame, windows: int = WINDOWS) -> DataFrame:
    """(aoi_id, area_window, all_window) of every area: the most frequent window of the area and of all records; ties go to the newer window."""
    w = F.when(F.col("window_id").between(1, windows), F.col("window_id"))
    n = features.groupBy("aoi_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    # one row per window, so the window over all of them is small and the table may be broadcast
    ids = features.sparkSession.range(1, windows + 1).select(F.col("id").cast("int").alias("w"))
    total = ids.join(n.groupBy("w").agg(F.sum("n").alias("n")), "w", "left")
    total = total.select(F.col("w").alias("_w"), F.max_by(F.when(F.col("n").isNotNull(), F.col("w")), F.when(F.col("n").isNotNull(), F.struct("n", -F.col("w")))).over(Window.partitionBy(F.lit(0))).alias("all_window"))
    every = n.join(F.broadcast(total), F.coalesce("w", F.lit(1)) == F.col("_w"))
    known = F.when(F.col("w").isNotNull(), F.struct("n", -F.col("w")))
    return every.groupBy("aoi_id").agg(F.max_by("w", known).alias("area_window"), F.max("all_window").alias("all_window"))


def carried_windows(features: DataFrame, windows: int = WINDOWS, max_gap_days: int = GAP_DAYS) -> DataFrame:
    """(sample key, absent, carried, distance) of the samples that have a row without a window.

    absent: windows the sample lacks, newest first; carried: the sample's newest window, else that of the sample of the cell nearest in time, the one before
    first, at most max_gap_days away. Only cells with such a sample are read.
    """
    w = F.col("window_id")
    cells = features.where(_gone(w) & _whole()).select(*CELL).distinct()
    bits = F.expr(f"bit_or(case when window_id between 1 and {windows} then shiftleft(1, window_id - 1) else 0 end)")
    samples = features.where(_whole()).join(cells, CELL, "left_semi").groupBy(*SAMPLE).agg(bits.alias("bits"), F.max(_gone(w)).alias("asked"))
    has = F.expr(f"filter(sequence(1, {windows}), k -> shiftright(bits, k - 1) % 2 = 1)")
    samples = samples.select(*SAMPLE, "asked", has.alias("seen"), F.when(F.size(has) > 0, F.struct(F.col("target_date").alias("day"), F.array_min(has).alias("w"))).alias("own"))
    back, ahead = _beside("own", CELL, "target_date")
    t = samples.withColumns({"back": back, "ahead": ahead}).where("asked")
    before, after = F.datediff("target_date", "back.day"), F.datediff("ahead.day", "target_date")
    found = F.coalesce(
        F.when(F.col("own").isNotNull(), F.struct(F.col("own.w").alias("w"), F.lit(0).alias("distance"))),
        F.when(before <= max_gap_days, F.struct(F.col("back.w").alias("w"), before.alias("distance"))),
        F.when(after <= max_gap_days, F.struct(F.col("ahead.w").alias("w"), after.alias("distance"))),
    )
    absent = F.array_except(F.sequence(F.lit(1), F.lit(windows)), "seen")
    return t.select(*SAMPLE, absent.alias("absent"), found["w"].alias("carried"), found["distance"].alias("distance"))


def fill_windows(features: DataFrame, windows: int = WINDOWS, max_gap_days: int = GAP_DAYS) -> DataFrame:
    """(feat_id, window_id, method, distance) of every row whose window_id is null or below 1.

    absent: the sample lacks that window (distance 0); carry: carried along the cell (distance in days); area, all: the most frequent window.
    """
    todo = features.where(_gone(F.col("window_id")) & F.col("feat_id").isNotNull()).select("feat_id", *SAMPLE)
    ranks = first_ranks(todo.where(_whole()), SAMPLE, "feat_id", windows).select("feat_id", "rank")
    out = todo.join(ranks, "feat_id", "left").join(carried_windows(features, windows, max_gap_days), SAMPLE, "left")
    common = common_windows(features, windows).withColumnRenamed("aoi_id", "_aoi")
    out = out.join(common, F.col("aoi_id").eqNullSafe(F.col("_aoi")), "left")
    steps = [
        ("absent", F.when(F.col("rank") <= F.size("absent"), F.try_element_at("absent", F.col("rank"))), F.lit(0)),
        ("carry", F.col("carried"), F.col("distance")),
        ("area", F.when(F.col("aoi_id").isNotNull(), F.col("area_window")), F.lit(None)),
        ("all", F.col("all_window"), F.lit(None)),
    ]
    found = F.coalesce(*(F.when(w.isNotNull(), F.struct(w.cast("int").alias("window_id"), F.lit(name).alias("method"), d.cast("int").alias("distance"))) for name, w, d in steps))
    none = F.struct(F.lit(None).cast("int").alias("window_id"), F.lit("none").alias("method"), F.lit(None).cast("int").alias("distance"))
    return out.select("feat_id", F.coalesce(found, none).alias("x")).select("feat_id", "x.*")


def _day(w: Column) -> Column:
    return F.date_sub("target_date", ((w - 1) * WINDOW_DAYS).cast("int"))


def means(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(aoi_id, month, mean_<column>, by_<column>): for each area and month the mean of the smallest set that has a value."""
    sums = rows.groupBy("aoi_id", F.month(_day(F.coalesce("w", F.lit(1)))).alias("month")).agg(*(x for c in columns for x in (F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))))
    total = lambda t, w: t.select("*", *(F.sum(f"{k}_{c}").over(w).alias(f"all_{k}_{c}") for c in columns for k in "sn"))
    # at most 13 rows, so the window over all of them is small and the table may be broadcast
    months = total(sums.groupBy("month").agg(*(F.sum(f"{k}_{c}").alias(f"{k}_{c}") for c in columns for k in "sn")), Window.partitionBy(F.lit(0)))
    months = months.select(F.col("month").alias("m"), *(F.try_divide(f"{p}s_{c}", f"{p}n_{c}").alias(f"{s}_{c}") for c in columns for p, s in (("", "month"), ("all_", "all"))))
    out = total(sums, Window.partitionBy("aoi_id")).select("aoi_id", "month", *(F.try_divide(f"{p}s_{c}", f"{p}n_{c}").alias(f"{s}_{c}") for c in columns for p, s in (("", "area_month"), ("all_", "area"))))
    out = out.join(F.broadcast(months), F.col("month").eqNullSafe(F.col("m")), "left")
    steps = ("area_month", "area", "month", "all")
    return out.select("aoi_id", "month", *(F.coalesce(*(F.col(f"{s}_{c}") for s in steps)).alias(f"mean_{c}") for c in columns), *(F.coalesce(*(F.when(F.col(f"{s}_{c}").isNotNull(), F.lit(s)) for s in steps)).alias(f"by_{c}") for c in columns))


def series(rows: DataFrame, columns: list[str], max_gap_days: int) -> DataFrame:
    """(cell, day, fill_<column>) of the days that some row asks for: value, method and distance from the cell's own values, null where it has none near."""
    w, gap = F.col("w"), F.lit(False)
    for c in columns:
        gap = gap | F.col(c).isNull()
    aggs = [F.max(w.isNull() & gap).alias("lost")]
    for k in range(1, WINDOWS + 1):
        aggs += [F.max((w == k) & gap).alias(f"gap{k}"), *(x for c in columns for x in (F.sum(F.when(w == k, F.col(c))).alias(f"s{k}_{c}"), F.count(F.when(w == k, F.col(c))).cast("int").alias(f"n{k}_{c}")))]
    samples = rows.where(_whole()).groupBy(*SAMPLE).agg(*aggs).repartition(*CELL)
    slots = F.array(*(F.struct(_day(F.lit(k)).alias("day"), F.coalesce(F.col(f"gap{k}") | F.col("lost"), F.col("lost")).alias("gap"), *(F.col(f"{x}{k}_{c}").alias(f"{x}_{c}") for c in columns for x in "sn")) for k in range(1, WINDOWS + 1)))
    used = F.filter(slots, lambda s: s["gap"] | (sum((s[f"n_{c}"] for c in columns), F.lit(0)) > 0))
    daily = samples.select(*CELL, F.inline(used)).groupBy(*CELL, "day").agg(F.max("gap").alias("gap"), *(F.try_divide(F.sum(f"s_{c}"), F.sum(f"n_{c}")).alias(f"at_{c}") for c in columns))
    daily = daily.select("*", *(F.when(F.col(f"at_{c}").isNotNull(), F.struct("day", F.col(f"at_{c}").alias("v"))).alias(f"own_{c}") for c in columns))
    beside = {f"{n}_{c}": x for c in columns for n, x in zip(("prev", "next"), _beside(f"own_{c}", CELL, "day"), strict=True)}
    asked = daily.withColumns(beside).where("gap")

    def one(c: str) -> Column:
        p, n, at = F.col(f"prev_{c}"), F.col(f"next_{c}"), F.col(f"at_{c}")
        dp, dn = F.datediff("day", p["day"]), F.datediff(n["day"], "day")
        made = lambda v, how, d: F.when(v.isNotNull(), F.struct(v.alias("filled"), F.lit(how).alias("method"), d.cast("int").alias("distance")))
        line = p["v"] + (n["v"] - p["v"]) * dp / F.nullif(dp + dn, F.lit(0))
        return F.coalesce(made(at, "same_time", F.lit(0)), made(line, "interpolated", F.least(dp, dn)), made(F.when(dp <= max_gap_days, p["v"]), "carried", dp), made(F.when(dn <= max_gap_days, n["v"]), "carried", dn))

    return asked.select(*CELL, "day", *(one(c).alias(f"fill_{c}") for c in columns))


def numeric_fills(features: DataFrame, windows: DataFrame, catalog: DataFrame, columns: list[str], max_gap_days: int = GAP_DAYS) -> DataFrame:
    """(feat_id, column_name, filled, method, distance) of every value that is missing or not in range.

    windows: fill_windows(); catalog: feature, valid_min, valid_max (a fixed small table). max_gap_days bounds the carry from a single
    neighbour; interpolation between two has no limit. distance is in days to the nearer neighbour used.
    """
    limits = {r["feature"]: (r["valid_min"], r["valid_max"]) for r in catalog.where(F.col("feature").isin(columns)).collect()}
    good = {c: in_range(F.col(c), F.lit(limits[c][0]), F.lit(limits[c][1])) for c in columns}
    rows = features.select("feat_id", *SAMPLE, F.when(~_gone(F.col("window_id")), F.least("window_id", F.lit(WINDOWS))).alias("w"), *(F.when(good[c], F.col(c).cast("double")).alias(c) for c in columns))
    gap = F.lit(False)
    for c in columns:
        gap = gap | F.col(c).isNull()
    todo = rows.where(gap & F.col("feat_id").isNotNull()).select("feat_id", *SAMPLE, "w", *(F.col(c).isNull().alias(f"no_{c}") for c in columns))
    lost = todo.where("w is null").drop("w").join(windows.select("feat_id", F.col("window_id").alias("w")), "feat_id").select(*todo.columns)
    todo = todo.where("w is not null").unionByName(lost).withColumn("day", _day(F.coalesce("w", F.lit(1))))
    m = means(rows, columns)
    wide = todo.join(series(rows, columns, max_gap_days), [*CELL, "day"], "left").join(m, m["aoi_id"].eqNullSafe(todo["aoi_id"]) & m["month"].eqNullSafe(F.month(todo["day"])), "left")

    def one(c: str) -> Column:
        rest = F.struct(F.col(f"mean_{c}").alias("filled"), F.coalesce(F.col(f"by_{c}"), F.lit("none")).alias("method"), F.lit(None).cast("int").alias("distance"))
        return F.when(F.col(f"no_{c}"), F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"fill_{c}"), rest).alias("x")))

    return wide.select("feat_id", F.explode(F.array_compact(F.array(*(one(c) for c in columns)))).alias("y")).select("feat_id", "y.column_name", "y.x.*")


def fill(features: DataFrame, catalog: DataFrame, columns: list[str], max_gap_days: int = GAP_DAYS) -> DataFrame:
    """(feat_id, column_name, filled, method, distance): one row per value filled, numerics and window_id alike."""
    windows = cut(fill_windows(features, WINDOWS, max_gap_days))  # the few rows without a window, read twice below
    named = windows.select("feat_id", F.lit("window_id").alias("column_name"), F.col("window_id").cast("double").alias("filled"), "method", "distance")
    return numeric_fills(features, windows, catalog, columns, max_gap_days).unionByName(named)
