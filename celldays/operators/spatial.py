"""Neighbourhood operators on cells and points, as equi joins on buckets and offsets; none pairs all rows with all rows."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celldays.session import cut

#: order in which neighbours lend their value: W, N, E, S, NW, NE, SW, SE
ORDER = [(0, -1), (-1, 0), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1)]


def _near_buckets(c: str, size: float) -> Column:
    b = F.floor(F.col(c) / size)
    return F.explode(F.sequence(b - 1, b + 1))


#: mean number of points in the bucket of a point up to which buckets are halved, and how often at most
CROWD, HALVINGS = 4, 12


def _halvings(points: DataFrame, on: list[str], limit: float) -> int:
    """How often buckets of ``limit`` are halved until the points (rx, ry) have few companions in their own; one figure per step comes to the driver."""
    k = 0
    while k < HALVINGS:
        n = points.groupBy(*on, *(F.floor(F.col(c) / (limit / 2**k)).alias(f"b{c}") for c in ("rx", "ry"))).agg(F.count(F.lit(1)).cast("double").alias("n"))
        (crowd,) = n.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()
        if crowd is None or crowd <= CROWD:
            break
        k = min(HALVINGS, k + max(1, ceil(log(crowd / CROWD, 4))))
    return k


def nearest_within(left: DataFrame, right: DataFrame, x: str, y: str, limit: float, keep: list[str], on: list[str] | None = None) -> DataFrame:
    """Left rows with the columns ``keep`` of the nearest right point at most ``limit`` away (null where there is none) and its distance.

    Rounds of buckets, small enough at first that few right points share one and doubled up to ``limit``: right points go to the 9 buckets around
    their own, each left row meets the points of one bucket and is settled by one at most a bucket away; only the rest goes on. Right points of one
    place are reduced to the least before. Equal distances are decided by the right coordinates, then by the kept values. left needs a unique column ``id``.
    """
    on = on or []
    finite = (F.abs("rx") < float("inf")) & (F.abs("ry") < float("inf"))
    r = right.select(*on, F.col(x).alias("rx"), F.col(y).alias("ry"), *keep).where(finite)
    r = cut(r.groupBy(*on, "rx", "ry").agg(F.min(F.struct(*keep)).alias("kept")))
    dx, dy = F.col(x) - F.col("rx"), F.col(y) - F.col("ry")
    dist = F.sqrt(dx * dx + dy * dy)
    rest, found = left.select("id", *on, x, y), None
    for k in range(_halvings(r, on, limit), -1, -1):
        size = limit / 2**k
        wide = size * (1 + 1e-9)  # no rounding puts points at most size apart further than one bucket
        near = r.withColumn("bx", _near_buckets("rx", wide)).withColumn("by", _near_buckets("ry", wide))
        probe = rest.withColumn("bx", F.floor(F.col(x) / wide)).withColumn("by", F.floor(F.col(y) / wide))
        best = cut(probe.join(near, [*on, "bx", "by"], "left").groupBy("id", *on, x, y).agg(F.min(F.when(dist <= size, F.struct(dist.alias("distance"), "rx", "ry", "kept"))).alias("m")))
        hit = best.where("m is not null").select("id", "m")
        found = hit if found is None else found.unionByName(hit)
        rest = best.where("m is null").select("id", *on, x, y)
        if k and rest.isEmpty():
            break
    return left.join(found, "id", "left").select(*left.columns, *(F.col(f"m.kept.{c}").alias(c) for c in keep), F.col("m.distance").alias("distance"))


def nearest_event_distance(cells: DataFrame, events: DataFrame, size: int) -> DataFrame:
    """Exact distance in cells from each (day, row, col) to the nearest event of its day, null where the day has none.

    Rounds of buckets of ``size`` cells, doubled each time: a row meets the events of 9 buckets and is settled by an event at
    most ``size`` away, as none nearer can lie outside them; only the rest goes on. Events are reduced to distinct cells first.
    """
    place = ["day", "row", "col"]
    e = events.select("day", F.col("row").alias("er"), F.col("col").alias("ec")).dropna().distinct()
    dr, dc = F.col("row").cast("long") - F.col("er"), F.col("col").cast("long") - F.col("ec")
    left = cells.select(*place).dropna().distinct().join(e.select("day").distinct(), "day", "left_semi")
    found = None
    while True:
        near = e.withColumn("br", _near_buckets("er", size)).withColumn("bc", _near_buckets("ec", size))
        probe = left.withColumn("br", F.floor(F.col("row") / size)).withColumn("bc", F.floor(F.col("col") / size))
        best = cut(probe.join(near, ["day", "br", "bc"], "left").groupBy(*place).agg(F.min(dr * dr + dc * dc).alias("d2")))
        hit = best.where(F.col("d2") <= size * size)
        found = hit if found is None else found.unionByName(hit)
        left = best.where(F.coalesce(F.col("d2") > size * size, F.lit(True))).select(*place)
        if left.isEmpty():
            break
        size *= 2
    return cells.join(found, place, "left").withColumn("distance", F.sqrt(F.col("d2").cast("double"))).drop("d2")


def gradient(df: DataFrame, value: str, keys: list[str], step: float = 1.0) -> DataFrame:
    """Central differences along row (gy) and col (gx), one-sided at the edges; a line of one cell has none.

    Windows run over one line of one grid, so a partition holds at most its rows or cols.
    """

    def along(axis: str, line: str) -> Column:
        w = Window.partitionBy(*keys, line).orderBy(axis)
        a, b = F.lag(value).over(w), F.lead(value).over(w)
        return F.coalesce((b - a) / (2 * step), (b - F.col(value)) / step, (F.col(value) - a) / step)

    return df.withColumn("gy", along("row", "col")).withColumn("gx", along("col", "row"))


def slope_aspect(df: DataFrame) -> DataFrame:
    """Slope in degrees and aspect clockwise from north of gx and gy."""
    return df.withColumns({"slope": F.degrees(F.atan(F.hypot("gx", "gy"))), "aspect": F.pmod(F.degrees(F.atan2(-F.col("gx"), F.col("gy"))), F.lit(360.0))})


def offsets(df: DataFrame, value: str, keys: list[str], near: list[tuple[int, int]]) -> DataFrame:
    """Known values at the places that they lend to, with the rank of the offset."""
    known = df.where(F.col(value).isNotNull()).select(*keys, "row", "col", F.col(value).alias("lent"))
    moves = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(-r).alias("dr"), F.lit(-c).alias("dc")) for i, (r, c) in enumerate(near)))
    out = known.withColumn("o", F.explode(moves))
    return out.select(*keys, (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), F.col("o.rank").alias("rank"), "lent")


def focal_fill(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Missing cells take the mean of the known cells of their 3x3 window; known cells keep their value."""
    place = [*keys, "row", "col"]
    holes = df.where(F.col(value).isNull()).select(*place)
    mean = offsets(df, value, keys, ORDER).join(holes, place, "left_semi").groupBy(*place).agg(F.avg("lent").alias("mean"))
    return df.join(mean, place, "left").withColumn(value, F.coalesce(value, "mean")).drop("mean")


def propagate(df: DataFrame, value: str, keys: list[str], rounds: int | None = None) -> DataFrame:
    """Nearest propagation: in each round a missing cell takes its first known neighbour in the fixed order.

    Without ``rounds`` it goes on until a round fills nothing; each round then ends the lineage.
    """
    place = [*keys, "row", "col"]
    missing, done = None, 0
    while rounds is None or done < rounds:
        if rounds is None or done:
            df = cut(df)  # a round reads its input twice
        if rounds is None:
            before, missing = missing, df.where(F.col(value).isNull()).count()
            if missing in (0, before):
                break
        lent = offsets(df, value, keys, ORDER).groupBy(*place).agg(F.min_by("lent", "rank").alias("lent"))
        df = df.join(lent, place, "left").withColumn(value, F.coalesce(value, "lent")).drop("lent")
        done += 1
    return df


def inverse_distance_fill(df: DataFrame, value: str, keys: list[str], reach: int) -> DataFrame:
    """Missing cells take the mean of the known cells up to ``reach`` cells away, weighted by 1 / distance^2.

    Each hole goes to the 9 buckets of ``reach`` cells around its own and meets the known cells there.
    """
    place = [*keys, "row", "col"]
    holes = df.where(F.col(value).isNull()).select(*place).withColumn("br", _near_buckets("row", reach)).withColumn("bc", _near_buckets("col", reach))
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col("row").alias("kr"), F.col("col").alias("kc"), F.col(value).alias("lent"))
    known = known.withColumn("br", F.floor(F.col("kr") / reach)).withColumn("bc", F.floor(F.col("kc") / reach))
    dr, dc = F.col("row").cast("long") - F.col("kr"), F.col("col").cast("long") - F.col("kc")
    pairs = holes.join(known, [*keys, "br", "bc"]).withColumn("d2", dr * dr + dc * dc).where(F.col("d2").between(1, reach * reach)).withColumn("w", 1.0 / F.col("d2"))
    w = pairs.groupBy(*place).agg((F.sum(F.col("w") * F.col("lent")) / F.sum("w")).alias("idw"))
    return df.join(w, place, "left").withColumn(value, F.coalesce(value, "idw")).drop("idw")


def mean_fill(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """What is still missing takes the mean of its group, or 0 where the group has no value."""
    mean = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.avg(value).alias("_mean"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(mean, on, "left").withColumn(value, F.coalesce(value, "_mean", F.lit(0.0))).select(*df.columns)


def impute(df: DataFrame, value: str, keys: list[str], reach: int = 100, rounds: int | None = None) -> DataFrame:
    """The whole chain: 3x3 mean, inverse distance (if reach > 0), nearest propagation (until stable without ``rounds``), mean; stage names the step that filled a cell.

    Every stage begins at a checkpoint, so df itself is read once whatever the number of stages and rounds.
    """
    out = df.withColumn("stage", F.when(F.col(value).isNotNull(), F.lit("observed")))
    chain = [("kernel", lambda x: focal_fill(x, value, keys)), *([("distance", lambda x: inverse_distance_fill(x, value, keys, reach))] if reach else []), ("nearest", lambda x: propagate(x, value, keys, rounds)), ("mean", lambda x: mean_fill(x, value, keys))]
    for name, step in chain:
        out = step(cut(out))  # a stage reads its input up to three times
        out = out.withColumn("stage", F.when(F.col("stage").isNull() & F.col(value).isNotNull(), F.lit(name)).otherwise(F.col("stage")))
    return out
