"""Placing observations on a fixed cell grid: affine indices, means per cell, spines.

A cell-day cube is always a sparse long table (day, row, col, value); a dense spine is made only where an operator needs
one. Means are partial sums and counts combined on the map side, so a hot cell costs one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Origin, cell size and shape; row 0 is the northernmost."""

    x_min: float
    y_max: float
    cell: float
    rows: int
    cols: int


def cell_of(x: Column, y: Column, g: Grid) -> dict[str, Column]:
    return {"row": F.floor((F.lit(g.y_max) - y) / g.cell).cast("int"), "col": F.floor((x - g.x_min) / g.cell).cast("int")}


def inside(g: Grid) -> Column:
    return F.col("row").between(0, g.rows - 1) & F.col("col").between(0, g.cols - 1)


def place(df: DataFrame, x: str, y: str, g: Grid) -> DataFrame:
    """Rows of known coordinates inside the grid with their row and col; pushes the bounds to the scan as ranges of x and y."""
    near = F.col(x).between(g.x_min, g.x_min + g.cell * g.cols) & F.col(y).between(g.y_max - g.cell * g.rows, g.y_max)
    return df.where(near).withColumns(cell_of(F.col(x), F.col(y), g)).where(inside(g))


def flat(row: Column, col: Column, cols: int) -> Column:
    return row * cols + col


def unflat(i: Column, cols: int) -> tuple[Column, Column]:
    return F.floor(i / cols).cast("int"), (i % cols).cast("int")


def mean_per(df: DataFrame, keys: list[str], value: str, name: str = "value") -> DataFrame:
    """Mean of the finite values of each key: cell and day, cell, or cell and month."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).groupBy(*keys).agg(F.avg(v).alias(name))


def spine(cells: DataFrame, first: str, last: str) -> DataFrame:
    """Every cell on every day from first to last: each cell generates its own calendar, so no join is needed."""
    return cells.withColumn("day", F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))))


def full_grid(days: DataFrame, g: Grid) -> DataFrame:
    """Every cell of the grid on each given day."""
    return days.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(g.rows * g.cols - 1)))).select("*", *(c.alias(n) for c, n in zip(unflat(F.col("i"), g.cols), ("row", "col"), strict=True))).drop("i")


def expand_months(monthly: DataFrame, days: DataFrame) -> DataFrame:
    """A monthly climatology on each day of the calendar (at most a few thousand rows)."""
    return monthly.join(F.broadcast(days.withColumn("month", F.month("day"))), "month")


def albers(lon: Column, lat: Column, lat1: float, lat2: float, lat0: float, lon0: float, radius: float = 6371007.0) -> tuple[Column, Column]:
    """Spherical Albers equal-area coordinates as expressions; the parameters come from grid metadata."""
    from math import cos, radians, sin, sqrt

    n = (sin(radians(lat1)) + sin(radians(lat2))) / 2
    c = cos(radians(lat1)) ** 2 + 2 * n * sin(radians(lat1))
    rho0 = radius * sqrt(c - 2 * n * sin(radians(lat0))) / n
    rho, theta = radius * F.sqrt(c - 2 * n * F.sin(F.radians(lat))) / n, n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def rasterise(points: DataFrame, g: Grid, x: str, y: str, day: str, dynamic: list[str] = (), static: list[str] = (), monthly: list[str] = ()) -> DataFrame:
    """(kind, feature, day, month, row, col, value): all layers of observations in one call and one pass.

    Dynamic features are averaged per cell and day, static ones per cell, monthly ones per cell and month of the year. Points are reduced to sums per cell and day first,
    from which all three follow, so the observations are shuffled once. Points outside the grid, without coordinates or without a day (but for static features) don't
    count, nor do null, NaN and infinite values.
    """
    names = list(dict.fromkeys([*dynamic, *static, *monthly]))
    v = {c: F.col(c).cast("double") for c in names}
    good = {c: F.when(~F.isnan(v[c]) & (F.abs(v[c]) < float("inf")), v[c]) for c in names}
    daily = place(points, x, y, g).groupBy("row", "col", F.to_date(day).alias("day")).agg(*(F.sum(good[c]).alias(f"s_{c}") for c in names), *(F.count(good[c]).alias(f"n_{c}") for c in names))
    none = {"day": F.lit(None).cast("date"), "month": F.lit(None).cast("int")}
    layers = F.array(*(
        F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("feature"), *(held.get(k, e).alias(k) for k, e in none.items()), F.col(f"s_{c}").alias("s"), F.col(f"n_{c}").alias("n"))
        for kind, wanted, held in (("dynamic", dynamic, {"day": F.col("day")}), ("static", static, {}), ("monthly", monthly, {"month": F.month("day")})) for c in wanted
    ))
    rows = daily.select("row", "col", F.inline(layers)).where("n > 0 and (kind = 'static' or day is not null or month is not null)")
    return rows.groupBy("kind", "feature", "day", "month", "row", "col").agg((F.sum("s") / F.sum("n")).alias("value"))
