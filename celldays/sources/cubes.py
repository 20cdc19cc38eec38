"""Feature cubes as long Parquet tables (feature, day, row, col, value) with a manifest of their shape.

A dynamic cube has a value per feature, day and cell, a static one per feature and cell (day null). Values that aren't stored are missing. Both sink and reader
check the shape; a violation is an error that names the rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celldays.operators.grid import Grid, inside

KEY = ["feature", "day", "row", "col"]


def faults(cube: DataFrame, g: Grid, days: int | None = None) -> DataFrame:
    """(fault, n): cells outside the grid, repeated places, and features whose number of days is not ``days``; no rows for a sound cube."""
    n = F.count(F.lit(1)).alias("n")
    out = cube.where(~F.coalesce(inside(g), F.lit(False))).agg(n).select(F.lit("outside").alias("fault"), "n")
    twice = cube.groupBy(*KEY).agg(n).where("n > 1").agg(n).select(F.lit("repeated").alias("fault"), "n")
    out = out.unionByName(twice)
    if days is not None:
        wrong = cube.groupBy("feature").agg(F.count_distinct("day").alias("d")).where(F.col("d") != days).agg(n)
        out = out.unionByName(wrong.select(F.lit("days").alias("fault"), "n"))
    return out.where("n > 0")


def checked(cube: DataFrame, g: Grid, days: int | None = None) -> None:
    bad = [f"{r['fault']}: {r['n']}" for r in faults(cube, g, days).collect()]
    if bad:
        raise ValueError("cube does not fit its shape (" + ", ".join(bad) + ")")


def write_cube(cube: DataFrame, path: str, g: Grid, days: int | None = None, attributes: dict | None = None) -> None:
    """Checks the cube and writes it by feature, with its grid, number of days and attributes as manifest."""
    checked(cube, g, days)
    cube.select(*KEY, F.col("value").cast("float")).write.mode("overwrite").partitionBy("feature").parquet(f"{path}/values")
    about = {"x_min": g.x_min, "y_max": g.y_max, "cell": g.cell, "rows": g.rows, "cols": g.cols, "days": days, "attributes": json.dumps(attributes or {}, sort_keys=True)}
    cube.sparkSession.createDataFrame([tuple(about.values())], "x_min double, y_max double, cell double, rows int, cols int, days int, attributes string").write.mode("overwrite").json(f"{path}/manifest")


def read_cube(spark: SparkSession, path: str, names: list[str] | None = None, zero: bool = False) -> tuple[DataFrame, Grid, dict]:
    """The checked cube, its grid and attributes; names reads only those features' files, zero turns NaN and null values into 0."""
    m = spark.read.schema("x_min double, y_max double, cell double, rows int, cols int, days int, attributes string").json(f"{path}/manifest").first()
    g = Grid(m["x_min"], m["y_max"], m["cell"], m["rows"], m["cols"])
    cube = spark.read.parquet(f"{path}/values").select(F.col("feature").cast("string").alias("feature"), "day", "row", "col", "value")
    cube = cube.where(F.col("feature").isin(names)) if names else cube
    checked(cube, g, m["days"])
    if zero:
        cube = cube.withColumn("value", F.coalesce(F.nanvl("value", F.lit(0.0).cast("float")), F.lit(0.0).cast("float")))
    return cube, g, json.loads(m["attributes"])
