"""NetCDF grids in files of bounded size, and files of several variables merged side by side."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.errors import PythonException

from celldays.sources import rasters as RA

DAY = date(2020, 1, 1)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_long_grid_in_parts(spark):
    """A year of 40 x 45 places, of which few have a row: no file holds the year, together they hold every place."""
    rows = [(2020, DAY + timedelta(i), float(i % 40), float(i % 45), float(i)) for i in range(366)]
    found = RA.to_netcdfs(spark.createDataFrame(rows, "y int, day date, lat double, lon double, v double"), ["y"], ["v"])
    sizes = [len(r["content"]) for r in found.select("content").collect()]
    assert max(sizes) < 8 * RA.BATCH + 10_000 and sum(sizes) > 8 * 366 * 40 * 45
    got = RA.netcdf_rows(found, {"v": "v"})
    assert got.count() == got.select("day", "lat", "lon").distinct().count() == 366 * 40 * 45
    assert plain(got.where("v is not null")) == sorted((r[1:] for r in rows), key=str)


def test_keys_axes_and_missing_coordinates(spark):
    """Keys, one of them null, have axes of their own; given axes may reach beyond the rows, rows not beyond them."""
    schema = "k string, day date, lat double, lon double, v double, w double"
    rows = [("a", DAY, 1.0, 5.0, 1.0, None), ("a", DAY + timedelta(9), 2.0, 6.0, 2.0, 3.0), (None, DAY, 7.0, 8.0, 4.0, 5.0), ("a", None, 3.0, 5.0, 9.0, 9.0), ("a", DAY, None, 5.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, schema)
    for most in (1, 4, 1000):
        files = RA.to_netcdfs(df, ["k"], {"f": ["v"], "g": ["w"]}, most=most)
        assert files.columns == ["k", "part", "f", "g"] and files.count() == (2 if most == 1000 else 3)
        got = plain(RA.netcdf_merged(files, {"f": {"v": "v"}, "g": {"w": "w", "none": "gone"}}))
        want = {(DAY + timedelta(d), y, x): (None, None) for d in (0, 9) for y in (1.0, 2.0) for x in (5.0, 6.0)} | {tuple(r[1:4]): r[4:] for r in rows if None not in r[1:4]}
        assert got == sorted(((*k, *v, None) for k, v in want.items()), key=str)
    more = spark.createDataFrame([*rows, ("a", DAY + timedelta(20), 4.0, 5.0, None, None)], schema)
    assert RA.netcdf_rows(RA.to_netcdfs(df, ["k"], ["v"], more, most=6), {"v": "v"}).count() == 3 * 3 * 2 + 1
    for bad in (df.where("lat < 2"), df.where("k is null")):
        with pytest.raises(PythonException, match="beyond the axes"):
            RA.to_netcdfs(df, ["k"], ["v"], bad).collect()
    assert RA.to_netcdfs(df.limit(0), ["k"], ["v"]).collect() == []


def test_files_of_other_axes_as_joined(spark):
    """Merged side by side, files give what the full join of their rows gives."""
    rng = np.random.default_rng(3)

    def content(name, days, lat, lon):
        v = rng.integers(0, 50, (len(days), len(lat), len(lon))).astype(float)
        v[rng.random(v.shape) < 0.2] = np.nan
        return bytearray(RA.netcdf_bytes({"time": np.array(days, float), "lat": np.array(lat, float), "lon": np.array(lon, float)}, {name: v}, {"time": "days since 2020-01-01"}))

    pairs = [
        (content("a", range(5), [3, 2, 1], [1, 2]), content("b", range(3, 9), [1, 2, 5], [2, 0, 7])),
        (content("a", [20, 22], [1], [1]), None),
        (None, content("b", [30], [1, 2], [1])),
        (None, None),
        (content("a", [41, 40], [1], [1, 2]), content("b", [40], [1], [1, 2])),
    ]
    files = spark.createDataFrame(pairs, "one binary, two binary")
    parts = [RA.netcdf_rows(files.selectExpr(f"{c} as content"), {v: v}) for c, v in (("one", "a"), ("two", "b"))]
    want = plain(RA.merged(parts, ["day", "lat", "lon"]))
    for chunk in (1, 4, 30):
        assert plain(RA.netcdf_merged(files, {"one": {"a": "a"}, "two": {"b": "b"}}, chunk=chunk)) == want and len(want) > 80
    twice = spark.createDataFrame([(content("a", [1, 1], [1], [1]), None)], "one binary, two binary")
    with pytest.raises(PythonException, match="repeated"):
        RA.netcdf_merged(twice, {"one": {"a": "a"}, "two": {"b": "b"}}).collect()


def test_files_spread_over_tasks(spark):
    """Many files are written by more tasks than the session has shuffle partitions, so that a task holds few of them."""
    rows = [(2020, DAY + timedelta(i), float(i % 3), 1.0, float(i)) for i in range(200)]
    found = RA.to_netcdfs(spark.createDataFrame(rows, "y int, day date, lat double, lon double, v double"), ["y"], ["v"], most=3)
    assert found.count() == 200 and found.rdd.getNumPartitions() == 200 // RA.FILES
    assert RA.netcdf_rows(found, {"v": "v"}).where("v is not null").count() == 200
