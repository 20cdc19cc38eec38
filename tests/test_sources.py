"""Raster files and cubes: round trips, windows, spans and faults."""

import struct
import zlib
from datetime import date

import numpy as np
import pytest

from celldays.operators.grid import Grid, rasterise
from celldays.sources import cubes as CU
from celldays.sources import rasters as RA

G = Grid(10.0, 50.0, 0.5, 5, 7)


def raster():
    x = np.arange(70, dtype=float).reshape(2, 5, 7)
    x[0, 1, 2] = np.nan
    return x


def test_geotiff_files(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(RA.tiff_bytes(raster(), G, ["one", "two"], lines=2))
    (tmp_path / "b.txt").write_text("other")
    rows = RA.raster_rows(RA.files(spark, str(tmp_path), "*.tif")).collect()
    got = {(r["band"], r["row"], r["col"]): (r["value"], r["x"], r["y"]) for r in rows}
    x = raster()
    assert len(rows) == 70 and got["one", 1, 2][0] is None and got["two", 4, 6] == (69.0, 13.25, 47.75)
    assert all(got[b, r, c][0] == x[i, r, c] for i, b in enumerate(("one", "two")) for r in range(5) for c in range(7) if not np.isnan(x[i, r, c]))
    box = (10.6, 48.1, 11.9, 49.4)
    some = {(r["band"], r["row"], r["col"]) for r in RA.raster_rows(RA.files(spark, str(tmp_path), "*.tif"), box).collect()}
    assert some == {k for k, v in got.items() if box[0] <= v[1] <= box[2] and box[1] <= v[2] <= box[3]} and some
    assert RA.raster_rows(RA.files(spark, str(tmp_path), "*.tif"), (0, 0, 1, 1)).collect() == []


def test_tiles_with_differencing_and_refusals():
    """Two 16 x 16 big-endian tiles of 16-bit integers over an image of 16 x 20, differenced and deflated."""
    x = np.random.default_rng(1).integers(-500, 500, (16, 32)).astype(">i2")
    tiles = [zlib.compress(np.diff(x[:, c : c + 16], axis=1, prepend=0).astype(">i2").tobytes()) for c in (0, 16)]
    at = [8, 8 + len(tiles[0])]
    begin = at[1] + len(tiles[1])
    tags = [(256, "I", [20]), (257, "I", [16]), (258, "H", [16]), (259, "H", [8]), (317, "H", [2]), (322, "I", [16]), (323, "I", [16]), (324, "I", at), (325, "I", list(map(len, tiles))), (339, "H", [2]), (33550, "d", [1.0, 1.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 5.0, 9.0, 0.0])]

    def image(tags):
        entries, tail, free = b"", b"", begin + 2 + 12 * len(tags) + 4
        for tag, kind, v in tags:
            raw = struct.pack(f">{len(v)}{kind}", *v)
            entries += struct.pack(">HHI", tag, {"I": 4, "H": 3, "d": 12}[kind], len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", free + len(tail)))
            tail += raw if len(raw) > 4 else b""
        return b"MM" + struct.pack(">HI", 42, begin) + b"".join(tiles) + struct.pack(">H", len(tags)) + entries + b"\0" * 4 + tail

    t = RA.Tiff(image(tags))
    got = np.zeros((16, 20))
    for _, r, c, v in t.blocks():
        got[r : r + v.shape[1], c : c + v.shape[2]] = v[0]
    assert (got == x[:, :20]).all() and (t.x0, t.y0, t.names) == (5.0, 9.0, ["band_1"])
    with pytest.raises(ValueError):
        RA.Tiff(image([x if x[0] != 259 else (259, "H", [5]) for x in tags]))
    with pytest.raises(ValueError):
        RA.Tiff(b"PNG")


def test_netcdf_files(spark, tmp_path):
    days = np.array([(date(2020, 2, 27) - date(2020, 1, 1)).days + i for i in range(5)], float)
    v = np.arange(5 * 2 * 3, dtype=float).reshape(5, 2, 3)
    v[1, 1, 1] = np.nan
    (tmp_path / "x.nc").write_bytes(RA.netcdf_bytes({"time": days, "lat": np.array([40.0, 41.0]), "lon": np.array([1.0, 2.0, 3.0])}, {"tmmx": v, "other": v * 2}, {"time": "days since 2020-01-01 00:00"}))
    f = RA.files(spark, str(tmp_path))
    rows = RA.netcdf_rows(f, {"tmmx": "tmax", "absent": "gone"}, chunk=2).collect()
    got = {(r["day"], r["lat"], r["lon"]): r["tmax"] for r in rows}
    assert len(rows) == 30 and got[date(2020, 2, 28), 41.0, 2.0] is None and got[date(2020, 3, 2), 41.0, 3.0] == 29.0 and {r["gone"] for r in rows} == {None}
    part = RA.netcdf_rows(f, {"other": "o"}, chunk=1, first=date(2020, 2, 28), last=date(2020, 2, 29)).collect()
    assert {r["day"] for r in part} == {date(2020, 2, 28), date(2020, 2, 29)} and max(r["o"] or 0 for r in part) == 34.0
    both = RA.merged([RA.netcdf_rows(f, {"tmmx": "a"}, last=date(2020, 2, 28)), RA.netcdf_rows(f, {"other": "b"}, first=date(2020, 2, 28))], ["day", "lat", "lon"])
    assert both.count() == 30 and both.where("a is not null and b is not null").count() == 5
    with pytest.raises(ValueError):
        RA.Netcdf(b"\x89HDF")


def test_scaled_fixed_variable():
    name = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    about = struct.pack(">ii", 12, 3) + b"".join(name(n) + struct.pack(">iid", 6, 1, v) for n, v in (("scale_factor", 0.5), ("add_offset", 10.0), ("missing_value", -1.0)))
    head = lambda at: b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 1) + name("x") + struct.pack(">i", 3) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 1) + name("v") + struct.pack(">ii", 1, 0) + about + struct.pack(">iii", 3, 8, at)
    got = RA.Netcdf(head(len(head(0))) + struct.pack(">hhhxx", 4, -1, 6)).values("v")
    assert got[0] == 12.0 and np.isnan(got[1]) and got[2] == 13.0


def test_cube_keeps_its_shape(spark, tmp_path):
    schema = "feature string, day date, row int, col int, value double"
    d = [date(2020, 1, k) for k in (1, 2)]
    rows = [("aet", d[0], 0, 0, 1.0), ("aet", d[1], 4, 6, float("nan")), ("fwi", d[0], 2, 2, None), ("fwi", d[1], 2, 2, 3.0)]
    cube = spark.createDataFrame(rows, schema)
    CU.write_cube(cube, f"{tmp_path}/c", G, 2, {"unit": "mm"})
    t, g, about = CU.read_cube(spark, f"{tmp_path}/c", ["aet"], zero=True)
    assert g == G and about == {"unit": "mm"} and sorted((r["row"], r["value"]) for r in t.collect()) == [(0, 1.0), (4, 0.0)]
    for bad in ([("aet", d[0], 5, 0, 1.0)], [("aet", d[0], None, 0, 1.0)], [("aet", d[0], 0, 0, 1.0)] * 2, [("aet", d[0], 0, 0, 1.0)]):
        with pytest.raises(ValueError):
            CU.checked(spark.createDataFrame(bad, schema), G, 2)
    CU.checked(cube.limit(0), G, 2)


def test_rasterise_against_brute_force(spark):
    rng = np.random.default_rng(2)
    day = lambda: None if rng.random() < 0.1 else date(2020, int(rng.integers(1, 4)), int(rng.integers(1, 3)))
    pts = [(float(rng.uniform(9, 14)), float(rng.uniform(47, 51)), day(), *(None if rng.random() < 0.1 else float(rng.choice([1.0, 2.5, np.nan, np.inf, 7.0])) for _ in range(2))) for _ in range(300)] + [(None, 49.0, None, 1.0, 1.0)]
    df = spark.createDataFrame(pts, "x double, y double, day date, a double, b double").selectExpr("*", "1 as row", "2 as kind")
    got = {tuple(r)[:-1]: r["value"] for r in rasterise(df, G, "x", "y", "day", ["a"], ["a", "b"], ["b"]).collect()}
    want = {}
    for x, y, d, a, b in pts:
        if x is None:
            continue
        r, c = int(np.floor((50 - y) / 0.5)), int(np.floor((x - 10) / 0.5))
        if not (0 <= r < 5 and 0 <= c < 7):
            continue
        for kind, f, v, dd, m in (("dynamic", "a", a, d, None), ("static", "a", a, None, None), ("static", "b", b, None, None), ("monthly", "b", b, None, d and d.month)):
            if v is not None and np.isfinite(v) and (kind == "static" or d):
                want.setdefault((kind, f, dd, m, r, c), []).append(v)
    assert got.keys() == want.keys() and all(abs(got[k] - np.mean(v)) < 1e-9 for k, v in want.items())
