"""Rasters in files: classic NetCDF grids and GeoTIFF bands as rows, and the same formats as binary columns.

Files come as (path, content), as Spark's binaryFile source gives them, so a file is one row and files are read in parallel. A NetCDF grid is decoded
by spans of time steps and a GeoTIFF by strips or tiles, of which only those that meet the wanted span or window are decompressed; a batch is never larger than one
span or block of lines. NetCDF: versions 1, 2 and 5, fixed and record variables. GeoTIFF: strips and tiles, no compression or deflate, horizontal
differencing, integers and floats of 8 to 64 bits. Other forms raise an error that names them.

A fill or nodata value and NaN are null. A null content gives no rows, an empty window or span neither.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from datetime import date
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from celldays.operators.grid import Grid
from celldays.session import cut

# fixed values of the formats: NetCDF types with their sizes, TIFF field types with theirs
NC_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}

#: places of a grid in one written file and rows of a batch read, so that a task's arrays have a few MB
BATCH = 1 << 18
#: files that a task writes on average, where the session's shuffle partitions would be fewer tasks
FILES = 2


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


class Netcdf:
    """Header of a classic NetCDF file; values are read on demand."""

    def __init__(self, content: bytes):
        self.b, self.at = content, 4
        if content[:3] != b"CDF" or content[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.wide, self.far = content[3] == 5, content[3] in (2, 5)
        self.records = self._n()
        self.dims = [(self._name(), self._n()) for _ in range(self._list(10))]
        self.attributes = self._attributes()
        self.variables = {}
        for _ in range(self._list(11)):
            name, ids = self._name(), [self._n() for _ in range(self._n())]
            attributes, kind, size = self._attributes(), self._int(), self._n()
            begin = self._unpack(">q" if self.far else ">i")
            self.variables[name] = (ids, attributes, kind, size, begin)
        held = [v for v in self.variables.values() if self._record(v)]
        one = held[0] if len(held) == 1 else None  # a single record variable is not padded
        self.step = np.dtype(NC_TYPES[one[2]]).itemsize * int(np.prod([self.dims[i][1] for i in one[0][1:]])) if one else sum(v[3] for v in held)

    def _unpack(self, form: str):
        (x,) = struct.unpack_from(form, self.b, self.at)
        self.at += struct.calcsize(form)
        return x

    def _int(self) -> int:
        return self._unpack(">i")

    def _n(self) -> int:
        return self._unpack(">q" if self.wide else ">i")

    def _list(self, tag: int) -> int:
        found, n = self._int(), self._n()
        if n and found != tag:
            raise ValueError("damaged NetCDF header")
        return n

    def _name(self) -> str:
        n = self._n()
        text = self.b[self.at : self.at + n].decode()
        self.at += n + -n % 4
        return text

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list(12)):
            name, kind, n = self._name(), self._int(), self._n()
            size = np.dtype(NC_TYPES[kind]).itemsize * n
            raw = self.b[self.at : self.at + size]
            out[name] = raw.decode() if kind == 2 else np.frombuffer(raw, NC_TYPES[kind])
            self.at += size + -size % 4
        return out

    def _record(self, v) -> bool:
        return bool(v[0]) and self.dims[v[0][0]][1] == 0

    def length(self, name: str) -> int:
        n = dict(self.dims)[name]
        return n or self.records

    def values(self, name: str, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Values of the steps begin..end of the variable's first dimension, scaled, fills as NaN."""
        v = self.variables[name]
        ids, attributes, kind, _, at = v
        shape = [self.dims[i][1] or self.records for i in ids]
        end = shape[0] if end is None else min(end, shape[0])
        per, form = int(np.prod(shape[1:])), np.dtype(NC_TYPES[kind])
        if self._record(v):
            x = np.stack([np.frombuffer(self.b, form, per, at + i * self.step) for i in range(begin, end)]) if end > begin else np.empty((0, per), form)
        else:
            x = np.frombuffer(self.b, form, max(0, end - begin) * per, at + begin * per * form.itemsize)
        x = x.reshape(-1, *shape[1:]).astype(float)
        for fill in ("_FillValue", "missing_value"):
            if fill in attributes:
                x = np.where(x == float(attributes[fill][0]), np.nan, x)
        one = lambda k, d: float(attributes[k][0]) if k in attributes else d
        return x * one("scale_factor", 1.0) + one("add_offset", 0.0)


def _days(nc: Netcdf, time: str) -> np.ndarray:
    """Days since 1970 of a time axis in days or hours."""
    m = re.match(r"(day|hour)s? since (\d+)-(\d+)-(\d+)", nc.variables[time][1]["units"])
    if not m:
        raise ValueError("a time axis is in days or hours since a date")
    start = date(*map(int, m.groups()[1:])).toordinal() - date(1970, 1, 1).toordinal()
    return np.floor(start + nc.values(time) / (1 if m[1] == "day" else 24)).astype(np.int32)


def _steps(chunk: int, places: int) -> int:
    """Time steps of a batch: ``chunk``, fewer where a grid has many places."""
    return min(chunk, max(1, BATCH // max(1, places)))


def _columns(days: np.ndarray, y: np.ndarray, x: np.ndarray, values: list[np.ndarray], ok: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """The wanted places of a block of steps as rows, NaN as null."""
    n = len(y) * len(x)
    grid = [np.repeat(days, n)[ok], np.tile(np.repeat(y, len(x)), len(days))[ok], np.tile(x, len(days) * len(y))[ok]]
    arrays = [pa.array(grid[0]).cast(pa.date32()), pa.array(grid[1]), pa.array(grid[2]), *(pa.array(c[ok], mask=np.isnan(c[ok])) for c in values)]
    return pa.RecordBatch.from_arrays(arrays, ["day", "lat", "lon", *names])


def netcdf_rows(found: DataFrame, variables: dict[str, str], time: str = "time", lat: str = "lat", lon: str = "lon", chunk: int = 30, first: date | None = None, last: date | None = None) -> DataFrame:
    """(day, lat, lon, one column per variable) of gridded files; variables: name in the file to column, absent ones are null.

    Only the time steps between first and last (inclusive) are decoded, ``chunk`` of them at a time, fewer where the grid is large.
    """
    names = list(variables.values())
    low, high = (d and d.toordinal() - date(1970, 1, 1).toordinal() for d in (first, last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                if content.as_py() is None:
                    continue
                nc = Netcdf(content.as_py())
                days, y, x = _days(nc, time), nc.values(lat), nc.values(lon)
                wanted = (days >= (low if low is not None else days.min(initial=0))) & (days <= (high if high is not None else days.max(initial=0)))
                keep, n = np.flatnonzero(wanted), len(y) * len(x)
                if not len(keep):
                    continue
                step = _steps(chunk, n)
                for i in range(int(keep[0]), int(keep[-1]) + 1, step):
                    j = min(i + step, int(keep[-1]) + 1)
                    columns = [nc.values(v, i, j).ravel() if v in nc.variables else np.full((j - i) * n, np.nan) for v in variables]
                    yield _columns(days[i:j], y, x, columns, np.repeat(wanted[i:j], n), names)

    return found.select("content").mapInArrow(run, "day date, lat double, lon double, " + ", ".join(f"`{c}` double" for c in names))


def netcdf_merged(found: DataFrame, files: dict[str, dict[str, str]], time: str = "time", lat: str = "lat", lon: str = "lon", chunk: int = 30) -> DataFrame:
    """(day, lat, lon, one column per variable) of files that lie side by side in a row, as ``merged`` gives them, without a join of their places.

    files: column of contents to the variables wanted of it (name in the file to column). The files of a row may have other axes than each other: every place of any of
    them is kept, what a file lacks is null. No other row may hold the same places, as with one row per span of time. Repeated days or coordinates in a file are refused.
    """
    names = [c for wanted in files.values() for c in wanted.values()]

    def aligned(contents: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        got = []
        for content, wanted in zip(contents, files.values(), strict=True):
            nc = None if content is None else Netcdf(content)
            axes = [np.empty(0)] * 3 if nc is None else [_days(nc, time), nc.values(lat), nc.values(lon)]
            if any(len(np.unique(a)) < len(a) for a in axes):
                raise ValueError("a file with repeated days or coordinates can't be merged")
            got.append((nc, axes, wanted))
        days, y, x = (np.unique(np.concatenate([axes[k] for _, axes, _ in got])) for k in range(3))
        days, step = days.astype(np.int32), _steps(chunk, len(y) * len(x))
        for i in range(0, len(days), step):
            block = days[i : i + step]
            shape, columns = (len(block), len(y), len(x)), []
            held = np.zeros(shape, bool)
            for nc, axes, wanted in got:
                own = np.flatnonzero(np.isin(axes[0], block))
                at = np.ix_(np.searchsorted(block, axes[0][own]), np.searchsorted(y, axes[1]), np.searchsorted(x, axes[2]))
                held[at] = True
                for v in wanted:
                    column = np.full(shape, np.nan)
                    if len(own) and v in nc.variables:
                        begin = int(own.min())
                        column[at] = nc.values(v, begin, int(own.max()) + 1)[own - begin]
                    columns.append(column.ravel())
            yield _columns(block, y, x, columns, held.ravel(), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from aligned([b.column(k)[i].as_py() for k in range(len(files))])

    return found.select(*files).mapInArrow(run, "day date, lat double, lon double, " + ", ".join(f"`{c}` double" for c in names))


def merged(parts: list[DataFrame], on: list[str]) -> DataFrame:
    """Tables of different variables side by side, every coordinate of any of them kept."""
    return reduce(lambda a, b: a.join(b, on, "full"), parts)


class Tiff:
    """First image of a TIFF file: shape, place and the blocks it is stored in."""

    def __init__(self, content: bytes):
        self.b = content
        if content[:2] not in (b"II", b"MM") or struct.unpack(("<" if content[:2] == b"II" else ">") + "H", content[2:4])[0] != 42:
            raise ValueError("not a TIFF file")
        self.order = "<" if content[:2] == b"II" else ">"
        (at,) = struct.unpack_from(self.order + "I", content, 4)
        (n,) = struct.unpack_from(self.order + "H", content, at)
        self.tags = dict(self._tag(at + 2 + 12 * i) for i in range(n))
        self.cols, self.rows, self.bands = self.tags[256][0], self.tags[257][0], self.tags.get(277, (1,))[0]
        self.planar = self.tags.get(284, (1,))[0] == 2 and self.bands > 1
        self.packing, self.predictor = self.tags.get(259, (1,))[0], self.tags.get(317, (1,))[0]
        if self.packing not in (1, 8, 32946) or self.predictor not in (1, 2):
            raise ValueError(f"TIFF compression {self.packing} with predictor {self.predictor} is not read")
        self.form = np.dtype(f"{self.order}{'?uif'[self.tags.get(339, (1,))[0]]}{self.tags[258][0] // 8}")
        tiled = 324 in self.tags
        self.height, self.width = (self.tags[323][0], self.tags[322][0]) if tiled else (min(self.tags.get(278, (self.rows,))[0], self.rows), self.cols)
        self.offsets, self.sizes = self.tags[324 if tiled else 273], self.tags[325 if tiled else 279]
        self.tiled = tiled
        (self.dx, self.dy), (i, j, _, x, y, _) = self.tags[33550][:2], self.tags[33922][:6]
        self.x0, self.y0 = x - i * self.dx, y + j * self.dy
        text = self.tags.get(42113, "").strip("\0 ")
        self.nodata = float(text) if text else None
        found = dict(re.findall(r'sample="(\d+)" role="description">([^<]*)<', self.tags.get(42112, "")))
        self.names = [found.get(str(i), f"band_{i + 1}") for i in range(self.bands)]

    def _tag(self, at: int) -> tuple[int, tuple | str]:
        tag, kind, n = struct.unpack_from(self.order + "HHI", self.b, at)
        if kind not in TIFF_TYPES:
            return tag, ()
        form = f"{self.order}{n}{TIFF_TYPES[kind]}"
        size = struct.calcsize(form)
        place = at + 8 if size <= 4 else struct.unpack_from(self.order + "I", self.b, at + 8)[0]
        got = struct.unpack_from(form, self.b, place)
        return tag, got[0].decode(errors="replace") if kind == 2 else got

    def window(self, box: tuple[float, float, float, float] | None) -> tuple[int, int, int, int]:
        """First and last + 1 row and column whose centres lie in (x_min, y_min, x_max, y_max)."""
        if box is None:
            return 0, self.rows, 0, self.cols
        rows, cols = self.y0 - (np.arange(self.rows) + 0.5) * self.dy, self.x0 + (np.arange(self.cols) + 0.5) * self.dx
        r, c = np.flatnonzero((rows >= box[1]) & (rows <= box[3])), np.flatnonzero((cols >= box[0]) & (cols <= box[2]))
        return (int(r[0]), int(r[-1]) + 1, int(c[0]), int(c[-1]) + 1) if len(r) and len(c) else (0, 0, 0, 0)

    def blocks(self, box=None) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(first band, first row, first column, values by band, row and column) of the blocks that meet the window, cut to it."""
        top, bottom, left, right = self.window(box)
        down, across = -(-self.rows // self.height), -(-self.cols // self.width)
        for k in range(len(self.offsets) if bottom > top else 0):
            plane, place = divmod(k, down * across)
            r, c = place // across * self.height, place % across * self.width
            if r >= bottom or r + self.height <= top or c >= right or c + self.width <= left:
                continue
            raw = self.b[self.offsets[k] : self.offsets[k] + self.sizes[k]]
            raw = raw if self.packing == 1 else zlib.decompress(raw)
            n, lines = 1 if self.planar else self.bands, self.height if self.tiled else min(self.height, self.rows - r)
            x = np.frombuffer(raw, self.form, lines * self.width * n).reshape(lines, self.width, n)
            if self.predictor == 2:
                x = np.cumsum(x, axis=1, dtype=x.dtype)
            r0, r1, c0, c1 = max(r, top), min(r + lines, bottom), max(c, left), min(c + self.width, right)
            yield plane if self.planar else 0, r0, c0, np.moveaxis(x[r0 - r : r1 - r, c0 - c : c1 - c], 2, 0)


def raster_rows(found: DataFrame, box: tuple[float, float, float, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(kept columns, band, row, col, x, y, value) of the pixels whose centres lie in the box (x_min, y_min, x_max, y_max), all without one."""
    keep = keep if keep is not None else ["path"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in found.select(*keep).dtypes), "band string, row int, col int, x double, y double, value double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                content = b.column(len(keep))[i].as_py()
                if content is None:
                    continue
                t = Tiff(content)
                for first, r, c, x in t.blocks(box):
                    for k, v in enumerate(x.astype(float)):
                        rows, cols = np.repeat(np.arange(r, r + v.shape[0], dtype=np.int32), v.shape[1]), np.tile(np.arange(c, c + v.shape[1], dtype=np.int32), v.shape[0])
                        gone = np.isnan(v.ravel()) | (v.ravel() == t.nodata if t.nodata is not None else False)
                        own = [b.column(j).take(pa.array(np.full(len(rows), i))) for j in range(len(keep))]
                        yield pa.RecordBatch.from_arrays([*own, pa.array([t.names[first + k]] * len(rows)), pa.array(rows), pa.array(cols), pa.array(t.x0 + (cols + 0.5) * t.dx), pa.array(t.y0 - (rows + 0.5) * t.dy), pa.array(v.ravel(), mask=gone)], [*keep, "band", "row", "col", "x", "y", "value"])

    return found.select(*keep, "content").mapInArrow(run, schema)


def tiff_bytes(x: np.ndarray, g: Grid, names: list[str], nodata: float = -9999.0, lines: int = 64) -> bytes:
    """A little-endian GeoTIFF of 32-bit floats (band, row, column), one deflated strip per ``lines`` lines, NaN as nodata."""
    bands, rows, cols = x.shape
    data = np.where(np.isnan(x), nodata, x).astype("<f4")
    strips = [zlib.compress(np.moveaxis(data[:, r : r + lines], 0, 2).tobytes()) for r in range(0, rows, lines)]
    about = "<GDALMetadata>" + "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{n}</Item>' for i, n in enumerate(names)) + "</GDALMetadata>"
    at = 8 + np.cumsum([0, *map(len, strips)])
    ints = lambda xs: ("I", list(map(int, xs)))
    tags = {256: ints([cols]), 257: ints([rows]), 258: ("H", [32] * bands), 259: ("H", [8]), 262: ("H", [1]), 273: ints(at[:-1]), 277: ("H", [bands]), 278: ints([lines]), 279: ints(map(len, strips)), 284: ("H", [1]), 339: ("H", [3] * bands), 33550: ("d", [g.cell, g.cell, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, g.x_min, g.y_max, 0.0]), 42112: ("s", about.encode() + b"\0"), 42113: ("s", f"{nodata:g}".encode() + b"\0")}
    begin = int(at[-1]) + int(at[-1]) % 2
    tail, entries, free = b"", b"", begin + 2 + 12 * len(tags) + 4
    code = {v: k for k, v in TIFF_TYPES.items()}
    for tag, (kind, v) in sorted(tags.items()):
        raw = v if kind == "s" else struct.pack(f"<{len(v)}{kind}", *v)
        entries += struct.pack("<HHI", tag, code[kind], len(v))
        if len(raw) <= 4:
            entries += raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<I", free + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
    body = b"II" + struct.pack("<HI", 42, begin) + b"".join(strips)
    return body.ljust(begin, b"\0") + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + tail


def to_tiffs(df: DataFrame, keys: list[str], bands: list[str], g: Grid) -> DataFrame:
    """(keys, content): one GeoTIFF per key of rows (keys, row, col, bands); a grid of fixed size is one task's array. Absent cells are nodata."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = np.full((len(bands), g.rows, g.cols), np.nan)
        for i, c in enumerate(bands):
            x[i, p["row"].to_numpy(), p["col"].to_numpy()] = p[c].to_numpy(float)
        return pd.DataFrame({**{k: [p[k].iloc[0]] for k in keys}, "content": [tiff_bytes(x, g, bands)]})

    near = df.where(F.col("row").between(0, g.rows - 1) & F.col("col").between(0, g.cols - 1)).select(*keys, "row", "col", *bands)
    return near.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {t}" for k, t in df.select(*keys).dtypes), "content binary"]))


def netcdf_bytes(axes: dict[str, np.ndarray], values: dict[str, np.ndarray], units: dict[str, str], fill: float = -9999.0) -> bytes:
    """A classic NetCDF file of doubles with a record axis first: axes in order, values by name over all axes, NaN as fill."""
    names = list(axes)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: struct.pack(">i", len(s.encode())) + pad(s.encode())
    lists = lambda tag, items: struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)

    def attributes(n: str) -> bytes:
        got = [text("units") + struct.pack(">i", 2) + text(units[n])] if n in units else []
        return lists(12, got + ([text("_FillValue") + struct.pack(">iid", 6, 1, fill)] if n in values else []))

    n = len(axes[names[0]])
    arrays = {**axes, **{k: np.where(np.isnan(v), fill, v) for k, v in values.items()}}
    ids = {**{a: [i] for i, a in enumerate(names)}, **{v: list(range(len(names))) for v in values}}
    record = [v for v in arrays if ids[v][0] == 0]
    size = {v: 8 * arrays[v].size // (n if v in record and n else 1) for v in arrays}

    def header(at: dict[str, int]) -> bytes:
        dims = [text(a) + struct.pack(">i", 0 if a == names[0] else len(axes[a])) for a in names]
        items = [text(v) + struct.pack(f">{len(ids[v]) + 1}i", len(ids[v]), *ids[v]) + attributes(v) + struct.pack(">iiq", 6, size[v], at[v]) for v in arrays]
        return b"CDF\x02" + struct.pack(">i", n) + lists(10, dims) + lists(12, []) + lists(11, items)

    free, at = len(header(dict.fromkeys(arrays, 0))), {}
    for v in [*(v for v in arrays if v not in record), *record]:
        at[v], free = free, free + size[v]
    body = b"".join(arrays[v].astype(">f8").tobytes() for v in arrays if v not in record)
    return header(at) + body + b"".join(arrays[v][i : i + 1].astype(">f8").tobytes() for i in range(n) for v in record)


def to_netcdfs(df: DataFrame, keys: list[str], variables: list[str] | dict[str, list[str]], axes: DataFrame | None = None, most: int = BATCH) -> DataFrame:
    """(keys, part, content): NetCDF files per key of rows (keys, day, lat, lon, variables), over the days and coordinates that the key's rows have.

    A key's grid is stored in parts, each of the days that ``most`` places hold (one at least) and of all coordinates of the key, so a task's arrays don't grow with the span
    of a key. variables may name several columns of contents with the variables of each. axes: (keys, day, lat, lon) of the grids where they are cheaper to read
    than from df or reach beyond it; they are reduced to distinct values, one row per key is broadcast. Rows without day or coordinates have no place.
    """
    contents = variables if isinstance(variables, dict) else {"content": variables}
    wanted = list(dict.fromkeys(v for vs in contents.values() for v in vs))
    kinds = [f"`{k}` {t}" for k, t in df.select(*keys).dtypes]
    held = (df if axes is None else axes).select(*keys, "day", "lat", "lon").dropna(subset=["day", "lat", "lon"])
    pairs = (("time", F.unix_date(F.to_date("day"))), ("lat", F.col("lat")), ("lon", F.col("lon")))
    marks = cut(held.select(*(F.col(k).alias(k) for k in keys), F.inline(F.array(*(F.struct(F.lit(a).alias("axis"), v.cast("double").alias("at")) for a, v in pairs)))).distinct())
    count = lambda a: F.sum((F.col("axis") == a).cast("long"))
    spans = marks.groupBy(*keys).agg(F.greatest(F.lit(1).cast("long"), F.floor(most / (count("lat") * count("lon")))).alias("span"))

    def with_part(t: DataFrame, day: Column, how: str) -> DataFrame:
        s = F.broadcast(spans.select(*(F.col(k).alias(f"_{k}") for k in keys), "span"))
        on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
        return t.join(s, on, how).withColumn("part", F.floor(day / F.col("span")))

    days = with_part(marks.where("axis = 'time'"), F.col("at"), "inner").select(*keys, "part", "axis", "at")
    parts = F.broadcast(days.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.collect_set("part").alias("parts")))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    places = marks.where("axis <> 'time'").join(parts, on).select(*keys, F.explode("parts").alias("part"), "axis", "at")

    def run(rows: pd.DataFrame, grid: pd.DataFrame) -> pd.DataFrame:
        at = {a: np.sort(grid["at"].to_numpy(float)[(grid["axis"] == a).to_numpy()]) for a in ("time", "lat", "lon")}
        own = [pd.to_datetime(rows["day"]).to_numpy().astype("datetime64[D]").astype(int).astype(float), rows["lat"].to_numpy(float), rows["lon"].to_numpy(float)]
        if any(not np.isin(v, a).all() for v, a in zip(own, at.values(), strict=True)):
            raise ValueError("rows beyond the axes of their key")
        where = tuple(np.searchsorted(a, v) for v, a in zip(own, at.values(), strict=True))
        values = {c: np.full([len(a) for a in at.values()], np.nan) for c in wanted}
        for c in wanted:
            values[c][where] = rows[c].to_numpy(float)
        files = {name: [netcdf_bytes(at, {v: values[v] for v in vs}, {"time": "days since 1970-01-01"})] for name, vs in contents.items()}
        return pd.DataFrame({**{k: [grid[k].iloc[0]] for k in keys}, "part": [grid["part"].iloc[0]], **files})

    placed = with_part(df.select(*keys, "day", "lat", "lon", *wanted).dropna(subset=["day", "lat", "lon"]), F.unix_date(F.to_date("day")), "left").select(*keys, "part", "day", "lat", "lon", *wanted)
    tasks = days.select(*keys, "part").distinct().count() // FILES
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        placed = placed.repartition(tasks, *keys, "part")
    both = placed.groupBy(*keys, "part").cogroup(days.unionByName(places).groupBy(*keys, "part"))
    return both.applyInPandas(run, ", ".join([*kinds, "part long", *(f"`{c}` binary" for c in contents)]))
