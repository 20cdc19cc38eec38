"""Day-by-day state scans of fire-weather codes.

Cells are hashed to partitions and each partition is sorted by day, so one pass carries the state of all its cells as
vectors: a day's rows are one NumPy step, memory is the state plus one Arrow batch, and long calendars never sit in a list.
A day with a missing input gives missing codes and leaves the state as it is; absent days are not simulated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celldays.functions import fwi
from celldays.functions.backends import NumpyMath

CODES = ["ffmc", "dmc", "dc", "isi", "bui", "fwi"]


class _State:
    """Carried codes by cell number, grown as cells appear."""

    def __init__(self, start: dict[str, float]):
        self.start, self.place, self.codes = start, {}, {k: np.empty(0) for k in start}

    def slots(self, cells: list) -> np.ndarray:
        out = np.fromiter((self.place.setdefault(c, len(self.place)) for c in cells), int, len(cells))
        for k, v in self.codes.items():
            if len(v) < len(self.place):
                self.codes[k] = np.concatenate([v, np.full(max(len(self.place) - len(v), 1024), self.start[k])])
        return out

    def keep(self, at: np.ndarray, new: dict[str, np.ndarray]) -> None:
        for k, v in new.items():
            self.codes[k][at] = np.where(np.isnan(v), self.codes[k][at], v)


def _codes(old: dict[str, np.ndarray], x: dict[str, np.ndarray], month: int) -> dict[str, np.ndarray]:
    """One day of all cells."""
    m, months = NumpyMath, np.full(len(x["temp"]), month)
    ffmc = fwi.daily_ffmc(old["ffmc"], x["temp"], x["rh"], x["wind"], x["precip"], m)
    dmc = fwi.daily_dmc(old["dmc"], x["temp"], x["rh"], x["precip"], months, x["lat"], True, m)
    dc = fwi.daily_dc(old["dc"], x["temp"], x["precip"], months, x["lat"], True, m)
    isi, bui = fwi.daily_isi(x["wind"], ffmc, False, m), fwi.daily_bui(dmc, dc, m)
    return {"ffmc": ffmc, "dmc": dmc, "dc": dc, "isi": isi, "bui": bui, "fwi": fwi.daily_fwi(isi, bui, m)}


INPUTS = ["lat", "temp", "rh", "wind", "precip"]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (cell, day, inputs) in day order; rows of one day are one vector step."""
    state = _State(fwi.START)
    for b in batches:
        days = b.column(1).cast(pa.int32()).to_numpy()
        months = days.astype("datetime64[D]").astype("datetime64[M]").astype(int) % 12 + 1
        at = state.slots(b.column(0).to_pylist())
        x = {c: b.column(i + 2).to_numpy(zero_copy_only=False).astype(float) for i, c in enumerate(INPUTS)}
        out = {c: np.empty(len(days)) for c in CODES}
        edges = [0, *(np.flatnonzero(np.diff(days)) + 1), len(days)]
        with np.errstate(all="ignore"):
            for i, j in zip(edges, edges[1:], strict=False):
                here = at[i:j]
                new = _codes({k: v[here] for k, v in state.codes.items()}, {c: v[i:j] for c, v in x.items()}, months[i])
                state.keep(here, {k: new[k] for k in state.codes})
                for c in CODES:
                    out[c][i:j] = new[c]
        if len(days):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, mask=np.isnan(v)) for v in out.values())], ["cell", "day", *CODES])


def weather_codes(daily: DataFrame) -> DataFrame:
    """(cell, day, ffmc, dmc, dc, isi, bui, fwi) of (cell string, day, lat, temp, rh, wind, precip).

    Rows of one cell and day are averaged first, so every cell has one row a day.
    """
    one = daily.where("cell is not null and day is not null").groupBy("cell", "day").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in INPUTS))
    ordered = one.repartition("cell").sortWithinPartitions("day", "cell")
    return ordered.mapInArrow(_scan, "cell string, day date, " + ", ".join(f"{c} double" for c in CODES))


HOURLY = ["temp", "rh", "wind", "precip", "start"]


def _hourly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (cell, hour, inputs) in order of time; rows of one hour are one vector step. A cell without a code takes its start value."""
    state = _State({"hffmc": np.nan})
    for b in batches:
        hours = b.column(1).cast(pa.int64()).to_numpy()
        at = state.slots(b.column(0).to_pylist())
        x = {c: b.column(i + 2).to_numpy(zero_copy_only=False).astype(float) for i, c in enumerate(HOURLY)}
        out = np.empty(len(hours))
        edges = [0, *(np.flatnonzero(np.diff(hours)) + 1), len(hours)]
        with np.errstate(all="ignore"):
            for i, j in zip(edges, edges[1:], strict=False):
                here = at[i:j]
                last = state.codes["hffmc"][here]
                new = fwi.hourly_ffmc(last, *(x[c][i:j] for c in HOURLY[:4]), 1.0, False, NumpyMath)
                out[i:j] = np.where(np.isnan(last), x["start"][i:j], new)
                state.keep(here, {"hffmc": out[i:j]})
        if len(hours):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, mask=np.isnan(out))], ["cell", "ts", "hffmc"])


def hourly_codes(hours: DataFrame) -> DataFrame:
    """(cell, ts, hffmc) of (cell, ts, temp, rh, wind, precip, start): a cell begins at its first hour with a start value.

    Rows of one cell and hour are averaged first, so every cell has one row an hour.
    """
    one = hours.where("cell is not null and ts is not null").groupBy("cell", "ts").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in HOURLY))
    ordered = one.repartition("cell").sortWithinPartitions("ts", "cell")
    return ordered.mapInArrow(_hourly, "cell string, ts timestamp, hffmc double")
