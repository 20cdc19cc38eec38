"""Windowed counts with a watermark, and the fire-weather state scan as an online operator keyed by cell."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from celldays.functions import fwi
from celldays.operators.scan import CODES as DAILY
from celldays.operators.scan import INPUTS, _codes

CODES = "cell string, day date, ffmc double, dmc double, dc double, isi double, bui double, fwi double"


def drained(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def minute_counts(spark: SparkSession, path: str, folder: str, width: str, late: str = "1 hour") -> DataFrame:
    """Counts per window and event type of a Parquet stream, each batch merged by key into a table of the shared folder."""
    schema = spark.read.parquet(path).schema
    run = f"{folder}/counts-{uuid.uuid4().hex}"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs).isFile():  # streams read folders
        reader, path = reader.option("pathGlobFilter", fs.getName()), fs.getParent().toString()
    stream = reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("start"), "event_type", "n", F.lit(number).alias("batch")).write.mode("append").parquet(f"{run}/out")

    drained(counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start())
    return spark.read.parquet(f"{run}/out").groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))


BUCKETS = 64
STATE = "cells array<string>, days array<int>, ffmc array<double>, dmc array<double>, dc array<double>"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Days of one bucket of cells in order, a day of all cells being one vector step; a day not after the cell's last is late and gets missing codes."""
    cells, days, *old = state.get if state.exists else ([], [], [], [], [])
    place, last = {c: i for i, c in enumerate(cells)}, np.array(days, np.int64)
    codes = {k: np.array(v, float) for k, v in zip(fwi.START, old, strict=True)}
    p = pd.concat(list(frames)).sort_values(["day", "cell"], kind="stable")
    at = np.fromiter((place.setdefault(c, len(place)) for c in p["cell"]), int, len(p))
    fresh = len(place) - len(last)
    last = np.concatenate([last, np.full(fresh, -(2**31))])
    codes = {k: np.concatenate([v, np.full(fresh, fwi.START[k])]) for k, v in codes.items()}
    day = p["day"].to_numpy().astype("datetime64[D]")
    number, months = day.astype(np.int64), day.astype("datetime64[M]").astype(int) % 12 + 1
    x = {c: p[c].to_numpy(float) for c in INPUTS}
    out = {c: np.full(len(p), np.nan) for c in DAILY}
    edges = [0, *(np.flatnonzero(np.diff(number)) + 1), len(p)]
    with np.errstate(all="ignore"):
        for i, j in zip(edges, edges[1:], strict=False):
            rows = np.arange(i, j)[last[at[i:j]] < number[i]] if j > i else np.empty(0, int)
            rows = rows[np.unique(at[rows], return_index=True)[1]]  # the first of repeated rows of a day counts
            if len(rows):
                here = at[rows]
                new = _codes({k: v[here] for k, v in codes.items()}, {c: v[rows] for c, v in x.items()}, months[i])
                for k in codes:
                    codes[k][here] = np.where(np.isnan(new[k]), codes[k][here], new[k])
                for c in DAILY:
                    out[c][rows] = new[c]
                last[here] = number[i]
    state.update(([*place], last.tolist(), *(v.tolist() for v in codes.values())))
    yield pd.DataFrame({"cell": p["cell"].to_numpy(), "day": p["day"].to_numpy(), **out})


def online_codes(spark: SparkSession, daily: DataFrame, folder: str) -> DataFrame:
    """Codes of daily rows (cell, day, temp, rh, wind, precip, lat) that arrive as a stream: state is a day and three numbers a cell, kept by bucket of cells."""
    run = f"{folder}/online-{uuid.uuid4().hex}"
    daily.write.parquet(f"{run}/in")
    stream = spark.readStream.schema(daily.schema).parquet(f"{run}/in").where("cell is not null and day is not null")
    keyed = stream.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(BUCKETS)))
    codes = keyed.groupBy("bucket").applyInPandasWithState(_advance, CODES, STATE, "append", GroupStateTimeout.NoTimeout)
    drained(codes.writeStream.outputMode("append").format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start())
    t = spark.read.schema(CODES).parquet(f"{run}/out")
    return t.select("cell", "day", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in DAILY))
