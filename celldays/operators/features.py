"""Window tables for models: complete samples, wide pivots, train-only scaling, tensor statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celldays.operators.quality import complete_keys


def wide(df: DataFrame, keys: list[str], columns: list[str], windows: int = 4) -> DataFrame:
    """One row per sample with w1_f .. wn_f: conditional aggregates, one shuffle; the mean of repeated rows."""
    cells = [F.avg(F.when(F.col("window_id") == k, F.col(c).cast("double"))).alias(f"w{k}_{c}") for k in range(1, windows + 1) for c in columns]
    return df.groupBy(*keys).agg(*cells)


def xy(x: DataFrame, y: DataFrame, keys: list[str], columns: list[str], windows: int = 4) -> DataFrame:
    """Complete samples joined to their labels, wide."""
    whole = x.join(complete_keys(x, keys, windows), keys, "left_semi")
    return wide(whole, keys, columns, windows).join(y, keys)


def scaled(df: DataFrame, columns: list[str], train, eps: float = 1e-6) -> DataFrame:
    """(x - mean) / sd of the training rows, population sd, 1 below eps, gaps 0; the statistics are two literals a column."""
    s = df.where(train).agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()

    def one(c: str):
        m, sd = s[f"m_{c}"] or 0.0, s[f"s_{c}"]
        return F.coalesce((F.col(c).cast("double") - m) / (sd if sd is not None and sd >= eps else 1.0), F.lit(0.0))

    return df.withColumns({c: one(c) for c in columns})


def tensor_stats(w: DataFrame, keys: list[str], columns: list[str], windows: int = 4) -> DataFrame:
    """Per sample and feature: mean, population sd, min, max, last (the oldest window), trend (oldest - newest), recent_delta, accel."""
    out = []
    for c in columns:
        v = [F.col(f"w{k}_{c}") for k in range(1, windows + 1)]
        mean = sum(v[1:], v[0]) / windows
        out += [
            mean.alias(f"{c}_mean"), F.sqrt(F.greatest(sum(((x - mean) * (x - mean) for x in v[1:]), (v[0] - mean) * (v[0] - mean)) / windows, F.lit(0.0))).alias(f"{c}_std"), F.least(*v).alias(f"{c}_min"), F.greatest(*v).alias(f"{c}_max"),
            v[-1].alias(f"{c}_last"), (v[-1] - v[0]).alias(f"{c}_trend"), (v[-1] - v[-2]).alias(f"{c}_recent_delta"), ((v[-1] - v[-2]) - (v[-2] - v[-3])).alias(f"{c}_accel"),
        ]
    return w.select(*keys, *out)
