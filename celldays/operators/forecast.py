"""Projecting features ahead: history deltas, deterministic recursion, Monte Carlo random walks and their moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deltas(history: DataFrame, keys: list[str]) -> DataFrame:
    """First differences of (keys, feature, i, value) in order of i; a gap counts as 0."""
    w = Window.partitionBy(*keys, "feature").orderBy("i")
    v = F.coalesce(F.nanvl(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0))
    return history.withColumn("value", v).withColumn("delta", F.col("value") - F.lag("value").over(w)).where("delta is not null")


def noise(history: DataFrame, keys: list[str], floor: float = 1e-6) -> DataFrame:
    """Per cell and feature the mean delta, and per feature the population sd of all deltas with a floor."""
    d = deltas(history, keys)
    sigma = d.groupBy("feature").agg(F.greatest(F.stddev_pop("delta"), F.lit(floor)).alias("sigma"))
    return d.groupBy(*keys, "feature").agg(F.avg("delta").alias("mu")).join(F.broadcast(sigma), "feature")  # one row per feature


def window_means(history: DataFrame, keys: list[str], size: int = 16) -> DataFrame:
    """Means of consecutive windows of ``size`` days, window 0 the oldest."""
    return history.groupBy(*keys, "feature", F.floor(F.col("i") / size).cast("int").alias("window")).agg(F.avg("value").alias("mean"))


def project(current: DataFrame, horizon: int) -> DataFrame:
    """x + h mu for h = 1 .. horizon (value, mu)."""
    return current.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("projected", F.col("value") + F.col("h") * F.col("mu"))


def closed_form(current: DataFrame, horizon: int) -> DataFrame:
    """Moments of the unbounded walk: mean x + H mu, sd sigma sqrt(H)."""
    return current.withColumns({"mc_mean": F.col("value") + horizon * F.col("mu"), "mc_std": F.col("sigma") * F.sqrt(F.lit(float(horizon)))})


def _normal(row, i, h, seed: int):
    """A standard normal of (row, sample, step) by Box-Muller on a 64-bit hash: the same on every run, whatever the partitioning."""
    hashed = F.xxhash64(row, i, h, F.lit(seed))
    half = lambda x: (x.cast("double") + 0.5) / float(2**32)
    return F.sqrt(-2 * F.ln(half(F.shiftrightunsigned(hashed, 32)))) * F.cos(2 * F.pi() * half(hashed.bitwiseAND(F.lit(0xFFFFFFFF))))


def walk(current: DataFrame, keys: list[str], samples: int, horizon: int, low: str | None = None, high: str | None = None, seed: int = 42) -> DataFrame:
    """Samples of the random walk after horizon steps, clamped to the columns low and high at every step if given."""
    rows = current.withColumn("_row", F.xxhash64(*keys)).withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))

    def step(x, h):
        y = x + F.col("mu") + F.col("sigma") * _normal(F.col("_row"), F.col("sample"), h, seed)
        y = F.greatest(y, F.col(low)) if low else y
        return F.least(y, F.col(high)) if high else y

    path = F.col("value").cast("double")
    if horizon > 32:  # a long walk is a loop; a short one is unrolled, as code is generated for plain expressions only
        path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), path, step)
    else:
        for h in range(1, horizon + 1):
            path = step(path, F.lit(h))
    return rows.withColumn("projected", path).drop("_row")


def paths(current: DataFrame, keys: list[str], samples: int, horizon: int, seed: int = 42) -> DataFrame:
    """Whole paths (sample, step 0 .. horizon, path): each is built within its row, so nothing is shuffled."""
    rows = current.withColumn("_row", F.xxhash64(*keys)).withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    move = lambda h: F.col("mu") + F.col("sigma") * _normal(F.col("_row"), F.col("sample"), h, seed)
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.array(F.col("value").cast("double")), lambda p, h: F.concat(p, F.array(F.element_at(p, -1) + move(h))))
    return rows.select(*current.columns, "sample", F.posexplode(path).alias("step", "path"))


def moments(walked: DataFrame, keys: list[str]) -> DataFrame:
    return walked.groupBy(*keys).agg(F.avg("projected").alias("mc_mean"), F.stddev_pop("projected").alias("mc_std"), F.count(F.lit(1)).alias("n"))
