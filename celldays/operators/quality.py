"""Missing-value statistics, cleaning and output validators: aggregations over dynamic feature columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

META = ["label_id", "feat_id", "load_id", "aoi_id", "target_date", "row", "col", "window_id", "sample_key", "split", "source_file", "loaded_at"]


def features_of(df: DataFrame, meta: list[str] = META) -> list[str]:
    return [c for c in df.columns if c not in meta]


def gone(c: str, infinite: bool = True) -> Column:
    v = F.col(c).cast("double")
    bad = v.isNull() | F.isnan(v)
    return bad | (F.abs(v) == float("inf")) if infinite else bad


def nulls_for_gaps(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities become null, once, so that every aggregate skips them."""
    return df.withColumns({c: F.when(~gone(c), F.col(c)) for c in columns})


def any_missing(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (gone(c) for c in columns))


def all_missing(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (gone(c) for c in columns))


def missing_per_feature(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n_missing, ratio): one pass over all columns, then one row each."""
    n = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(gone(c), 1)).alias(c) for c in columns))
    return n.unpivot(["n"], columns, "feature", "n_missing").select("feature", "n_missing", F.try_divide("n_missing", "n").alias("ratio"))


def missing_per_window(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(any_missing(columns), 1)).alias("n_any_missing"))


def mean_imputed(df: DataFrame, columns: list[str], fit_on: Column | None = None) -> DataFrame:
    """Gaps take the mean of the fitting rows (all by default), 0 where a column has no value; the means are one broadcast row."""
    part = nulls_for_gaps(df if fit_on is None else df.where(fit_on), columns).agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns)).first()
    return nulls_for_gaps(df, columns).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(part[c] if part[c] is not None else 0.0))) for c in columns})


def clean(df: DataFrame, columns: list[str], keys: list[str], drop_share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(rows, dropped keys): keys with a row whose features are all missing go, features missing in more than drop_share go, other gaps take means."""
    bad = df.where(all_missing(columns)).select(*keys).distinct()
    kept = df.join(bad, keys, "left_anti")
    share = kept.agg(*(F.avg(gone(c).cast("int")).alias(c) for c in columns)).first()
    stay = [c for c in columns if share[c] is None or share[c] <= drop_share]
    return mean_imputed(kept.drop(*(c for c in columns if c not in stay)), stay), bad


def keys_in_both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def complete_keys(df: DataFrame, keys: list[str], windows: int = 4) -> DataFrame:
    """Keys whose window ids are exactly 1..windows."""
    g = df.groupBy(*keys).agg(F.count_distinct("window_id").alias("n"), F.min("window_id").alias("a"), F.max("window_id").alias("b"))
    return g.where((F.col("n") == windows) & (F.col("a") == 1) & (F.col("b") == windows)).select(*keys)


def validate_windows(df: DataFrame, keys: list[str], windows: int = 4) -> DataFrame:
    """One report row: rows, samples, repeated rows, bad window ids, incomplete samples, rows = samples x windows."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("window_id").alias("d"), F.count(F.when(~F.coalesce(F.col("window_id").between(1, windows), F.lit(False)), 1)).alias("bad"))
    out = per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_samples"), F.sum(F.col("n") - F.col("d")).alias("n_repeated"), F.sum("bad").alias("n_bad_windows"), F.count(F.when(F.col("d") != windows, 1)).alias("n_incomplete"))
    return out.withColumn("whole", F.col("n_rows") == F.col("n_samples") * windows)


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def keep_first(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """One row per key by an explicit order: a struct minimum or maximum, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    pack = F.struct(*order, *(c for c in rest if c not in order))
    return df.groupBy(*keys).agg((F.max if last else F.min)(pack).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in rest))


def pairwise_shares(df: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    """value counts of kind per group as columns, with row totals and per cent of each group."""
    t = df.groupBy(by).pivot(kind, kinds).agg(F.count(F.lit(1))).fillna(0, kinds)
    total = reduce(lambda a, b: a + b, (F.col(k) for k in kinds))
    return t.withColumn("total", total).withColumns({f"{k}_pct": F.round(F.try_divide(F.col(k) * 100.0, F.col("total")), 4) for k in kinds})


def share_of_all(df: DataFrame, by: list[str]) -> DataFrame:
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row per category
