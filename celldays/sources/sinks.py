"""Writers: partitioned and idempotent Parquet, compaction, CSV and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder per partition value; a rerun replaces only the partitions it holds, so a job resumes by month."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def once(df: DataFrame, path: str) -> None:
    """Writes unless the output exists."""
    df.write.mode("ignore").parquet(path)


def compacted(spark: SparkSession, source: str, target: str, rows_per_file: int = 5_000_000) -> DataFrame:
    """Many small files as few of bounded size, without a shuffle to one task."""
    spark.read.parquet(source).coalesce(max(1, spark.sparkContext.defaultParallelism)).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(target)
    return spark.read.parquet(target)


def to_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def zero_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and null as 0, as map outputs want it."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns})
