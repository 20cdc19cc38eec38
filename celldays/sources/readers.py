"""Readers: projected scans, CSV sets, alias and default columns, named bands, nested cubes, synthetic points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str, columns: list[str], where: str | None = None) -> DataFrame:
    """Only the named columns, the predicate pushed to the scan."""
    t = spark.read.parquet(path).select(*columns)
    return t.where(where) if where else t


def read_csv(spark: SparkSession, paths: list[str], schema: dict[str, str]) -> DataFrame:
    """Several files with headers under one explicit schema; a malformed number is null."""
    ddl = ", ".join(f"`{c}` {t}" for c, t in schema.items())
    return spark.read.schema(ddl).option("header", True).option("mode", "PERMISSIVE").csv(paths)


def with_source(df: DataFrame) -> DataFrame:
    """File name and the split that it names as columns."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    low = F.lower(name)
    return df.withColumn("source_file", name).withColumn("split", F.when(low.contains("train"), "train").when(low.contains("val"), "val").when(low.contains("test"), "test"))


def with_aliases(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Each wanted column from the first of its spellings that the table has; an error names what is missing."""
    for want, options in names.items():
        have = [o for o in options if o in df.columns]
        if not have:
            raise ValueError(f"no column for {want}: looked for {options}")
        df = df if have[0] == want else df.withColumnRenamed(have[0], want)
    return df


def first_level(df: DataFrame, keys: list[str], level: str) -> DataFrame:
    """The row of the lowest level (or first step) of each key, by a struct minimum."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(level, *(c for c in rest if c != level))).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in rest))


def label_samples(df: DataFrame) -> DataFrame:
    """Label rows with a whole key; a missing split is 'all', a missing class '', a missing label null."""
    have = set(df.columns)
    split = F.coalesce(F.nullif(F.lower(F.trim("split")), F.lit("")), F.lit("all")) if "split" in have else F.lit("all")
    kind = F.coalesce(F.col("type_class"), F.lit("")) if "type_class" in have else F.lit("")
    label = F.col("label").cast("double") if "label" in have else F.lit(None).cast("double")
    return df.dropna(subset=["target_date", "row", "col"]).withColumns({"split": split, "type_class": kind, "label": label})


def band_parts(df: DataFrame, band: str) -> DataFrame:
    """suffix and day of band names that hold an eight-digit date and a name, in either order."""
    date = F.regexp_extract(band, r"(?:^|_)(\d{8})(?:_|$)", 1)
    suffix = F.regexp_replace(F.regexp_replace(F.col(band), r"(?:^|_)\d{8}(?=_|$)", ""), r"^_", "")
    return df.withColumns({"day": F.to_date(F.nullif(date, F.lit("")), "yyyyMMdd"), "suffix": suffix})


def unpivot_bands(df: DataFrame, keys: list[str], nodata: float | None = None) -> DataFrame:
    """Wide band columns as rows (keys, band, value), the nodata value as null."""
    bands = [c for c in df.columns if c not in keys]
    t = df.unpivot(keys, bands, "band", "value")
    return t if nodata is None else t.withColumn("value", F.nullif("value", F.lit(nodata)))


def discovered(df: DataFrame, name: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows of the stores asked for: names with a leading underscore are never stores."""
    df = df.where(~F.col(name).startswith("_"))
    df = df.where(F.col(name).isin(include)) if include else df
    return df.where(~F.col(name).isin(exclude)) if exclude else df


def read_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Manifests and summaries under an explicit schema."""
    return spark.read.schema(ddl).json(path)


def flatten_cube(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Three nested arrays as rows (keys, row, col, channel, value)."""
    t = df.select(*keys, F.posexplode(name).alias("row", "_r"))
    t = t.select(*keys, "row", F.posexplode("_r").alias("col", "_c"))
    return t.select(*keys, "row", "col", F.posexplode("_c").alias("channel", "value"))


def ragged(df: DataFrame, name: str) -> DataFrame:
    """Rows whose inner arrays differ in length."""
    sizes = F.array_distinct(F.transform(name, F.size))
    return df.where(F.size(sizes) > 1)


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def synthetic_points(spark: SparkSession, n: int, features: int, seed: int = 42) -> DataFrame:
    """n points of independent normal features."""
    return spark.range(n).select(F.col("id").alias("point"), *(F.randn(seed + i).alias(f"f{i}") for i in range(features)))
