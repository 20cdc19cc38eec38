"""The star-schema tables read as the domain's tables: lines as observations of a supplier's cell on a ship date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celldays.session import table

CELL = ["row", "col"]


def obs(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, day, temp, rh, wind, precip, fire, line, part) of every line item."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        F.expr("l_suppkey div 10").cast("int").alias("row"), (F.col("l_suppkey") % 10).cast("int").alias("col"), F.to_date("l_shipdate").alias("day"),
        (q * 0.6 + 5).alias("temp"), (F.col("l_tax") * 900 + 20).alias("rh"), (F.col("l_discount") * 200).alias("wind"), F.when(n >= 5, q * 0.1).otherwise(0.0).alias("precip"),
        (F.col("l_returnflag") == "R").cast("int").alias("fire"), F.col("l_orderkey").alias("line"), F.col("l_partkey").alias("part"), n.cast("int").alias("n"),
    )


OBS = """obs as (select (l_suppkey // 10)::int as "row", (l_suppkey % 10)::int as col, l_shipdate::date as day,
  l_quantity * 0.6 + 5 as temp, l_tax * 900 + 20 as rh, l_discount * 200 as wind, case when l_linenumber >= 5 then l_quantity * 0.1 else 0.0 end as precip,
  (l_returnflag = 'R')::int as fire, l_orderkey as line, l_partkey as part, l_linenumber::int as n from lineitem)"""


def cell_days(spark: SparkSession, d: str) -> DataFrame:
    """One row per cell and day with observations: mean weather and whether any line burned."""
    return obs(spark, d).groupBy(*CELL, "day").agg(*(F.avg(c).alias(c) for c in ("temp", "rh", "wind", "precip")), F.max("fire").alias("fire"))


CELL_DAYS = OBS + """, cd as (select "row", col, day, avg(temp) as temp, avg(rh) as rh, avg(wind) as wind, avg(precip) as precip, max(fire) as fire from obs group by all)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "features_train")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers as points on a plane, in degrees."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), ((k * 37) % 1009 / 100.0).alias("x"), ((k * 61) % 997 / 100.0).alias("y"), "c_acctbal", "c_nationkey")


POINTS = "pts as (select c_custkey as id, (c_custkey * 37) % 1009 / 100.0::double as x, (c_custkey * 61) % 997 / 100.0::double as y, c_acctbal, c_nationkey from customer)"


def stations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("station"), ((k * 53) % 1013 / 100.0).alias("x"), ((k * 71) % 991 / 100.0).alias("y"), "s_acctbal")


STATIONS = "st as (select s_suppkey as station, (s_suppkey * 53) % 1013 / 100.0::double as x, (s_suppkey * 71) % 991 / 100.0::double as y, s_acctbal from supplier)"


class Registry:
    """Collects queries and their SQL by name."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add
