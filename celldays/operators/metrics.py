"""Binary classification metrics from (y_true, y_prob) as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sanitised(df: DataFrame, y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Finite pairs only; y above 0.5 is 1, p is cut to [0, 1]."""
    v, q = F.col(y).cast("double"), F.col(p).cast("double")
    ok = v.isNotNull() & q.isNotNull() & ~F.isnan(v) & ~F.isnan(q) & (F.abs(v) < float("inf")) & (F.abs(q) < float("inf"))
    return df.where(ok).select((v > 0.5).cast("int").alias("y"), F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)).alias("p"))


def from_counts(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn), "specificity": ratio(tn, tn + fp), "accuracy": ratio(tp + tn, tp + fp + tn + fn)}


def confusion(clean: DataFrame, threshold: float = 0.5) -> DataFrame:
    hit = F.col("p") >= threshold
    n = lambda y, h: F.count(F.when((F.col("y") == y) & (hit if h else ~hit), 1))
    out = clean.agg(n(1, True).alias("tp"), n(0, True).alias("fp"), n(0, False).alias("tn"), n(1, False).alias("fn"))
    return out.withColumns(from_counts(*(F.col(c) for c in ("tp", "fp", "tn", "fn"))))


def sweep(clean: DataFrame, steps: int = 100) -> DataFrame:
    """Metrics at thresholds 0, 1/steps, .., 1: scores are binned first, then bins are summed from above.

    One aggregation of the table, and a window over at most steps + 1 rows instead of every row at every threshold.
    """
    bins = clean.groupBy(F.floor(F.col("p") * steps + 1e-9).cast("int").alias("bin")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    grid = clean.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("bin"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(F.lit(0))
    t = grid.join(bins, "bin", "left").fillna(0)
    t = t.select((F.col("bin") / steps).alias("threshold"), F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), F.sum("pos").over(all_).alias("np"), F.sum("neg").over(all_).alias("nn"))
    t = t.select("threshold", "tp", "fp", (F.col("nn") - F.col("fp")).alias("tn"), (F.col("np") - F.col("tp")).alias("fn"))
    return t.withColumns(from_counts(*(F.col(c) for c in ("tp", "fp", "tn", "fn"))))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold of the greatest f1; ties by recall, precision, then the lower threshold."""
    return swept.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), "threshold").limit(1)


def average_precision(clean: DataFrame, bins: int = 4096) -> DataFrame:
    """Step-wise average precision, tied scores as one step: 0 without positives, 1 without negatives.

    Scores are summed per distinct value, then ranked within order-preserving bins, so no window spans all scores.
    """
    s = clean.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).withColumn("bin", F.floor(F.col("p") * bins))
    per = s.groupBy("bin").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)  # at most bins + 1 rows
    whole = Window.partitionBy(F.lit(0))
    per = per.select("bin", F.coalesce(F.sum("bp").over(down), F.lit(0)).alias("tp0"), F.coalesce(F.sum("bn").over(down), F.lit(0)).alias("fp0"), F.sum("bp").over(whole).alias("np"), F.sum("bn").over(whole).alias("nn"))
    w = Window.partitionBy("bin").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    t = s.join(F.broadcast(per), "bin").withColumn("tp", F.col("tp0") + F.sum("pos").over(w)).withColumn("fp", F.col("fp0") + F.sum("neg").over(w))
    ap = F.sum(F.try_divide(F.col("pos"), F.col("np")) * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    out = t.agg(F.max("np").alias("n_pos"), F.max("nn").alias("n_neg"), ap.alias("ap"))
    return out.select("n_pos", "n_neg", F.when(F.coalesce("n_pos", F.lit(0)) == 0, 0.0).when(F.col("n_neg") == 0, 1.0).otherwise(F.col("ap")).alias("average_precision"))


def quantile(df: DataFrame, group: str, value: str, p: float, name: str, bins: int = 4096) -> DataFrame:
    """(group, name): the exact, linearly interpolated quantile of the known values of each group.

    A histogram of ``bins`` equal steps between a group's limits tells which steps hold the two ranks; only their distinct values are ranked.
    """
    n = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = n.groupBy(group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), ((F.sum("n") - 1) * p).alias("h"))
    step = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).otherwise(0).cast("long")
    placed = n.join(ends, group).withColumn("bin", step)
    hist = placed.groupBy(group, "bin").agg(F.sum("n").alias("c"), F.max("h").alias("h"))
    before = F.sum("c").over(Window.partitionBy(group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    low, high = F.floor("h"), F.ceil("h")
    hist = hist.withColumn("before", before).where(((low >= F.col("before")) & (low < F.col("before") + F.col("c"))) | ((high >= F.col("before")) & (high < F.col("before") + F.col("c"))))
    near = placed.join(hist.select(group, "bin", "before"), [group, "bin"])
    end = F.col("before") + F.sum("n").over(Window.partitionBy(group, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda r: F.max(F.when((r >= F.col("end") - F.col("n")) & (r < F.col("end")), F.col("v")))
    found = near.withColumn("end", end).groupBy(group).agg(at(low).alias("a"), at(high).alias("b"), F.max(F.col("h") - low).alias("f"))
    return found.select(group, (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias(name))


def focal_loss(z: Column, y: Column, gamma: float = 2.0, pos_weight: float = 1.0) -> Column:
    """Focal loss of a logit: (1 - e^-bce)^gamma bce, the stable form of log(1 + e^z)."""
    soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    bce = pos_weight * y * soft(-z) + (1 - y) * soft(z)
    return F.pow(1 - F.exp(-bce), gamma) * bce
