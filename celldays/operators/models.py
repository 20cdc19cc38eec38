"""Learned operators over wide sample tables: forward pass of a small network, boosted trees with a stacked regression, permutation importance."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celldays.operators.metrics import average_precision


def dense(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """One layer as array expressions: weights are fixed literals, at most a few thousand."""
    rows = [F.aggregate(F.zip_with(x, F.array(*(F.lit(float(w)) for w in row)), lambda a, b: a * b), F.lit(float(b)), lambda s, v: s + v) for row, b in zip(weights, bias, strict=True)]
    return F.array(*rows)


def gelu(v: Column) -> Column:
    """Tanh form of the Gaussian error unit."""
    return 0.5 * v * (1 + F.tanh(math.sqrt(2 / math.pi) * (v + 0.044715 * v * v * v)))


def mlp(df: DataFrame, x: str, layers: list[tuple[list[list[float]], list[float]]], name: str = "probability", activation: str = "gelu") -> DataFrame:
    """Forward pass of a network with one sigmoid output; each layer's array is a column, so no layer is computed twice."""
    act = gelu if activation == "gelu" else lambda v: F.greatest(v, F.lit(0.0))
    df = df.withColumn("_h", F.col(x))
    for i, (w, b) in enumerate(layers):
        df = df.withColumn("_h", dense(F.col("_h"), w, b))
        if i < len(layers) - 1:
            df = df.withColumn("_h", F.transform("_h", act))
    return df.withColumn(name, 1 / (1 + F.exp(-F.col("_h")[0]))).drop("_h")


def fixed_layers(sizes: list[int], seed: int = 7) -> list[tuple[list[list[float]], list[float]]]:
    """Deterministic small weights for a network of the given sizes."""
    value = lambda i, j, k: math.sin(seed + 12.9898 * i + 78.233 * j + 37.719 * k) * 0.3
    return [([[value(i, j, k) for j in range(a)] for i in range(b)], [value(i, -1, k) for i in range(b)]) for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))]


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    clean = df.na.fill(0.0, columns)
    return VectorAssembler(inputCols=columns, outputCol="features").transform(clean)


def stacked(train: DataFrame, columns: list[str], label: str = "label", seed: int = 42, folds: int = 2) -> tuple[PipelineModel, list]:
    """(stacker, base models): boosted trees and a forest, stacked by a logistic regression on out-of-fold scores."""
    t = assembled(train, columns).withColumn("_fold", F.pmod(F.xxhash64(*columns), F.lit(folds)))
    make = lambda: [GBTClassifier(labelCol=label, maxIter=8, maxDepth=3, seed=seed), RandomForestClassifier(labelCol=label, numTrees=10, maxDepth=4, seed=seed)]
    parts = []
    for k in range(folds):
        models = [m.fit(t.where(F.col("_fold") != k)) for m in make()]
        parts.append(base_scores(t.where(F.col("_fold") == k), models))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    top = Pipeline(stages=[VectorAssembler(inputCols=["s0", "s1"], outputCol="stack"), LogisticRegression(featuresCol="stack", labelCol=label)]).fit(scored.drop("features"))
    return top, [m.fit(t) for m in make()]


def base_scores(df: DataFrame, models: list) -> DataFrame:
    for i, m in enumerate(models):
        df = m.transform(df).withColumn(f"s{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    return df


def score(df: DataFrame, columns: list[str], top: PipelineModel, models: list) -> DataFrame:
    out = top.transform(base_scores(assembled(df, columns), models).drop("features"))
    return out.withColumn("y_prob", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "stack", "s0", "s1")


def perceptron(train: DataFrame, columns: list[str], label: str = "label", hidden: tuple[int, ...] = (8,), seed: int = 42) -> PipelineModel:
    net = MultilayerPerceptronClassifier(labelCol=label, layers=[len(columns), *hidden, 2], maxIter=30, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), net]).fit(train.na.fill(0.0, columns))


def permutation_importance(df: DataFrame, columns: list[str], predict, label: str, keys: list[str], seed: int = 42) -> DataFrame:
    """(feature, drop in average precision) when a column's values are exchanged between rows of one hash order."""
    from celldays.operators.sampling import order_hash

    base = average_precision(predict(df).select(F.col(label).alias("y"), F.col("y_prob").alias("p"))).first()["average_precision"]
    out = []
    for i, c in enumerate(columns):
        # each row takes the value of another row of its hash bucket, whose order is another hash
        from pyspark.sql import Window

        b = df.withColumn("_h", order_hash(keys, seed + i)).withColumn("_b", F.substring("_h", 1, 3))
        w = Window.partitionBy("_b").orderBy("_h", *keys)
        moved = b.withColumn(c, F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).drop("_h", "_b")
        ap = average_precision(predict(moved).select(F.col(label).alias("y"), F.col("y_prob").alias("p"))).first()["average_precision"]
        out.append((c, float(base - ap)))
    return df.sparkSession.createDataFrame(out, "feature string, drop double")
