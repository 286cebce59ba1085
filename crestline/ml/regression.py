"""Linear and logistic regression by minibatch gradient descent, and their scores.

A batch's gradient is one aggregation; only the weights (one number for each
feature) are on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import piecewise_sigmoid, sigmoid
from ..operators.segmented import prefix_sum


def _dot(features: list[str], weights: list[float]) -> Column:
    total = F.lit(0.0)
    for f, w in zip(features, weights, strict=True):
        total = total + F.col(f) * F.lit(float(w))
    return total


def batches(df: DataFrame, count: int, seed: int, key: list[str]) -> DataFrame:
    """Rows dealt to ``count`` batches without replacement, of equal sizes (but for one row); the same for the same seed."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    drawn = df.withColumns({"_draw": F.md5(text.cast("binary")), "_one": F.lit(1).cast("long")})
    ranked = prefix_sum(drawn, "_one", ["_draw", *key], "_place")
    return ranked.withColumn("batch", ((F.col("_place") - 1) % count).cast("int")).drop("_draw", "_one", "_place")


def train(df: DataFrame, features: list[str], label: str, *, logistic: bool = False, rate: float = 0.1, epochs: int = 3, count: int = 4, seed: int = 1, key: list[str] | None = None, piecewise: bool = False) -> list[float]:
    """Weights of the features, from 0, one step for each batch of each epoch."""
    weights = [0.0] * len(features)
    dealt = batches(df, count, seed, key or [*features, label]).select("batch", *features, label).cache()
    try:
        for _ in range(epochs):
            for b in range(count):
                raw = _dot(features, weights)
                guess = (piecewise_sigmoid if piecewise else sigmoid)(raw) if logistic else raw
                error = guess - F.col(label)
                row = dealt.where(F.col("batch") == b).agg(*[F.avg(error * F.col(f)) for f in features]).first()
                weights = [w - rate * (g or 0.0) for w, g in zip(weights, row, strict=True)]
    finally:
        dealt.unpersist()
    return weights


def predict(df: DataFrame, features: list[str], weights: list[float], logistic: bool = False, new: str = "prediction") -> DataFrame:
    raw = _dot(features, weights)
    return df.withColumn(new, sigmoid(raw) if logistic else raw)


def score(df: DataFrame, label: str, logistic: bool = False, prediction: str = "prediction") -> DataFrame:
    """Mean squared error, or accuracy at one half."""
    if logistic:
        return df.agg(F.avg(((F.col(prediction) >= 0.5) == (F.col(label) >= 0.5)).cast("double")).alias("accuracy"))
    return df.agg(F.avg((F.col(prediction) - F.col(label)) ** 2).alias("mse"))


def layers(df: DataFrame, features: list[str], matrices: list[list[list[float]]], new: str = "out") -> DataFrame:
    """A fully connected network with rectifiers between layers; one output column for each row of the last matrix."""
    held = [F.col(f) for f in features]
    for i, matrix in enumerate(matrices):
        held = [sum((c * F.lit(float(w)) for c, w in zip(held, row, strict=True)), F.lit(0.0)) for row in matrix]
        if i + 1 < len(matrices):
            held = [F.greatest(c, F.lit(0.0)) for c in held]
    return df.withColumns({f"{new}{i}": c for i, c in enumerate(held)})


def synthetic(spark: SparkSession, rows: int, weights: list[float], seed: int = 1, noise: float = 0.1, logistic: bool = False) -> DataFrame:
    """Normal features x0, x1, ... and a label y that the weights explain."""
    df = spark.range(rows).select(F.col("id"), *[F.randn(seed + i).alias(f"x{i}") for i in range(len(weights))])
    raw = _dot([f"x{i}" for i in range(len(weights))], weights) + F.lit(noise) * F.randn(seed + 1000)
    return df.withColumn("y", (raw > 0).cast("double") if logistic else raw)
