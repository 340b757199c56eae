"""Model scoring: weights travel as a broadcast, rows as Arrow batches; small fits run where the data is."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.columns import dot, softmax


def linear_probabilities(vector: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """Softmax of a linear model, in the JVM: one dot product for each class."""
    v = vector.cast("array<double>")
    logits = [dot(v, F.array(*[F.lit(float(x)) for x in w])) + float(b) for w, b in zip(weights, bias, strict=True)]
    return softmax(F.array(*logits))


def mlp_probabilities(rows: DataFrame, vector: str, layers: Sequence[tuple[np.ndarray, np.ndarray]], name: str = "p") -> DataFrame:
    """Adds class probabilities of a perceptron with relu layers; whole Arrow batches are multiplied at once."""
    shared = rows.sparkSession.sparkContext.broadcast([(np.asarray(w, float), np.asarray(b, float)) for w, b in layers])

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = shared.value
        for column in batches:
            x = np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, weights[0][0].shape[0]))
            for k, (w, b) in enumerate(weights):
                x = x @ w + b
                if k < len(weights) - 1:
                    x = np.maximum(x, 0)
            x = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
            x = x / x.sum(axis=1, keepdims=True) if len(x) else x
            yield pd.Series(list(x))

    return rows.withColumn(name, score(vector))


def vote(predictions: Sequence[Column]) -> tuple[Column, Column]:
    """Side that most models take (0 if none has a majority) and how many agree."""
    up = sum((F.when(p > 0, 1).otherwise(0) for p in predictions), F.lit(0))
    down = sum((F.when(p < 0, 1).otherwise(0) for p in predictions), F.lit(0))
    half = len(predictions) / 2
    return F.when(up > half, 1).when(down > half, -1).otherwise(0), F.greatest(up, down)


def temperature(rows: DataFrame, logits: str, truth: str, steps: int = 300, rate: float = 0.01) -> float:
    """The temperature that lowers cross entropy, by gradient steps; every step is one aggregate of the table.

    The loss is convex in 1 / T, so a bracketed search on it needs few passes.
    """
    cached = rows.select(F.col(logits).cast("array<double>").alias("z"), F.col(truth).alias("y")).cache()

    def losses(inverse: Sequence[float]) -> list[float]:
        aggs = [F.avg(-F.log(F.greatest(F.element_at(softmax(F.transform("z", lambda x, b=b: x * b)), F.col("y") + 1), F.lit(1e-12)))).alias(f"l{i}") for i, b in enumerate(inverse)]
        return list(cached.agg(*aggs).first())

    low, high = 0.05, 20.0
    for _ in range(6):
        points = np.geomspace(low, high, 9)
        at = int(np.argmin(losses(points.tolist())))
        low, high = points[max(0, at - 1)], points[min(8, at + 1)]
    cached.unpersist()
    return float(1 / np.sqrt(low * high))


def logistic_fit(rows: DataFrame, features: Sequence[str], label: str, steps: int = 25, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by Newton steps; each step is one aggregate (d * d sums)."""
    cached = rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y")).cache()
    names = [*features, "_one"]
    data = cached.withColumn("_one", F.lit(1.0))
    w = np.zeros(len(names))
    for _ in range(steps):
        score = sum((F.col(n) * float(x) for n, x in zip(names, w, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-score))
        gradient = [F.avg((p - F.col("_y")) * F.col(n)).alias(f"g{i}") for i, n in enumerate(names)]
        hessian = [F.avg(p * (1 - p) * F.col(a) * F.col(b)).alias(f"h{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
        row = data.agg(*gradient, *hessian).first()
        g = np.array([row[f"g{i}"] for i in range(len(names))]) + l2 * np.r_[w[:-1], 0]
        h = np.zeros((len(names), len(names)))
        for i in range(len(names)):
            for j in range(i, len(names)):
                h[i, j] = h[j, i] = row[f"h{i}_{j}"]
        step = np.linalg.solve(h + l2 * np.eye(len(names)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    cached.unpersist()
    return w[:-1], float(w[-1])


def formula(weights: Sequence[float], names: Sequence[str], n: int = 3) -> str:
    """The n largest weights as a formula."""
    top = sorted(zip(weights, names, strict=True), key=lambda x: (-abs(x[0]), x[1]))[:n]
    return " ".join(f"{w:+.4f}*{name}" for w, name in top)
