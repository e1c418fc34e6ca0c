"""Small models: two-means of teams and a softmax regression with gradient descent, fitted by aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import softmax


def two_means(df: DataFrame, features: list[str], weight: str, rounds: int = 10) -> tuple[DataFrame, list[list[float]]]:
    """Adds ``cluster`` (0 has the smaller first coordinate) of a weighted 2-means, and gives the two centres.

    It starts at the least and the greatest row; each round is one aggregate over the rows.
    """
    low, high = df.agg(F.min(F.struct(*features)), F.max(F.struct(*features))).first()
    if low is None:
        return df.withColumn("cluster", F.lit(0)), []
    centres = [list(map(float, low)), list(map(float, high))]

    def side() -> Column:
        far = [sum(((F.col(f) - c) * (F.col(f) - c) for f, c in zip(features, centre, strict=True)), F.lit(0.0)) for centre in centres]
        return (far[1] < far[0]).cast("int")

    for _ in range(rounds):
        sums = df.groupBy(side().alias("cluster")).agg(*(F.round(F.sum(F.col(f) * F.col(weight)) / F.sum(weight), 9).alias(f) for f in features)).collect()  # two rows
        new = list(centres)
        for r in sums:
            new[r.cluster] = [r[f] for f in features]
        if new == centres:
            break
        centres = new
    centres.sort()
    return df.withColumn("cluster", side()), centres


#: Classes of a model at most.
CLASSES = 1000


def fit_softmax(df: DataFrame, features: list[str], label: str, steps: int = 60, rate: float = 0.5) -> dict:
    """A softmax regression on standardised features by gradient descent; each step is one aggregate over the rows.

    It needs at least two rows of two classes, else there is no model; of over CLASSES classes it makes none either, but fails.
    """
    classes = sorted(r[0] for r in df.select(label).distinct().limit(CLASSES + 2).collect() if r[0] is not None)
    if len(classes) > CLASSES:
        raise ValueError(f"{label} has more than {CLASSES} classes")
    stats = df.agg(F.count(F.lit(1)), *(F.avg(f) for f in features), *(F.stddev_pop(f) for f in features)).first()
    n, k = stats[0], len(features)
    if n < 2 or len(classes) < 2:
        return {}
    mean, sd = [stats[1 + i] for i in range(k)], [stats[1 + k + i] or 1.0 for i in range(k)]
    z = [*((F.col(f) - m) / s for f, m, s in zip(features, mean, sd, strict=True)), F.lit(1.0)]
    w = np.zeros((len(classes), k + 1))
    for _ in range(steps):
        p = softmax([sum((float(c) * x for c, x in zip(row, z, strict=True)), F.lit(0.0)) for row in w])
        off = [p[i] - (F.col(label) == c).cast("double") for i, c in enumerate(classes)]
        g = df.agg(*(F.avg(o * x) for o in off for x in z)).first()
        w = w - rate * np.array(g, dtype=float).reshape(w.shape)
    return {"classes": classes, "mean": mean, "sd": sd, "weights": w.tolist(), "features": features}


def softmax_scores(model: dict) -> list[tuple[str, Column]]:
    """The probability of each class as an expression."""
    z = [*((F.col(f) - m) / s for f, m, s in zip(model["features"], model["mean"], model["sd"], strict=True)), F.lit(1.0)]
    return list(zip(model["classes"], softmax([sum((float(c) * x for c, x in zip(row, z, strict=True)), F.lit(0.0)) for row in model["weights"]]), strict=True))
