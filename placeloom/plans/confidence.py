"""Confidence of answers: a logistic model fitted by Newton's method on sums gathered in one pass a step."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_logistic(rows: DataFrame, features: list[str], target: str, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the intercept last, not shrunk). Rows with a null feature or target are left out; no rows give zeros.

    Each step aggregates the gradient and the Hessian, k + k * k / 2 numbers, whatever the number of rows.
    """
    x = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    rows = rows.select(*features, F.col(target).cast("double").alias("_y")).dropna()
    k = len(x)
    w = np.zeros(k)
    for _ in range(steps):
        z = sum((float(a) * c for a, c in zip(w, x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        grad = [F.sum((F.col("_y") - p) * c) for c in x]
        hess = [F.sum(p * (1 - p) * x[i] * x[j]) for i in range(k) for j in range(i, k)]
        got = rows.agg(*[g.alias(f"g{i}") for i, g in enumerate(grad)], *[h.alias(f"h{i}") for i, h in enumerate(hess)]).first()
        if got[0] is None:
            return w
        shrink = np.diag([ridge] * (k - 1) + [1e-9])
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = got[k:]
        h = h + np.triu(h, 1).T + shrink
        step = np.linalg.solve(h, np.array(got[:k]) - shrink @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def rate(weights: np.ndarray, features: list[str]) -> Column:
    z = sum((float(a) * F.col(f).cast("double") for a, f in zip(weights, features)), F.lit(float(weights[-1])))
    return 1 / (1 + F.exp(-z))
