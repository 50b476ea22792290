"""Cross-product sums as one aggregate, solved on a (p x p) matrix."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cross_products(df: DataFrame, columns: Sequence[Column], weight: Column | None = None) -> tuple[np.ndarray, int]:
    """X'X of the given row expressions and the row count.

    All p(p+1)/2 sums are partial aggregates, so each task ships one row;
    the driver gets p x p doubles, never data rows.
    """
    p = len(columns)
    staged = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.coalesce(F.sum(F.col(f"x{i}") * F.col(f"x{j}")), F.lit(0.0)).alias(f"s{i}_{j}") for i, j in pairs]
    row = staged.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    gram = np.zeros((p, p))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"s{i}_{j}"]
    return gram, int(row["n"])


def covariance(df: DataFrame, columns: Sequence[Column], ddof: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, covariance, n) in two passes: means first, then centred products."""
    staged = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    row = staged.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(len(columns))]).first()
    means = np.array([row[f"m{i}"] for i in range(len(columns))], dtype=float)
    gram, n = cross_products(staged, [F.col(f"c{i}") - F.lit(float(m)) for i, m in enumerate(means)])
    return means, gram / max(n - ddof, 1), n


def inverse(matrix: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(matrix)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(matrix)


def whitening(inverse_covariance: np.ndarray) -> np.ndarray:
    """L with L L' = S^-1, so |z L| is the Mahalanobis length of z."""
    values, vectors = np.linalg.eigh((inverse_covariance + inverse_covariance.T) / 2.0)
    return vectors * np.sqrt(np.clip(values, 0.0, None))
