"""Conformal intervals, coverage and out-of-distribution scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.functions.linalg import covariance, inverse, whitening
from longspan.operators.trajectory import conformal_width, with_interval

__all__ = ["conformal_interval", "coverage", "ood_score"]


def conformal_interval(predictions: DataFrame, residuals: DataFrame, prediction: str = "prediction", residual: str = "residual", alpha: float = 0.1) -> DataFrame:
    """Add lower / upper from the 'higher' conformal quantile of absolute residuals."""
    width = conformal_width(residuals, residual, alpha, kind="higher", absolute=False)
    return with_interval(predictions, width, prediction)


def coverage(frame: DataFrame, y: str, lower: str = "lower", upper: str = "upper") -> DataFrame:
    """One row: share of values inside their interval."""
    inside = (F.col(y) >= F.col(lower)) & (F.col(y) <= F.col(upper))
    return frame.agg(F.avg(inside.cast("double")).alias("coverage"))


def ood_score(query: DataFrame, train: DataFrame, features: Sequence[str], out: str = "ood_score") -> DataFrame:
    """Mahalanobis distance to the training mean; a projection with literals."""
    columns = [F.col(c).cast("double") for c in features]
    means, cov, _ = covariance(train, columns)
    m = whitening(inverse(np.atleast_2d(cov)))
    centred = [c - F.lit(float(mu)) for c, mu in zip(columns, means)]
    total = F.lit(0.0)
    for j in range(m.shape[1]):
        part = sum((centred[i] * F.lit(float(m[i, j])) for i in range(len(centred))), F.lit(0.0))
        total = total + part * part
    return query.select("*", F.sqrt(total).alias(out))
