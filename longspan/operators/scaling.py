"""Transforms fitted on training rows only.

``fit`` reduces the training data to a few numbers per column on the driver;
``transform`` is then a pure projection with literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.functions.columns import null_if_nan
from longspan.functions.linalg import cross_products
from longspan.operators.ordered import column_quantiles
from longspan.session import reused


def _replace(df: DataFrame, new: dict) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])


@dataclass
class Standardizer:
    """(x - mean) / population std; a zero or missing std counts as 1."""

    columns: Sequence[str]
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    fitted: bool = False

    def fit(self, frame: DataFrame) -> "Standardizer":
        stats = []
        for i, c in enumerate(self.columns):
            x = null_if_nan(F.col(c).cast("double"))
            stats += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
        row = frame.agg(*stats).first()
        self.means = {c: row[f"m{i}"] for i, c in enumerate(self.columns)}
        self.stds = {c: row[f"s{i}"] if row[f"s{i}"] else 1.0 for i, c in enumerate(self.columns)}
        self.fitted = True
        return self

    def transform(self, frame: DataFrame) -> DataFrame:
        if not self.fitted:
            raise RuntimeError("Standardizer must be fitted before transform")
        new = {
            c: (F.col(c).cast("double") - F.lit(self.means[c]).cast("double")) / F.lit(float(self.stds[c]))
            for c in self.columns
        }
        return _replace(frame, new)

    def fit_transform(self, frame: DataFrame) -> DataFrame:
        return self.fit(frame).transform(frame)


@dataclass
class MedianImputer:
    """Fill NULLs with exact training medians; an all-NULL column fills with ``empty``."""

    columns: Sequence[str]
    empty: float | None = None
    medians: dict[str, float | None] = field(default_factory=dict)

    def fit(self, frame: DataFrame) -> "MedianImputer":
        clean = frame.select(*[null_if_nan(F.col(c).cast("double")).alias(c) for c in self.columns])
        found = column_quantiles(clean, self.columns, [0.5])
        self.medians = {c: self.empty if found[c][0] is None else found[c][0] for c in self.columns}
        return self

    def transform(self, frame: DataFrame) -> DataFrame:
        if not self.medians:
            raise RuntimeError("MedianImputer must be fitted before transform")
        new = {
            c: F.coalesce(null_if_nan(F.col(c).cast("double")), F.lit(self.medians[c]).cast("double"))
            for c in self.columns
        }
        return _replace(frame, new)

    def fit_transform(self, frame: DataFrame) -> DataFrame:
        return self.fit(frame).transform(frame)


@dataclass
class BatchCorrector:
    """Location and scale correction per batch, covariates preserved.

    ``mode='reference'`` takes batch statistics from covariate residuals and
    applies them to raw values, ``(x - m_b) / s_b * s + m``. ``mode='residual'``
    corrects the residual and adds the covariate effect back. An unseen batch
    uses m_b = 0, s_b = 1.
    """

    batch: str = "cohort"
    features: Sequence[str] = ()
    covariates: Sequence[str] = ("age", "sex_binary")
    mode: str = "reference"
    grand: dict[str, tuple[float, float]] = field(default_factory=dict)
    effects: dict[str, list[float]] = field(default_factory=dict)
    pooled_std: dict[str, float] = field(default_factory=dict)
    batch_stats: DataFrame | None = None

    def _present(self, frame: DataFrame) -> list[str]:
        return [c for c in self.covariates if c in frame.columns]

    def _effect(self, present: Sequence[str], feature: str):
        beta = self.effects[feature]
        terms = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(b) for c, b in zip(present, beta)]
        return sum(terms, F.lit(beta[-1]))

    def fit(self, frame: DataFrame) -> "BatchCorrector":
        present = self._present(frame)
        # Batch statistics stay a plan over the caller's frame; the passes before share a narrow copy.
        source = frame
        with reused(frame.select(*dict.fromkeys([self.batch, *self.features, *present]))) as frame:
            residual = self._fit_covariates(frame, present)
            if self.mode == "residual":
                stats = [F.stddev_samp(residual[f]).alias(f"p{i}") for i, f in enumerate(self.features)]
                row = frame.agg(*stats).first()
                self.pooled_std = {f: row[f"p{i}"] or 1.0 for i, f in enumerate(self.features)}
        staged = source.select(F.col(self.batch).alias("__batch"), *[residual[f].alias(f) for f in self.features])
        aggs = []
        for i, f in enumerate(self.features):
            std = F.stddev_samp(f)
            aggs += [F.avg(f).alias(f"__m{i}"), F.when(std > 0, std).otherwise(1.0).alias(f"__s{i}")]
        self.batch_stats = staged.groupBy("__batch").agg(*aggs)
        return self

    def _fit_covariates(self, frame: DataFrame, present: Sequence[str]) -> dict:
        stats = []
        for i, f in enumerate(self.features):
            stats += [F.avg(f).alias(f"m{i}"), F.stddev_samp(f).alias(f"s{i}")]
        row = frame.agg(*stats).first()
        self.grand = {f: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, f in enumerate(self.features)}
        residual = {f: F.col(f).cast("double") for f in self.features}
        self.effects = {}
        if present:
            medians = column_quantiles(frame, list(self.features), [0.5])
            filled = [F.coalesce(F.col(f).cast("double"), F.lit(medians[f][0]).cast("double")) for f in self.features]
            x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in present] + [F.lit(1.0)]
            # One pass gives X'X and X'y for every feature.
            gram, _ = cross_products(frame, x + filled)
            q = len(x)
            for i, f in enumerate(self.features):
                beta = np.linalg.pinv(gram[:q, :q]) @ gram[:q, q + i]
                self.effects[f] = [float(b) for b in beta]
                residual[f] = filled[i] - self._effect(present, f)
        return residual

    def transform(self, frame: DataFrame) -> DataFrame:
        if self.batch_stats is None:
            raise RuntimeError("BatchCorrector must be fitted before transform")
        present = self._present(frame)
        joined = frame.join(self.batch_stats, F.col(self.batch) == F.col("__batch"), "left")
        new = {}
        for i, f in enumerate(self.features):
            mean, std = self.grand[f]
            m_b, s_b = F.coalesce(f"__m{i}", F.lit(0.0)), F.coalesce(f"__s{i}", F.lit(1.0))
            if self.mode == "residual" and self.effects:
                effect = self._effect(present, f)
                new[f] = effect + (F.col(f) - effect - m_b) / s_b * F.lit(self.pooled_std[f])
            else:
                new[f] = (F.col(f).cast("double") - m_b) / s_b * F.lit(std) + F.lit(mean)
        return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in frame.columns])

    def fit_transform(self, frame: DataFrame) -> DataFrame:
        return self.fit(frame).transform(frame)

    def diagnostics(self, frame: DataFrame) -> DataFrame:
        return batch_diagnostics(frame, self.batch, self.features).withColumn(
            "harmonised", F.lit(self.batch_stats is not None)
        )


def batch_diagnostics(frame: DataFrame, batch: str, features: Sequence[str]) -> DataFrame:
    """Mean, sample std and missing rate per batch and feature."""
    long = frame.select(
        F.col(batch).alias("batch"),
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
        ).alias("cell"),
    ).select("batch", "cell.feature", "cell.value")
    return long.groupBy("batch", "feature").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"),
    )
