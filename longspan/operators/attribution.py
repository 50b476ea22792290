"""Per-row feature attributions and their summaries.

Linear models have an exact attribution, coefficient x standardised value.
Other models use occlusion: the score drop when a feature is set to its
training median.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def linear_attribution(standardized: DataFrame, coefficients: Mapping[str, float], keys: Sequence[str] = ("participant_id",)) -> DataFrame:
    """One attribution column per feature of a standardised frame."""
    return standardized.select(*keys, *[(F.col(c) * F.lit(float(b))).alias(c) for c, b in coefficients.items()])


def occlusion_attribution(
    frame: DataFrame,
    medians: Mapping[str, float],
    score: Callable[[DataFrame], DataFrame],
    keys: Sequence[str] = ("participant_id",),
    risk: str = "risk",
) -> DataFrame:
    """Score minus score-with-feature-at-median, one column per feature.

    All variants are scored in one exploded pass. ``score`` adds ``risk`` and
    keeps the other columns.
    """
    features = list(medians)
    variants = frame.withColumn("__feature", F.explode(F.array(F.lit("__none"), *[F.lit(f) for f in features])))
    swapped = [
        F.when(F.col("__feature") == c, F.lit(float(medians[c]))).otherwise(F.col(c).cast("double")).alias(c)
        if c in medians
        else F.col(f"`{c}`")
        for c in variants.columns
    ]
    scored = score(variants.select(*swapped)).select(*keys, "__feature", risk)
    own = F.max(F.when(F.col("__feature") == "__none", F.col(risk)))
    return scored.groupBy(*keys).agg(
        *[(own - F.max(F.when(F.col("__feature") == f, F.col(risk)))).alias(f) for f in features]
    )


def global_importance(
    spark: SparkSession,
    features: Sequence[str],
    importances: Sequence[float] | None = None,
    coefficients: Sequence[float] | None = None,
) -> DataFrame:
    """(feature, importance): given importances, else |coefficients|, else uniform; highest first."""
    if importances is not None:
        values = [float(v) for v in importances]
    elif coefficients is not None:
        values = [abs(float(v)) for v in coefficients]
    else:
        values = [1.0 / len(features)] * len(features)
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def broadcast_importance(frame: DataFrame, importance: Mapping[str, float], keys: Sequence[str] = ("participant_id",)) -> DataFrame:
    """The global importances as constant columns on every row."""
    return frame.select(*keys, *[F.lit(float(v)).alias(f) for f, v in importance.items()])


def mean_absolute(attributions: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, importance) as the mean |attribution| over rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(F.col(f)).alias("v")) for f in features]))
    return attributions.select(cells.alias("c")).groupBy(F.col("c.feature").alias("feature")).agg(
        F.avg("c.v").alias("importance")
    )


def by_modality(attributions: DataFrame, groups: Mapping[str, Sequence[str]], keys: Sequence[str] = ("participant_id",)) -> DataFrame:
    """Sum of |attribution| per modality; a modality without features gives 0."""
    present = set(attributions.columns)

    def total(features: Sequence[str]) -> Column:
        return sum((F.abs(F.col(f)) for f in features if f in present), F.lit(0.0))

    return attributions.select(*keys, *[total(f).alias(m) for m, f in groups.items()])


def top_drivers(attributions: DataFrame, features: Sequence[str], k: int = 5, keys: Sequence[str] = ("participant_id",)) -> DataFrame:
    """``feature_i`` and ``value_i`` by |value|, i = 1..k; NULL beyond the features.

    Row-wise array sort; equal sizes keep the feature order.
    """
    cells = F.array(
        *[
            F.struct((-F.abs(F.col(f))).alias("size"), F.lit(i).alias("place"), F.lit(f).alias("feature"), F.col(f).alias("value"))
            for i, f in enumerate(features)
        ]
    )
    ranked = attributions.select(*keys, F.array_sort(cells).alias("__r"))
    columns = []
    for i in range(k):
        item = F.try_element_at("__r", F.lit(i + 1))
        columns += [item["feature"].alias(f"feature_{i + 1}"), item["value"].alias(f"value_{i + 1}")]
    return ranked.select(*keys, *columns)
