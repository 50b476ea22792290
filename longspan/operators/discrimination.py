"""AUROC, average precision and Brier score per group, plain or weighted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.operators.ordered import running

METRICS = ("auroc", "auprc", "brier")


def score_counts(df: DataFrame, y: str, score: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Weighted positives and negatives per group and distinct score (``value``).

    Rows with a NULL label or score are left out. The aggregate combines
    map-side, so a hot group or score costs one row per task in the shuffle.
    """
    weight = F.lit(1.0) if weight is None else weight.cast("double")
    staged = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select(
        *by, F.col(score).cast("double").alias("value"), F.col(y).cast("int").alias("__y"), weight.alias("__w")
    )
    return staged.groupBy(*by, "value").agg(
        F.sum(F.when(F.col("__y") == 1, F.col("__w")).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col("__y") == 1, 0.0).otherwise(F.col("__w"))).alias("neg"),
    )


def metrics_from_counts(
    counts: DataFrame,
    by: Sequence[str] = (),
    min_n: float = 4,
    ranges: int | None = None,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """n, event_rate and the three metrics per group from ``score_counts`` rows.

    Ties get average ranks. Groups under ``min_n`` rows or with one class
    have NULL metrics.
    """
    down = running(
        counts, "value", {"tp": F.col("pos"), "fp": F.col("neg")}, by=by, descending=True, ranges=ranges, edges=edges
    )
    p, n = F.sum("pos"), F.sum("neg")
    beaten = F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2.0))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    squared = F.sum(F.col("pos") * F.pow(1.0 - F.col("value"), F.lit(2.0)) + F.col("neg") * F.pow("value", F.lit(2.0)))
    rows = down.groupBy(*by).agg(
        (p + n).alias("n"),
        p.alias("__p"),
        n.alias("__q"),
        beaten.alias("__beaten"),
        F.sum(F.col("pos") * precision).alias("__precision"),
        squared.alias("__squared"),
    )
    usable = (F.col("n") >= min_n) & (F.col("__p") > 0) & (F.col("__q") > 0)
    return rows.select(
        *by,
        F.col("n"),
        F.try_divide("__p", "n").alias("event_rate"),
        F.when(usable, 1.0 - F.try_divide(F.col("__beaten"), F.col("__p") * F.col("__q"))).alias("auroc"),
        F.when(usable, F.try_divide("__precision", "__p")).alias("auprc"),
        F.when(usable, F.try_divide("__squared", "n")).alias("brier"),
    )


def binary_metrics(
    df: DataFrame,
    y: str,
    score: str,
    by: Sequence[str] = (),
    weight: Column | None = None,
    min_n: float = 4,
    ranges: int | None = None,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Discrimination and Brier score of ``score`` against 0/1 ``y`` per group."""
    return metrics_from_counts(score_counts(df, y, score, by, weight), by, min_n, ranges, edges)


# Report labels of the validation roles.
ROLE_LABELS = {
    "public_validation": "Held-out public cohorts",
    "india_validation": "TLSA adaptation check",
    "external_validation": "SANSCOG external validation",
}
INDIAN_ROLES = ("india_validation", "external_validation")


def metrics_by_role(predictions: DataFrame, y: str = "event_by_3y", score: str = "risk_3y") -> DataFrame:
    """Metrics per validation role; participants and event rate count unscored people too."""
    valid = predictions.where(F.col("role").isin(*ROLE_LABELS))
    sizes = valid.groupBy("role").agg(F.count(F.lit(1)).alias("participants"), F.avg(y).alias("event_rate"))
    scored = binary_metrics(valid, y, score, ["role"]).select("role", *METRICS)
    label = F.coalesce(*[F.when(F.col("role") == r, text) for r, text in ROLE_LABELS.items()])
    return sizes.join(scored, "role", "left").select(
        label.alias("validation_set"), "participants", "event_rate", *METRICS
    )


def subgroup_dimensions() -> dict[str, Column]:
    age = F.col("age")
    return {
        "Sex": F.col("sex"),
        "Age": F.when((age > 0) & (age <= 64), "≤64").when((age > 64) & (age <= 72), "65–72").when(
            (age > 72) & (age <= 120), "73+"
        ),
        "Education": F.when(F.col("education_years") <= 10, "≤10 years").otherwise(">10 years"),
        "Setting": F.col("urban_rural"),
    }


def subgroup_metrics(
    predictions: DataFrame, y: str = "event_by_3y", score: str = "risk_3y", dimensions: Mapping[str, Column] | None = None
) -> DataFrame:
    """Metrics per (dimension, group) over the Indian validation roles.

    Every person is stacked once per dimension, so one aggregate serves all.
    """
    dims = F.explode(
        F.array(
            *[
                F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("group"))
                for d, c in (dimensions or subgroup_dimensions()).items()
            ]
        )
    )
    long = (
        predictions.where(F.col("role").isin(*INDIAN_ROLES))
        .select(F.col(y).alias("__y"), F.col(score).alias("__score"), dims.alias("d"))
        .where(F.col("d.group").isNotNull())
        .select("__y", "__score", "d.dimension", "d.group")
    )
    keys = ["dimension", "group"]
    sizes = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("participants"), F.avg("__y").alias("event_rate"))
    return sizes.join(binary_metrics(long, "__y", "__score", keys).select(*keys, *METRICS), keys, "left")


# Scenario -> model groups left out.
ABLATION_SCENARIOS = {
    "Full multimodal": (),
    "Without MRI": ("MRI",),
    "Without blood": ("Blood",),
    "Without OCT/OCTA": ("OCT/OCTA",),
    "Without genomics": ("Genomics",),
    "Cognition + clinical only": ("MRI", "Blood", "OCT/OCTA", "Genomics"),
}


def with_delta_to_full(metrics: DataFrame, full: str = "Full multimodal") -> DataFrame:
    """Add the AUPRC difference to the full scenario (one row per scenario)."""
    base = metrics.where(F.col("scenario") == full).select("auprc").scalar()
    return metrics.select("*", (F.col("auprc") - base).alias("auprc_delta"))
