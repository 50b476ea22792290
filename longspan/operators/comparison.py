"""Comparing models: paired AUC test, bootstrap intervals, report tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.functions.columns import erfc
from longspan.operators.discrimination import METRICS
from longspan.operators.ordered import running
from longspan.operators.resampling import replicate_metrics


def two_sided_p(z: Column) -> Column:
    """Two-sided normal tail of |z|, without the cancellation of 1 - cdf."""
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def _placements(rows: DataFrame, score: str, by: Sequence[str], out: str) -> DataFrame:
    """Share of the other class each row beats (positives) or is beaten by (negatives); ``__m`` and ``__n`` are the class sizes."""
    m, n = F.col("__m"), F.col("__n")
    counts = rows.groupBy(*by, score, "__m", "__n").agg(
        F.sum(F.col("__y") * F.col("__w")).alias("__pos"), F.sum((1 - F.col("__y")) * F.col("__w")).alias("__neg")
    )
    up = running(counts, score, {"__pos_upto": F.col("__pos"), "__neg_upto": F.col("__neg")}, by=by)
    table = up.select(
        *by,
        score,
        F.try_divide(F.col("__neg_upto") - F.col("__neg") / 2.0, n).alias("__beats"),
        F.try_divide(m - F.col("__pos_upto") + F.col("__pos") / 2.0, m).alias("__beaten"),
    )
    return rows.join(table, [*by, score]).select(
        *rows.columns, F.when(F.col("__y") == 1, F.col("__beats")).otherwise(F.col("__beaten")).alias(out)
    )


def delong_components(frame: DataFrame, y: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """auc_a, auc_b, variance, z, m, n and the two-sided p_value, one row per group.

    Variance 0 has no z and a p_value of 1; a group with one class has neither. Rows with a NULL group are left out.

    Placement values come from running class counts over distinct scores, so
    no positive-negative pair is formed. Equal (label, a, b) rows are counted
    once before anything else.
    """
    by = list(by)
    usable = frame.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).dropna(subset=by) if by else frame.where(
        F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
    )
    rows = (
        usable.groupBy(*by, F.col(y).cast("int").alias("__y"), F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"))
        .agg(F.count(F.lit(1)).cast("double").alias("__w"))
    )
    sizes = rows.groupBy(*by).agg(F.sum(F.col("__y") * F.col("__w")).alias("__m"), F.sum((1 - F.col("__y")) * F.col("__w")).alias("__n"))
    if by:
        rows = rows.join(sizes, by)
    else:
        rows = rows.select("*", sizes.select("__m").scalar().alias("__m"), sizes.select("__n").scalar().alias("__n"))
    placed = _placements(_placements(rows, "__a", by, "__va"), "__b", by, "__vb")
    w, d = F.col("__w"), F.col("__va") - F.col("__vb")
    pos, neg = F.when(F.col("__y") == 1, w), F.when(F.col("__y") == 0, w)
    sums = placed.groupBy(*by).agg(
        F.coalesce(F.sum(pos), F.lit(0.0)).alias("m"),
        F.coalesce(F.sum(neg), F.lit(0.0)).alias("n"),
        F.sum(pos * F.col("__va")).alias("a"),
        F.sum(pos * F.col("__vb")).alias("b"),
        F.sum(pos * d).alias("dp"),
        F.sum(pos * d * d).alias("dp2"),
        F.sum(neg * d).alias("dn"),
        F.sum(neg * d * d).alias("dn2"),
    )

    def sample_variance(s1: str, s2: str, k: str) -> Column:
        spread = F.col(s2) - F.try_divide(F.col(s1) * F.col(s1), F.col(k))
        return F.when(F.col(k) > 1, F.greatest(spread, F.lit(0.0)) / (F.col(k) - 1)).otherwise(0.0)

    variance = F.try_divide(sample_variance("dp", "dp2", "m"), F.col("m")) + F.try_divide(
        sample_variance("dn", "dn2", "n"), F.col("n")
    )
    auc_a, auc_b = F.try_divide("a", "m"), F.try_divide("b", "m")
    z = F.when(variance > 0, (auc_a - auc_b) / F.sqrt(variance))
    both_classes = (F.col("m") > 0) & (F.col("n") > 0)
    return sums.select(
        *by,
        auc_a.alias("auc_a"),
        auc_b.alias("auc_b"),
        variance.alias("variance"),
        z.alias("z"),
        F.col("m").cast("long").alias("m"),
        F.col("n").cast("long").alias("n"),
        F.when(both_classes, F.coalesce(two_sided_p(z), F.lit(1.0))).alias("p_value"),
    )


def delong_test(frame: DataFrame, y: str, a: str, b: str) -> float:
    """Two-sided p-value; variance 0 gives 1, one class raises."""
    row = delong_components(frame, y, a, b).first()
    if row is None or not row.m or not row.n:
        raise ValueError("Requires both positive and negative samples.")
    return row.p_value


def _unit(frame: DataFrame, key: Column | None) -> Column:
    """Integer that draws a row's weights: the given key, or a hash of the whole row."""
    return F.xxhash64(*frame.columns) if key is None else key


def bootstrap_comparison(
    frame: DataFrame,
    y: str,
    a: str,
    b: str,
    metric: str = "auroc",
    n_bootstrap: int = 1000,
    seed: int = 42,
    key: Column | None = None,
) -> DataFrame:
    """One row: delta (a minus b), p_value, ci_lower, ci_upper.

    Replicates weigh rows by Poisson(1); replicates without a metric are left
    out. The quantiles run over at most ``n_bootstrap`` values.
    """
    if metric not in METRICS:
        raise ValueError(f"Unknown metric: {metric}")
    per = replicate_metrics(frame, y, list(dict.fromkeys([a, b])), n_bootstrap, seed, _unit(frame, key), metric == "auprc")
    wide = per.groupBy("replicate").agg(
        F.max(F.when(F.col("model") == a, F.col(metric))).alias("a"), F.max(F.when(F.col("model") == b, F.col(metric))).alias("b")
    ).select("replicate", (F.col("a") - F.col("b")).alias("diff"))
    drawn = F.when(F.col("replicate") >= 0, F.col("diff"))
    summary = wide.agg(
        F.max(F.when(F.col("replicate") == -1, F.col("diff"))).alias("delta"),
        F.avg((drawn <= 0).cast("double")).alias("below"),
        F.avg((drawn >= 0).cast("double")).alias("above"),
        F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975))).alias("q"),
    )
    one_sided = F.when(F.col("delta") > 0, F.col("below")).otherwise(F.col("above"))
    return summary.select(
        "delta",
        F.least(one_sided * 2.0, F.lit(1.0)).alias("p_value"),
        F.col("q")[0].alias("ci_lower"),
        F.col("q")[1].alias("ci_upper"),
    )


def bootstrap_interval(
    frame: DataFrame,
    y: str,
    score: str,
    metric: str = "auroc",
    n_bootstrap: int = 200,
    seed: int = 42,
    level: float = 0.95,
    key: Column | None = None,
) -> DataFrame:
    """One row: point, lower, upper of one metric."""
    if metric not in METRICS:
        raise ValueError(f"Unknown metric: {metric}")
    per = replicate_metrics(frame, y, [score], n_bootstrap, seed, _unit(frame, key), metric == "auprc")
    drawn = F.when(F.col("replicate") >= 0, F.col(metric))
    edges = F.array(F.lit((1.0 - level) / 2.0), F.lit((1.0 + level) / 2.0))
    return per.agg(
        F.max(F.when(F.col("replicate") == -1, F.col(metric))).alias("point"), F.percentile(drawn, edges).alias("q")
    ).select("point", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


@dataclass(frozen=True)
class ModelReport:
    """Metrics of one model on one cohort."""

    model_name: str
    metrics: dict[str, float]
    cohort: str


def report_rows(spark: SparkSession, reports: Sequence[ModelReport]) -> DataFrame:
    """Long rows (position, model_name, cohort, metric, value)."""
    rows = [
        (i, r.model_name, r.cohort, name, None if value is None else float(value))
        for i, r in enumerate(reports)
        for name, value in r.metrics.items()
    ]
    return spark.createDataFrame(rows, "position int, model_name string, cohort string, metric string, value double")


def compare_models(reports: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per (model, cohort) with one column per metric."""
    return reports.groupBy("model_name", "cohort").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    )


def best_model(reports: DataFrame, metric: str = "auroc", by_cohort: bool = True) -> DataFrame:
    """Best model per cohort by a metric; the earliest report wins ties."""
    rows = reports.where((F.col("metric") == metric) & F.col("value").isNotNull())
    order = F.struct(F.col("value"), -F.col("position"))
    keys = ["cohort"] if by_cohort else []
    return rows.groupBy(*keys).agg(F.max_by("model_name", order).alias("model_name"), F.max("value").alias("value"))


def select_best_model(reports: DataFrame, metric: str = "auroc", validation_set: str = "external") -> str | None:
    row = best_model(reports.where(F.col("cohort") == validation_set), metric).first()
    return None if row is None else row.model_name
