"""Wide features per modality, their derived columns, and availability."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.functions.columns import any_present, flag, mean_ignoring_nulls
from longspan.operators.common_model import pivot_features
from longspan.operators.ordered import column_quantiles
from longspan.sources import contracts

KEYS = ("participant_id", "visit_id")

# Clinical cut-offs.
PREDIABETES_HBA1C = 5.7
GLUCOSE_HIGH = 100
CHOLESTEROL_HIGH = 240
CRP_HIGH = 3.0
RNFL_THIN, RNFL_SEVERE = 85, 75
VESSEL_DENSITY_LOW = 44
FAZ_LARGE = 0.35
WMH_SEVERE = 6.0
SCORE_IMPAIRED, SCORE_MILD = 24.0, 27.0
E4_LOG_ODDS = 0.47
ANCESTRY_SOUTH_ASIAN, ANCESTRY_NON_EUROPEAN = 0.5, 0.3
HIPPOCAMPUS_FLOOR = 100


def modality_names(features: DataFrame, modality: str) -> list[str]:
    """Feature names present in one modality; a short dictionary, sorted."""
    rows = features.where(F.col("modality") == modality).select("feature_name").distinct().collect()
    return sorted(r.feature_name for r in rows)


def pivot_modality(
    features: DataFrame, modality: str, names: Sequence[str] | None = None, order: str = "feature_row_id"
) -> DataFrame:
    """One row per participant and visit with one column per feature of the modality.

    Pass ``names`` to save the job that lists them.
    """
    names = modality_names(features, modality) if names is None else sorted(names)
    return pivot_features(features.where(F.col("modality") == modality), names, KEYS, order)


def add_missingness_indicators(frame: DataFrame, protected: Sequence[str] = ()) -> DataFrame:
    """``<column>__missing`` 0/1 for every unprotected column, in one projection."""
    protected = set(protected)
    return frame.select(
        "*", *[F.col(f"`{c}`").isNull().cast("int").alias(f"{c}__missing") for c in frame.columns if c not in protected]
    )


def _inverted_zscore(column: str) -> Column:
    """Minus the global z-score, from the statistics ``derive_mri`` puts on the row."""
    mean, std = F.col(f"__stats.{column}_mean"), F.col(f"__stats.{column}_std")
    return -((F.col(column) - mean) / F.when(std > 0, std).otherwise(1.0))


def derive_cognition(wide: DataFrame) -> DataFrame:
    new = []
    scores = [c for c in wide.columns if c.endswith("_score") and c != "cognitive_score"]
    if scores:
        new.append(mean_ignoring_nulls(scores).alias("domain_composite_z"))
    if "cognitive_score" in wide.columns:
        score = F.col("cognitive_score")
        new.append(flag(score < SCORE_IMPAIRED).alias("cognitive_impairment_flag"))
        new.append(flag((score >= SCORE_IMPAIRED) & (score < SCORE_MILD)).alias("mild_impairment_flag"))
    return wide.select("*", *new)


def derive_mri(wide: DataFrame) -> DataFrame:
    new = []
    has = set(wide.columns)
    # All statistics come from one scalar subquery, so the wide table is aggregated once.
    scaled = [c for c in ("hippocampal_volume_mm3", "cortical_thickness_mean_mm") if c in has]
    stats = [s for c in scaled for s in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    staged = wide.withColumn("__stats", wide.agg(F.struct(*stats).alias("s")).scalar()) if stats else wide
    if "hippocampal_volume_mm3" in has:
        new.append(_inverted_zscore("hippocampal_volume_mm3").alias("hippo_atrophy_z"))
    if {"ventricular_volume_mm3", "hippocampal_volume_mm3"} <= has:
        hippocampus = F.col("hippocampal_volume_mm3")
        floored = F.when(hippocampus.isNotNull(), F.greatest(hippocampus, F.lit(float(HIPPOCAMPUS_FLOOR))))
        new.append((F.col("ventricular_volume_mm3") / floored).alias("vent_hippo_ratio"))
    if "cortical_thickness_mean_mm" in has:
        new.append(_inverted_zscore("cortical_thickness_mean_mm").alias("cortical_thinning_z"))
    if "wmh_burden_ml" in has:
        new.append(flag(F.col("wmh_burden_ml") > WMH_SEVERE).alias("wmh_severe"))
    return staged.select(*wide.columns, *new)


def derive_blood(wide: DataFrame) -> DataFrame:
    new, counted = [], []
    has = set(wide.columns)
    if "hba1c_percent" in has:
        new.append(flag(F.col("hba1c_percent") >= PREDIABETES_HBA1C).alias("prediabetic_flag"))
        counted.append(flag(F.col("hba1c_percent") > PREDIABETES_HBA1C))
    if "fasting_glucose_mg_dl" in has:
        counted.append(flag(F.col("fasting_glucose_mg_dl") > GLUCOSE_HIGH))
    if "total_cholesterol_mg_dl" in has:
        high = flag(F.col("total_cholesterol_mg_dl") > CHOLESTEROL_HIGH)
        new.append(high.alias("high_cholesterol_flag"))
        counted.append(high)
    if counted:
        new.append(sum(counted[1:], counted[0]).alias("metabolic_risk_count"))
    if "hs_crp_mg_l" in has:
        new.append(F.log1p("hs_crp_mg_l").alias("log_crp"))
        new.append(flag(F.col("hs_crp_mg_l") > CRP_HIGH).alias("high_inflammation"))
    return wide.select("*", *new)


def derive_retina(wide: DataFrame) -> DataFrame:
    new, counted = [], []
    has = set(wide.columns)
    if "rnfl_um" in has:
        thin = flag(F.col("rnfl_um") < RNFL_THIN)
        new += [thin.alias("rnfl_thin"), flag(F.col("rnfl_um") < RNFL_SEVERE).alias("rnfl_severe_thin")]
        counted.append(thin)
    if "vessel_density_percent" in has:
        low = flag(F.col("vessel_density_percent") < VESSEL_DENSITY_LOW)
        new.append(low.alias("low_vessel_density"))
        counted.append(low)
    if "gfaz_area_mm2" in has:
        large = flag(F.col("gfaz_area_mm2") > FAZ_LARGE)
        new.append(large.alias("enlarged_faz"))
        counted.append(large)
    if counted:
        new.append(sum(counted[1:], counted[0]).alias("retinal_risk_count"))
    return wide.select("*", *new)


def derive_genomics(wide: DataFrame) -> DataFrame:
    new = []
    if "apoe_e4_count" in wide.columns:
        alleles = F.col("apoe_e4_count")
        new += [
            flag(alleles > 0).alias("apoe_e4_carrier"),
            flag(alleles == 2).alias("apoe_e4_homozygous"),
            (alleles * E4_LOG_ODDS).alias("ad_prs_proxy"),
        ]
    if "ancestry_pc1" in wide.columns:
        pc1 = F.col("ancestry_pc1")
        new += [
            flag(pc1 > ANCESTRY_SOUTH_ASIAN).alias("indian_ancestry_flag"),
            flag(F.abs(pc1) > ANCESTRY_NON_EUROPEAN).alias("non_european_ancestry"),
        ]
    return wide.select("*", *new)


DERIVED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "cognition": derive_cognition,
    "mri": derive_mri,
    "biochem": derive_blood,
    "oct": derive_retina,
    "genomics": derive_genomics,
}


def build_modality(
    features: DataFrame, modality: str, names: Sequence[str] | None = None, order: str = "feature_row_id"
) -> DataFrame:
    """Pivot one modality and add its derived columns."""
    return DERIVED[modality](pivot_modality(features, modality, names, order))


def group_available(group: str, groups: dict[str, Sequence[str]] | None = None) -> Column:
    """Is the model group present: the clinical group by its score, others by any feature."""
    if group == contracts.CLINICAL_GROUP:
        return F.col("cognitive_score").isNotNull()
    return any_present((groups or contracts.MODEL_GROUPS)[group])


def training_ranges(train: DataFrame, features: Sequence[str] = contracts.MODEL_FEATURES) -> dict[str, tuple[float, float]]:
    """Exact 1 % and 99 % quantiles of every feature that has values."""
    found = column_quantiles(train, list(features), [0.01, 0.99])
    return {f: (low, high) for f, (low, high) in found.items() if low is not None}


def missingness_by_cohort(baseline: DataFrame) -> DataFrame:
    """Share of participants without any feature of a group, per cohort and group."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(g).alias("modality"), any_present(features).alias("present"))
                for g, features in contracts.MODEL_GROUPS.items()
            ]
        )
    )
    return (
        baseline.select("cohort", cells.alias("cell"))
        .groupBy("cohort", F.col("cell.modality").alias("modality"))
        .agg((1.0 - F.avg(F.col("cell.present").cast("double"))).alias("missing_rate"))
    )
