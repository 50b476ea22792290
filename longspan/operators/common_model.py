"""Building blocks of the common data model: unpivot, pivot, units, states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.functions.columns import as_column, coerce_number, map_codes
from longspan.sources import contracts

# Conversions (cohort, feature) -> (source unit, factor, offset, note); value = source * factor + offset.
UNIT_CONVERSIONS = {
    ("AIBL", "hippocampal_volume_mm3"): ("cm3", 1000.0, 0.0, "cm3 x 1000 -> mm3"),
    ("OASIS", "hippocampal_volume_mm3"): ("cm3", 1000.0, 0.0, "cm3 x 1000 -> mm3"),
    ("UK Biobank", "hba1c_percent"): ("mmol/mol", 1.0 / 10.929, 2.15, "IFCC / 10.929 + 2.15 -> %"),
    ("OASIS", "rnfl_um"): ("mm", 1000.0, 0.0, "mm x 1000 -> um"),
}
PROVENANCE = "common_model_mapping_v1"


def days_since_first(
    df: DataFrame, date: str, by: str = "participant_id", out: str = "baseline_days", missing: int | None = None
) -> DataFrame:
    """Days since the group's first date.

    The first date is a hash aggregate joined back, so a participant with very
    many rows is combined map-side and split by the skew join.
    """
    first = df.groupBy(F.col(by).alias("__group")).agg(F.min(date).alias("__first"))
    days = F.date_diff(F.col(date), F.col("__first"))
    if missing is not None:
        days = F.coalesce(days, F.lit(missing))
    # Rows without a group are a group of their own.
    joined = df.drop(out).join(first, F.col(by).eqNullSafe(F.col("__group")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != out], days.alias(out))


def long_measurements(df: DataFrame, measures: Mapping[str, tuple[str, str, str]], cohort: str) -> DataFrame:
    """Unpivot source columns to one row per non-null value; absent columns are skipped."""
    cells = [
        F.struct(
            F.lit(modality).alias("modality"),
            F.lit(feature).alias("feature_name"),
            coerce_number(f"`{source}`").alias("value"),
            F.lit(unit).alias("unit"),
            F.lit(source).alias("source_variable"),
        )
        for source, (modality, feature, unit) in measures.items()
        if source in df.columns
    ]
    if not cells:
        empty = df.select("participant_id", "visit_id").limit(0)
        cells = [
            F.struct(
                F.lit("").alias("modality"), F.lit("").alias("feature_name"), F.lit(0.0).alias("value"),
                F.lit("").alias("unit"), F.lit("").alias("source_variable"),
            )
        ]
        df = empty
    return (
        df.select("participant_id", "visit_id", F.explode(F.array(*cells)).alias("cell"))
        .where(F.col("cell.value").isNotNull())
        .select(
            F.concat("visit_id", F.lit("-"), F.col("cell.feature_name")).alias("feature_row_id"),
            "participant_id",
            "visit_id",
            F.lit(cohort).alias("cohort"),
            "cell.modality",
            "cell.feature_name",
            "cell.value",
            "cell.unit",
            "cell.source_variable",
            F.lit("pass").alias("qc_flag"),
            F.lit(False).alias("derived"),
        )
    )


def pivot_features(
    features: DataFrame, names: Sequence[str], keys: Sequence[str], order: str = "feature_row_id"
) -> DataFrame:
    """Long to wide in one aggregate; the first value by ``order`` wins.

    ``names`` is given, so no extra job looks for the distinct names, and the
    output schema is fixed. ``order`` should be unique within a cell; a
    numeric one keeps the buffers primitive, and so the aggregate hash-based.
    """
    if not names:
        return features.select(*keys).limit(0)
    ordering = F.col(order)
    return features.where(F.col("feature_name").isin(*names)).groupBy(*keys).agg(
        *[
            F.min_by("value", F.when(F.col("feature_name") == name, ordering)).alias(name)
            for name in names
        ]
    )


#: Places of the marks that ``may_match`` sets: at most half a million rows of 64 marks, 8 MB.
MARK_PLACES = 1 << 25


def may_match(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """``rows`` without most of those whose key is not among ``wanted``, before a join moves them.

    A wanted key marks one place by its hash; rows whose place has no mark go, in the task that reads them. Rows of
    other keys that share a marked place stay, so the join itself must follow.
    """
    place = lambda name: F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(MARK_PLACES))
    marks = wanted.select(place(wanted_key).alias("__place")).groupBy(F.shiftright("__place", 6).alias("__word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(__place & 63 as int))")).alias("__marks")
    )
    own = place(key)
    marked = F.getbit("__marks", own.bitwiseAND(F.lit(63)).cast("int")) == 1
    return rows.join(F.broadcast(marks), (F.shiftright(own, 6) == F.col("__word")) & marked, "left_semi")


def unit_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(c, f, u, m, o, note) for (c, f), (u, m, o, note) in UNIT_CONVERSIONS.items()],
        "cohort string, feature_name string, source_unit string, factor double, offset double, conversion string",
    )


def to_canonical_units(features: DataFrame, value: str = "source_value") -> DataFrame:
    """Convert native values by a broadcast table of (cohort, feature) factors; others are identity."""
    units = F.broadcast(unit_table(features.sparkSession))
    canonical = map_codes("feature_name", {f: spec[1] for f, spec in contracts.FEATURES.items()})
    return (
        features.join(units, ["cohort", "feature_name"], "left")
        .withColumn("value", F.col(value) * F.coalesce("factor", F.lit(1.0)) + F.coalesce("offset", F.lit(0.0)))
        .withColumn("source_unit", F.coalesce("source_unit", canonical))
        .withColumn("unit", canonical)
        .withColumn("conversion", F.coalesce("conversion", F.lit("identity")))
        .drop("factor", "offset")
    )


def harmonisation_manifest(spark: SparkSession) -> DataFrame:
    """Cohort x feature mapping evidence: alias, units, conversion, provenance."""
    features = spark.createDataFrame(
        [(f, m, u, s) for f, (m, u, s) in contracts.FEATURES.items()],
        "canonical_feature string, modality string, canonical_unit string, short_name string",
    )
    grid = features.withColumn("cohort", F.explode(F.array(*[F.lit(c) for c in contracts.COHORTS])))
    units = unit_table(spark).withColumnRenamed("feature_name", "canonical_feature").drop("factor", "offset")
    return grid.join(F.broadcast(units), ["cohort", "canonical_feature"], "left").select(
        "cohort",
        F.concat(F.lower(F.replace("cohort", F.lit(" "), F.lit("_"))), F.lit("_"), "short_name").alias("source_variable"),
        "canonical_feature",
        "modality",
        F.coalesce("source_unit", "canonical_unit").alias("source_unit"),
        "canonical_unit",
        F.coalesce("conversion", F.lit("identity")).alias("conversion"),
        F.lit(PROVENANCE).alias("provenance"),
    )


def state_from_score(score: Column | str, progressed: Column) -> Column:
    """Diagnostic state by score thresholds and whether the person progressed."""
    score = as_column(score)
    return (
        F.when((score < 19.5) | (progressed & (score < 22.0)), "dementia")
        .when((score < 25.5) | progressed, "mci")
        .otherwise("cognitively_unimpaired")
    )


def severity_from_state(state: Column | str) -> Column:
    state = as_column(state)
    return F.when(state == "cognitively_unimpaired", 0.0).when(state == "mci", 0.5).otherwise(1.0)


def setting_of_cohort(cohort: Column | str) -> Column:
    return map_codes(cohort, contracts.COHORT_SETTINGS, "reference")


def model_indicators() -> list[Column]:
    return [
        (F.col("sex") == "Male").cast("int").alias("sex_binary"),
        (F.col("urban_rural") == "rural").cast("int").alias("rural_indicator"),
    ]


def baseline_wide(
    participants: DataFrame,
    visits: DataFrame | None,
    features: DataFrame,
    survival: DataFrame,
    order: str = "feature_row_id",
) -> DataFrame:
    """One row per participant: first-visit features, demographics, event labels.

    ``survival`` has participant_id, event, event_time_days. Without ``visits`` the rows of ``features`` are
    those of first visits already, chosen before they were unfolded.
    """
    if visits is not None:
        first = visits.where(F.col("visit_index") == 0).select("visit_id")
        features = features.join(first, "visit_id", "left_semi")
    wide = pivot_features(features, list(contracts.FEATURES), ["participant_id"], order)
    labels = survival.select("participant_id", "event", "event_time_days", *horizon_labels())
    return (
        participants.select("*", *model_indicators())
        .join(labels, "participant_id")
        .join(wide, "participant_id", "left")
    )


def horizon_labels(years: Sequence[int] = contracts.HORIZON_YEARS) -> list[Column]:
    """``event_by_<h>y``: the event happened within h years of baseline."""
    return [
        F.when((F.col("event") == 1) & (F.col("event_time_days") / 365.25 <= h), 1).otherwise(0).alias(f"event_by_{h}y")
        for h in years
    ]


def trajectory_series(visits: DataFrame, features: DataFrame, score: str = "cognitive_score") -> DataFrame:
    """Score per visit with years since baseline, floored at zero."""
    scores = features.where(F.col("feature_name") == score).select("visit_id", F.col("value").alias(score))
    return visits.join(scores, "visit_id").select(
        "participant_id",
        "visit_id",
        "visit_index",
        F.greatest(F.col("baseline_days") / 365.25, F.lit(0.0)).alias("year"),
        score,
        "diagnosis",
    )


def cohort_summary(baseline: DataFrame) -> DataFrame:
    role = (
        F.when(F.col("cohort").isin(*contracts.PUBLIC_COHORTS), "Development")
        .when(F.col("cohort") == contracts.ADAPTATION_COHORT, "India adaptation")
        .otherwise("External India validation")
    )
    return baseline.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("participants"), F.avg("event_by_5y").alias("five_year_event_rate")
    ).select("cohort", "participants", role.alias("role"), setting_of_cohort("cohort").alias("setting"), "five_year_event_rate")
