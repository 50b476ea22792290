"""Leakage and ordering checks.

Checks come in pairs: ``*_violations`` returns the offending rows as a plan,
``require_*`` runs it and raises.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.functions.columns import coerce_date
from longspan.operators.common_model import days_since_first
from longspan.sources import contracts


def add_baseline_offsets(visits: DataFrame, participant: str = "participant_id", date: str = "visit_date") -> DataFrame:
    """Parse the date column and add whole days since the participant's first date."""
    parsed = visits.withColumn(date, coerce_date(date))
    return days_since_first(parsed, date, by=participant)


def order_violations(
    visits: DataFrame,
    order: str,
    sequence: str,
    participant: str = "participant_id",
    span: Column | None = None,
) -> DataFrame:
    """Rows whose ``order`` value is below the previous row's in ``sequence``.

    ``span`` is an optional column monotone in ``sequence`` (for example
    ``floor(sequence / 1000)``): a participant with very many rows is then
    checked span by span, plus once across span borders.
    """
    if span is None:
        w = Window.partitionBy(participant).orderBy(sequence)
        return visits.select("*", F.lag(order).over(w).alias("previous_value")).where(
            F.col("previous_value") > F.col(order)
        )
    spanned = visits.withColumn("__span", span)
    inner = Window.partitionBy(participant, "__span").orderBy(sequence)
    within = spanned.select("*", F.lag(order).over(inner).alias("previous_value"))
    edges = spanned.groupBy(participant, "__span").agg(F.max_by(order, sequence).alias("__last"))
    across = Window.partitionBy(participant).orderBy("__span")
    edges = edges.select(participant, "__span", F.lag("__last").over(across).alias("__before"))
    first = F.row_number().over(inner) == 1
    checked = within.withColumn("__first", first).join(edges, [participant, "__span"])
    previous = F.when(F.col("__first"), F.col("__before")).otherwise(F.col("previous_value"))
    return checked.select(*visits.columns, previous.alias("previous_value")).where(F.col("previous_value") > F.col(order))


def require_monotonic_visits(
    visits: DataFrame, order: str = "visit_index", sequence: str = "sequence", participant: str = "participant_id"
) -> None:
    bad = order_violations(visits, order, sequence, participant).select(participant).limit(1).collect()
    if bad:
        raise ValueError(f"Visits are not monotonic for participant {bad[0][0]}")


def future_feature_violations(frame: DataFrame, anchor: str = "anchor_days", feature_time: str = "feature_days") -> DataFrame:
    return frame.where(F.col(feature_time) > F.col(anchor))


def without_future_features(frame: DataFrame, anchor: str = "anchor_days", feature_time: str = "feature_days") -> DataFrame:
    """The legal rows: measured at or before the anchor, or without a time."""
    return frame.where(~F.coalesce(F.col(feature_time) > F.col(anchor), F.lit(False)))


def require_no_future_features(frame: DataFrame, anchor: str = "anchor_days", feature_time: str = "feature_days") -> None:
    count = future_feature_violations(frame, anchor, feature_time).count()
    if count:
        raise ValueError(f"Found {count} feature rows after the prediction anchor")


def split_overlaps(train: DataFrame, *others: DataFrame, participant: str = "participant_id") -> DataFrame:
    """Participants of ``train`` that occur in another split, with the split's number."""
    ids = train.select(participant).distinct()
    hits = [
        ids.join(other, participant, "left_semi").select(F.lit(i).alias("split"), participant)
        for i, other in enumerate(others, start=1)
    ]
    return reduce(DataFrame.unionByName, hits)


def require_disjoint_participants(train: DataFrame, *others: DataFrame, participant: str = "participant_id") -> None:
    overlap = split_overlaps(train, *others, participant=participant)
    # Five ids of the first overlapping split are enough for the message.
    preview = overlap.orderBy("split", participant).limit(5).collect()
    if preview:
        first = preview[0]["split"]
        names = ", ".join(str(r[participant]) for r in preview if r["split"] == first)
        raise ValueError(f"Train participants overlap split {first}: {names}")


TRAIN_ROLES = ("global_train", "tlsa_adaptation")
VALIDATION_ROLES = ("public_validation", "india_validation", "external_validation")


def split_safety(roles: DataFrame, features: DataFrame, visits: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """One row per safety check with its number of violations.

    ``roles`` has participant_id, cohort, role. ``anchors`` (participant_id,
    anchor_days) dates the prediction; by default the features' own visit is
    the anchor, which only shows that every feature has a dated visit.
    """
    train = roles.where(F.col("role").isin(*TRAIN_ROLES))
    held = [roles.where(F.col("role") == role) for role in VALIDATION_ROLES]
    overlap = split_overlaps(train, *held).agg(F.count(F.lit(1)).alias("violations"))
    held_out = train.where(F.col("cohort") == contracts.HELD_OUT_COHORT).agg(F.count(F.lit(1)).alias("violations"))
    # All features of a participant at a visit have one time, so they are counted before they meet it.
    counted = features.groupBy("participant_id", "visit_id").agg(F.count(F.lit(1)).alias("__n"))
    timed = counted.join(visits.select("visit_id", F.col("baseline_days").alias("feature_days")), "visit_id", "left")
    timed = timed.join(anchors, "participant_id") if anchors is not None else timed.withColumn("anchor_days", F.col("feature_days"))
    future = future_feature_violations(timed).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("violations"))
    parts = [
        overlap.select(F.lit("participants_disjoint").alias("check"), "violations"),
        held_out.select(F.lit("held_out_cohort_not_in_train").alias("check"), "violations"),
        future.select(F.lit("no_future_features").alias("check"), "violations"),
    ]
    return reduce(DataFrame.unionByName, parts)


def require_split_safety(roles: DataFrame, features: DataFrame, visits: DataFrame, anchors: DataFrame | None = None) -> None:
    failed = [r.check for r in split_safety(roles, features, visits, anchors).collect() if r.violations]
    if failed:
        raise ValueError(f"Split safety failed: {', '.join(failed)}")


def role_filter(df: DataFrame, roles: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.join(roles.select("participant_id", "role"), "participant_id").where(F.col("role").isin(*wanted))
