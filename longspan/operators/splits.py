"""Participant-level splits by a seeded rank, with exact group sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.operators.ordered import position_within
from longspan.sources import contracts


def _draw(participant: str, seed: int, draw: Column | None) -> Column:
    return F.xxhash64(F.col(participant), F.lit(seed)) if draw is None else draw


def held_out_count(n: Column, fraction: Column | float) -> Column:
    """``max(1, round(n * fraction))`` with halves rounded to even."""
    fraction = F.lit(fraction) if isinstance(fraction, float) else fraction
    return F.greatest(F.lit(1), F.bround(n * fraction).cast("long"))


def subject_split(
    frame: DataFrame,
    participant: str = "participant_id",
    test_size: float = 0.2,
    seed: int = 42,
    draw: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with whole participants on one side.

    Participants are ranked by a seeded hash (or by ``draw``, an expression
    over the participant column) and the first ``max(1, round(n * test_size))``
    form the test side.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    ids = frame.select(participant).where(F.col(participant).isNotNull()).distinct()
    ids = ids.withColumn("__draw", _draw(participant, seed, draw))
    ranked = position_within(ids, [], "__draw", participant, "__position")
    total = ids.agg(F.count(F.lit(1)).alias("n"))
    test_ids = ranked.where(F.col("__position") < held_out_count(total.scalar(), test_size)).select(participant)
    return frame.join(test_ids, participant, "left_anti"), frame.join(test_ids, participant, "left_semi")


def assign_roles(
    baseline: DataFrame,
    seed: int = 42,
    draw: Column | None = None,
    public_fraction: float = 0.2,
    adaptation_fraction: float = 0.3,
) -> DataFrame:
    """participant_id, cohort, role: development cohorts, one adaptation cohort, the rest held out."""
    public = F.col("cohort").isin(*contracts.PUBLIC_COHORTS)
    adaptation = F.col("cohort") == contracts.ADAPTATION_COHORT
    ids = baseline.withColumn("__draw", _draw("participant_id", seed, draw)).select("participant_id", "cohort", "__draw")
    ranked = position_within(ids, ["cohort"], "__draw", "participant_id", "__position")
    sizes = ids.groupBy("cohort").agg(F.count(F.lit(1)).alias("__n"))
    fraction = F.when(public, public_fraction).otherwise(adaptation_fraction)
    held = F.col("__position") < held_out_count(F.col("__n"), fraction)
    role = (
        F.when(public & held, "public_validation")
        .when(public, "global_train")
        .when(adaptation & held, "india_validation")
        .when(adaptation, "tlsa_adaptation")
        .otherwise("external_validation")
    )
    return ranked.join(sizes, "cohort").select("participant_id", "cohort", role.alias("role"))
