"""Progression outcomes from visits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.functions.columns import map_codes
from longspan.sources import contracts


STATES = ("cognitively_unimpaired", "mci", "dementia")


def place_of(major: Column, minor: Column) -> Column:
    """Two longs as one sortable decimal, a buffer that hash aggregates can hold; neither wraps.

    ``major`` may have 18 digits; days and microseconds have fewer. ``minor`` is any non-negative long.
    """
    return major.cast("decimal(18,0)") * F.expr("10000000000000000000BD") + minor.cast("decimal(19,0)")


def visit_place() -> Column:
    """(baseline_days, visit_index) as one sortable value."""
    return place_of(F.col("baseline_days"), F.col("visit_index"))


def conversion_summary(visits: DataFrame, absolute: bool = False) -> DataFrame:
    """Per participant: first state, follow-up, conversion day, event, event time.

    ``absolute=True`` says that ``baseline_days`` counts from a common origin
    (such as ``unix_date``); the participant's first day is then subtracted
    here, which saves the join that would put baseline days on every visit.

    One hash aggregate with map-side combine does it all. The day of the first
    conversion depends on the first state, so both candidate days are kept and
    the right one is chosen afterwards; no window and no self-join.
    """
    days = F.col("baseline_days")
    place = visit_place()
    # Rows without a state do not supply the first state.
    known = F.when(F.col("diagnosis").isNotNull(), place)
    state = map_codes("diagnosis", {s: i for i, s in enumerate(STATES)}, len(STATES))
    base = visits.groupBy("participant_id").agg(
        F.min_by(state, known).alias("__state"),
        F.min_by("visit_id", place).alias("first_visit_id"),
        F.max("baseline_days").alias("__last"),
        F.min("baseline_days").alias("__first"),
        F.min(F.when(F.col("diagnosis").isin("mci", "dementia"), days)).alias("__impaired"),
        F.min(F.when(F.col("diagnosis") == "dementia", days)).alias("__dementia"),
    )
    names = F.array(*[F.lit(s) for s in (*STATES, "unknown")])
    base = base.withColumn("base_diagnosis", F.get(names, F.col("__state")))
    conversion = F.when(F.col("base_diagnosis") == "cognitively_unimpaired", F.col("__impaired")).when(
        F.col("base_diagnosis") == "mci", F.col("__dementia")
    )
    origin = F.col("__first") if absolute else F.lit(0)
    return base.select(
        "participant_id",
        "first_visit_id",
        "base_diagnosis",
        (F.col("__last") - origin).alias("follow_up_days"),
        (conversion - origin).alias("conversion_days"),
    ).select(
        "*",
        F.col("conversion_days").isNotNull().cast("int").alias("event"),
        F.coalesce("conversion_days", F.greatest("follow_up_days", F.lit(1))).alias("event_time_days"),
    )


def progression_outcomes(
    visits: DataFrame,
    horizons: Sequence[tuple[int, int]] = contracts.OUTCOME_HORIZONS,
    anchor: str = "index_zero",
    absolute: bool = False,
) -> DataFrame:
    """One outcome row per participant and horizon.

    ``anchor='index_zero'`` names the anchor ``<participant>-V0``;
    ``'first_visit'`` uses the id of the earliest visit.
    """
    summary = conversion_summary(visits, absolute)
    grid = F.explode(
        F.array(
            *[F.struct(F.lit(y).alias("years"), F.lit(d).alias("horizon_days")) for y, d in horizons]
        )
    )
    rows = summary.select("*", grid.alias("h"))
    event = F.when(
        F.col("conversion_days").isNotNull() & (F.col("event_time_days") <= F.col("h.horizon_days")), 1
    ).otherwise(0)
    years = F.col("h.years").cast("string")
    anchor_id = F.concat("participant_id", F.lit("-V0")) if anchor == "index_zero" else F.col("first_visit_id")
    return rows.select(
        F.concat("participant_id", F.lit("-risk-"), years, F.lit("y")).alias("outcome_id"),
        "participant_id",
        anchor_id.alias("anchor_visit_id"),
        F.concat(F.lit("incident_progression_"), years, F.lit("y")).alias("endpoint"),
        F.col("h.horizon_days").alias("horizon_days"),
        event.alias("event"),
        "event_time_days",
        F.lit(None).cast("double").alias("future_score"),
        F.when(event == 0, "study_end").otherwise("").alias("censoring_reason"),
    )


# Which first states each configured anchor admits, and which states count as its event.
ANCHOR_STATES = {
    "cognitively_unimpaired_or_mci": ("cognitively_unimpaired", "mci"),
    "cognitively_unimpaired": ("cognitively_unimpaired",),
    "mci_or_high_risk": ("mci",),
}
EVENT_STATES = {"mci_or_dementia": ("mci", "dementia"), "mci": ("mci",), "dementia": ("dementia",)}


def configured_endpoint_labels(visits: DataFrame, absolute: bool = False) -> DataFrame:
    """Eligible participants and event labels for every configured incident endpoint.

    A participant is eligible when the first state is an anchor state; the
    event is the first later day in an event state other than the first state.
    """
    state = map_codes("diagnosis", {s: i for i, s in enumerate(STATES)}, len(STATES))
    base = visits.groupBy("participant_id").agg(
        F.min_by(state, F.when(F.col("diagnosis").isNotNull(), visit_place())).alias("__state"),
        F.min("baseline_days").alias("__first"),
        F.min(F.when(F.col("diagnosis") == "mci", F.col("baseline_days"))).alias("mci_day"),
        F.min(F.when(F.col("diagnosis") == "dementia", F.col("baseline_days"))).alias("dementia_day"),
    )
    names = F.array(*[F.lit(s) for s in (*STATES, "unknown")])
    base = base.withColumn("base_diagnosis", F.get(names, F.col("__state")))
    origin = F.col("__first") if absolute else F.lit(0)
    specs = []
    for name, anchor, event, _, horizon, _ in contracts.ENDPOINTS:
        if anchor is None:
            continue
        days = [
            F.when(F.col("base_diagnosis") != state, F.col(f"{state}_day")) for state in EVENT_STATES[event]
        ]
        first_day = (days[0] if len(days) == 1 else F.least(*days)) - origin
        specs.append(
            F.struct(
                F.lit(name).alias("endpoint"),
                F.lit(horizon).alias("horizon_days"),
                F.col("base_diagnosis").isin(*ANCHOR_STATES[anchor]).alias("eligible"),
                first_day.alias("event_day"),
            )
        )
    return (
        base.select("participant_id", F.explode(F.array(*specs)).alias("e"))
        .where("e.eligible")
        .select(
            "participant_id",
            "e.endpoint",
            "e.horizon_days",
            F.when(F.col("e.event_day") <= F.col("e.horizon_days"), 1).otherwise(0).alias("event"),
        )
    )
