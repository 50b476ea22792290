"""Concordance, time-dependent AUC and integrated Brier scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longspan.operators.discrimination import binary_metrics
from longspan.operators.ordered import range_edges, running
from longspan.operators.survival import kaplan_meier


def concordance_index(
    frame: DataFrame,
    time: str = "event_time_days",
    event: str = "event",
    risk: str = "risk",
    by: Sequence[str] = (),
    ties_at_event_time: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Harrell's C per group: c_index, concordant, permissible.

    A pair counts when one has the event and the other's time is later; equal
    risks count half; no pairs give 0.5. No pair is ever formed. Distinct
    times are numbered. Two numbers first differ at one bit, and at that bit
    the earlier one has 0 and the later one 1. So for every bit the rows fall
    into blocks, and inside a block one running count over risk tells how many
    later rows have a lower risk. Work is rows x log2(distinct times).

    ``ties_at_event_time=True`` also compares an event with rows censored at
    the same time.
    """
    by = list(by)
    rows = frame.where(F.col(time).isNotNull() & F.col(event).isNotNull() & F.col(risk).isNotNull())
    is_event = F.col(event).cast("int") == 1
    moment = F.col(time).cast("double")
    if ties_at_event_time:
        # Events go just before censorings of the same time.
        moment = moment * 2 + F.when(is_event, 0.0).otherwise(1.0)
    counts = rows.groupBy(*by, moment.alias("__t"), F.col(risk).cast("double").alias("__risk")).agg(
        F.count(F.lit(1)).alias("__all"), F.sum(is_event.cast("long")).alias("__events")
    )
    times = counts.select("__t").distinct().withColumn("__one", F.lit(1))
    numbered = running(times, "__t", {"__number": F.col("__one")}, exclusive=True, ranges=ranges).select("__t", "__number")
    keyed = counts.join(numbered, "__t").withColumn("__number", F.col("__number").cast("long"))
    top = numbered.agg(F.max("__number").cast("long")).scalar()
    last_bit = F.floor(F.log2(F.greatest(F.coalesce(top, F.lit(1)), F.lit(1)).cast("double"))).cast("int") + 1
    exploded = keyed.withColumn("__bit", F.explode(F.sequence(F.lit(0), last_bit)))
    half = F.expr("(__number div shiftleft(1L, __bit)) % 2")
    block = F.expr("__number div shiftleft(2L, __bit)")
    cells = (
        exploded.select(*by, "__bit", block.alias("__block"), half.alias("__half"), "__risk", "__all", "__events")
        .where((F.col("__half") == 1) | (F.col("__events") > 0))
        .groupBy(*by, "__bit", "__block", "__risk")
        .agg(
            F.sum(F.when(F.col("__half") == 0, F.col("__events")).otherwise(0)).alias("__first"),
            F.sum(F.when(F.col("__half") == 1, F.col("__all")).otherwise(0)).alias("__later"),
        )
    )
    keys = [*by, "__bit", "__block"]
    edges = range_edges(counts, "__risk", ranges)
    below = running(cells, "__risk", {"__upto": F.col("__later")}, by=keys, edges=edges)
    blocks = below.groupBy(*keys).agg(
        F.sum(F.col("__first").cast("double") * (F.col("__upto") - F.col("__later") / 2.0)).alias("c"),
        F.sum("__first").cast("double").alias("e"),
        F.sum("__later").cast("double").alias("a"),
    )
    found = blocks.groupBy(*by).agg(
        F.coalesce(F.sum("c"), F.lit(0.0)).alias("concordant"),
        F.coalesce(F.sum(F.col("e") * F.col("a")), F.lit(0.0)).alias("permissible"),
    )
    if by:
        groups = counts.select(*by).distinct()
        found = groups.join(found, by, "left").select(
            *by, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("concordant", "permissible")]
        )
    ratio = F.when(F.col("permissible") > 0, F.try_divide("concordant", "permissible")).otherwise(0.5)
    return found.select(*by, ratio.alias("c_index"), "concordant", "permissible")


def _at_times(frame: DataFrame, times: Sequence[float], time: str, event: str) -> DataFrame:
    """Rows x evaluation times with ``case``; rows censored by t are left out."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in times]))
    is_event = F.col(event).cast("int") == 1
    return (
        frame.select("*", grid.alias("eval_time"))
        .where((F.col(time) > F.col("eval_time")) | is_event)
        .withColumn("case", F.when(is_event & (F.col(time) <= F.col("eval_time")), 1).otherwise(0))
    )


def time_dependent_auc(
    frame: DataFrame, times: Sequence[float], time: str = "event_time_days", event: str = "event", risk: str = "risk"
) -> DataFrame:
    """AUC at each time without censoring weights; NULL where only one class is left."""
    rows = _at_times(frame, times, time, event)
    return binary_metrics(rows, "case", risk, ["eval_time"], min_n=2).select("eval_time", "auroc", "n")


def mean_auc(per_time: DataFrame) -> DataFrame:
    """Mean over the times that have an AUC."""
    return per_time.agg(F.avg("auroc").alias("mean_auc"))


def _survival_on(table: DataFrame, times: Sequence[float]) -> DataFrame:
    """Step look-up of a Kaplan-Meier table at a few times (1 before its first time)."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in times]))
    reached = F.when(F.col("time") <= F.col("eval_time"), F.col("survival"))
    return (
        table.select("time", "survival", grid.alias("eval_time"))
        .groupBy("eval_time")
        .agg(F.coalesce(F.min(reached), F.lit(1.0)).alias("survival"))
    )


def with_censoring_weight(frame: DataFrame, time: str = "event_time_days", event: str = "event") -> DataFrame:
    """Add ``g_time`` = P(not censored by the row's own time)."""
    g = kaplan_meier(frame, time, event, reverse=True).select(F.col("time").alias(time), F.col("survival").alias("g_time"))
    return frame.join(g, time)


def ipcw_auc(
    frame: DataFrame, times: Sequence[float], time: str = "event_time_days", event: str = "event", risk: str = "risk"
) -> DataFrame:
    """Censoring-weighted cumulative / dynamic AUC at each time.

    Cases weigh 1 / G(t_i), controls are all rows still under observation;
    the count of beaten controls is a running sum over risk.
    """
    rows = with_censoring_weight(frame.select(time, event, risk), time, event)
    grid = F.explode(F.array(*[F.lit(float(t)) for t in times]))
    rows = rows.select(F.col(time).alias("__t"), event, F.col(risk).cast("double").alias("value"), "g_time", grid.alias("eval_time"))
    case = (F.col(event).cast("int") == 1) & (F.col("__t") <= F.col("eval_time"))
    control = F.col("__t") > F.col("eval_time")
    counts = (
        rows.where(case | control)
        .groupBy("eval_time", "value")
        .agg(
            F.sum(F.when(case, F.try_divide(F.lit(1.0), F.col("g_time"))).otherwise(0.0)).alias("cases"),
            F.sum(F.when(control, 1.0).otherwise(0.0)).alias("controls"),
        )
    )
    up = running(counts, "value", {"__below": F.col("controls")}, by=["eval_time"])
    return up.groupBy("eval_time").agg(
        F.try_divide(
            F.sum(F.col("cases") * (F.col("__below") - F.col("controls") / 2.0)),
            F.sum("cases") * F.sum("controls"),
        ).alias("auc")
    )


def ipcw_mean_auc(
    frame: DataFrame, times: Sequence[float], time: str = "event_time_days", event: str = "event", risk: str = "risk"
) -> DataFrame:
    """Mean of the weighted AUCs, each weighted by the drop of event-free survival before it."""
    auc = ipcw_auc(frame, times, time, event, risk)
    survival = _survival_on(kaplan_meier(frame, time, event), times)
    w = Window.partitionBy(F.lit(0)).orderBy("eval_time")
    # One row per evaluation time.
    rows = auc.join(survival, "eval_time").withColumn(
        "drop", F.lag("survival", 1, 1.0).over(w) - F.col("survival")
    )
    return rows.agg(
        F.try_divide(F.sum(F.col("auc") * F.col("drop")), 1.0 - F.min("survival")).alias("mean_auc")
    )


def _trapezoid(scores: DataFrame, times: Sequence[float]) -> DataFrame:
    """Area under (eval_time, brier) over the whole time span; no scores give NULL."""
    w = Window.partitionBy(F.lit(0)).orderBy("eval_time")
    step = (F.col("eval_time") - F.lag("eval_time").over(w)) * (F.col("brier") + F.lag("brier").over(w)) / 2.0
    span = float(max(times) - min(times))
    return (
        scores.select(step.alias("__step"), "brier")
        .agg(F.sum("__step").alias("__area"), F.count("brier").alias("__n"))
        .select(
            F.when(F.col("__n") > 0, F.coalesce("__area", F.lit(0.0)) / span).alias("integrated_brier")
            if span > 0
            else F.lit(None).cast("double").alias("integrated_brier")
        )
    )


def brier_by_time(curve: DataFrame, times: Sequence[float], time: str = "event_time_days", event: str = "event") -> DataFrame:
    """Brier score of the event probability per time; times with one class are left out.

    ``curve`` is long: (participant, eval_time, survival, time, event).
    """
    is_event = F.col(event).cast("int") == 1
    case = F.when(is_event & (F.col(time) <= F.col("eval_time")), 1.0).otherwise(0.0)
    rows = curve.where((F.col(time) > F.col("eval_time")) | is_event).select(
        "eval_time", case.alias("case"), (1.0 - F.col("survival")).alias("p")
    )
    return (
        rows.groupBy("eval_time")
        .agg(
            F.avg(F.pow(F.col("case") - F.col("p"), F.lit(2.0))).alias("brier"),
            F.min("case").alias("__low"),
            F.max("case").alias("__high"),
        )
        .where(F.col("__low") < F.col("__high"))
        .select("eval_time", "brier")
    )


def integrated_brier(curve: DataFrame, times: Sequence[float], time: str = "event_time_days", event: str = "event") -> DataFrame:
    """Trapezoid mean of ``brier_by_time``."""
    return _trapezoid(brier_by_time(curve, times, time, event), times)


def ipcw_brier_by_time(
    curve: DataFrame, frame: DataFrame, times: Sequence[float], time: str = "event_time_days", event: str = "event"
) -> DataFrame:
    """Censoring-weighted Brier score per time; weights come from ``frame`` (one row per person)."""
    g = kaplan_meier(frame, time, event, reverse=True)
    at_row = g.select(F.col("time").alias(time), F.col("survival").alias("__g_row"))
    at_eval = _survival_on(g, times).withColumnRenamed("survival", "__g_eval")
    rows = curve.join(at_row, time).join(F.broadcast(at_eval), "eval_time")
    s = F.col("survival")
    early = (F.col(event).cast("int") == 1) & (F.col(time) <= F.col("eval_time"))
    late = F.col(time) > F.col("eval_time")
    loss = F.when(early, F.try_divide(s * s, F.col("__g_row"))).when(
        late, F.try_divide((1.0 - s) * (1.0 - s), F.col("__g_eval"))
    ).otherwise(0.0)
    return rows.groupBy("eval_time").agg(F.avg(loss).alias("brier"))


def ipcw_integrated_brier(
    curve: DataFrame, frame: DataFrame, times: Sequence[float], time: str = "event_time_days", event: str = "event"
) -> DataFrame:
    return _trapezoid(ipcw_brier_by_time(curve, frame, times, time, event), times)
