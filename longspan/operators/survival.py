"""Time-to-event tables, person-period rows, hazard models and survival curves."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.functions.columns import POISSON_ONE_CDF, any_present, clip, poisson_one, seeded_draw, seeded_draws
from longspan.operators import boosting
from longspan.operators.newton import fit_logistic
from longspan.operators.ordered import exact_quantiles, position_within, running
from longspan.operators.risk import VECTOR, LogisticRisk, assemble, positive_probability
from longspan.operators.scaling import MedianImputer, Standardizer
from longspan.session import cut_lineage, reused
from longspan.sources import contracts

DAYS_PER_YEAR = 365.25
HAZARD_FLOOR, HAZARD_CEILING = 0.001, 0.95


def kaplan_meier(
    frame: DataFrame,
    time: str = "event_time_days",
    event: str = "event",
    by: Sequence[str] = (),
    reverse: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """time, at_risk, events, censored, survival per distinct time (and group).

    Rows with a NULL time or event are dropped. ``reverse=True`` estimates the
    censoring distribution; events at the same time leave the risk set first.
    """
    by = list(by)
    counts = (
        frame.where(F.col(time).isNotNull() & F.col(event).isNotNull())
        .groupBy(*by, F.col(time).alias("time"))
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.sum((F.col(event).cast("int") == 1).cast("long")).alias("events"),
        )
        .withColumn("censored", F.col("__n") - F.col("events"))
    )
    risk = running(counts, "time", {"at_risk": F.col("__n")}, by=by, descending=True, ranges=ranges)
    if reverse:
        left = F.col("at_risk") - F.col("events")
        factor = F.when(left > 0, 1.0 - F.try_divide(F.col("censored"), left)).otherwise(1.0)
    else:
        factor = 1.0 - F.col("events") / F.col("at_risk")
    done = running(risk, "time", products={"survival": factor}, by=by, ranges=ranges)
    return done.select(*by, "time", "at_risk", "events", "censored", "survival")


def event_times(frame: DataFrame, time: str = "event_time_days", event: str = "event") -> DataFrame:
    """Distinct times at which an event happened (order them at the sink)."""
    return frame.where(F.col(event) == 1).select(F.col(time).alias("time")).distinct()


def person_period(
    frame: DataFrame, years: int = 5, time: str = "event_time_days", event: str = "event"
) -> DataFrame:
    """One row per participant and year at risk; no shuffle.

    A person censored within a year keeps that year as a non-event.
    """
    year = F.explode(F.sequence(F.lit(1), F.lit(years)))
    return (
        frame.select("*", year.alias("__year"))
        .where(F.col(time) > (F.col("__year") - 1) * DAYS_PER_YEAR)
        .select(
            *[F.col(f"`{c}`") for c in frame.columns],
            F.col("__year").cast("double").alias("interval_year"),
            F.when((F.col(event) == 1) & (F.col(time) <= F.col("__year") * DAYS_PER_YEAR), 1)
            .otherwise(0)
            .alias("interval_event"),
        )
    )


def cumulative_risk(
    hazards: DataFrame,
    by: Sequence[str] = ("participant_id", "replicate"),
    horizons: Sequence[int] = contracts.HORIZON_YEARS,
    hazard: str = "hazard",
    keep_survival: bool = False,
) -> DataFrame:
    """Risk at the horizons from yearly hazards, one row per (``by``, horizon).

    Hazards are clamped to [0.001, 0.95]. A group holds one row per year, so
    the window partition is at most a handful of rows.
    """
    w = Window.partitionBy(*by).orderBy("interval_year").rowsBetween(Window.unboundedPreceding, 0)
    survival = F.product(1.0 - clip(F.col(hazard), HAZARD_FLOOR, HAZARD_CEILING)).over(w)
    rows = hazards.select(*by, "interval_year", survival.alias("survival"))
    if keep_survival:
        return rows
    return rows.where(F.col("interval_year").isin(*[float(h) for h in horizons])).select(
        *by, F.col("interval_year").cast("int").alias("horizon"), clip(1.0 - F.col("survival"), 0.0, 1.0).alias("risk")
    )


def survival_at(yearly: DataFrame, times: Sequence[float], by: Sequence[str] = ("participant_id",)) -> DataFrame:
    """Step look-up of yearly survival on a day grid: the last interval ended by t, 1 before the first.

    ``yearly`` comes from ``cumulative_risk(..., keep_survival=True)``. Times
    beyond the last interval keep its value.
    """
    grid = F.explode(F.array(*[F.lit(float(t)) for t in times]))
    reached = F.when(F.col("interval_year") * DAYS_PER_YEAR <= F.col("time"), F.col("survival"))
    return (
        yearly.select(*by, "interval_year", "survival", grid.alias("time"))
        .groupBy(*by, "time")
        .agg(F.coalesce(F.min(reached), F.lit(1.0)).alias("survival"))
    )


def power_survival(scored: DataFrame, times: Sequence[float], risk: str = "risk", keys: Sequence[str] = ("participant_id",)) -> DataFrame:
    """S(t) = (1 - p)^(t / 365.25) for a one-year event probability p."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in times]))
    return scored.select(*keys, risk, grid.alias("time")).select(
        *keys, "time", clip(F.pow(1.0 - F.col(risk), F.col("time") / DAYS_PER_YEAR), 0.0, 1.0).alias("survival")
    )


def early_event_label(frame: DataFrame, time: str = "event_time_days", event: str = "event", out: str = "early_event") -> DataFrame:
    """1 when the event happened within the median follow-up time."""
    median = exact_quantiles(frame, time, [0.5]).select("quantile").scalar()
    return frame.withColumn(
        out, F.when((F.col(event) == 1) & (F.col(time) <= median), 1).otherwise(0)
    )


def bootstrap_weights(
    frame: DataFrame, n_bootstrap: int, seed: int = 42, key: Column | None = None, out: str = "weight"
) -> DataFrame:
    """Rows x replicates with a Poisson(1) weight per (key, replicate); zero weights are left out.

    The weight depends only on the key, the seed and the replicate, so a lost
    executor recomputes the same sample, and no shuffle is needed.
    """
    key = F.xxhash64("participant_id") if key is None else key
    replicate = F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1)))
    staged = frame.select("*", key.alias("__key"), replicate.alias("replicate"))
    drawn = staged.withColumn("__draw", seeded_draw("__key", F.lit(seed) + F.col("replicate")))
    # Zero weights are dropped by the draw itself, before the count is worked out.
    kept = drawn.where(F.col("__draw") >= POISSON_ONE_CDF[0])
    return kept.withColumn(out, poisson_one(F.col("__draw"))).drop("__key", "__draw")


@dataclass
class HazardEnsemble:
    """Discrete-time hazard models on person-period rows with participant bootstrap.

    ``kind`` is ``logistic``, ``boosted`` or ``forest``. The assembled rows are
    kept once; only the weight column changes between replicates. Logistic
    replicates are fitted together, one job per Newton step for all of them; with ``together``
    boosted replicates are as well, one job per level of a round (``fit_together``).
    ``draw_key`` may give the integer column that draws a participant's weights;
    without it the hash of the participant's id does.
    """

    features: Sequence[str]
    kind: str = "logistic"
    n_bootstrap: int = 12
    seed: int = 42
    n_estimators: int = 150
    learning_rate: float = 0.08
    max_depth: int = 4
    min_leaf: int = 1
    subsample: float = 1.0
    years: int = 5
    key: str = "participant_id"
    complete_cases: bool = False
    resample: bool = True
    draw_key: str | None = None
    together: bool = False
    imputer: MedianImputer | None = None
    scaler: Standardizer | None = None
    models: list = field(default_factory=list)
    scorer: boosting.Scorer | None = None

    def inputs(self) -> list[str]:
        return [f"__h_{c}" for c in self.features] + ["__h_year"]

    def _raw(self) -> list[Column]:
        return [F.col(c).cast("double").alias(f"__h_{c}") for c in self.features] + [
            F.col("interval_year").alias("__h_year")
        ]

    @property
    def joint(self) -> bool:
        return self.together and self.kind == "boosted"

    def _prepare(self, rows: DataFrame) -> DataFrame:
        ready = self.imputer.transform(rows)
        if self.kind == "logistic":
            return self.scaler.transform(ready)
        if self.joint:
            return ready
        return assemble(ready, self.inputs()).drop(*self.inputs())

    def _learner(self, index: int):
        seed = self.seed + 37 * index
        if self.kind == "boosted":
            return GBTClassifier(
                featuresCol=VECTOR, labelCol="__y", weightCol="__w", maxIter=self.n_estimators,
                stepSize=self.learning_rate, maxDepth=self.max_depth, minInstancesPerNode=self.min_leaf,
                subsamplingRate=self.subsample, seed=seed,
            )
        if self.kind == "forest":
            return RandomForestClassifier(
                featuresCol=VECTOR, labelCol="__y", weightCol="__w", numTrees=self.n_estimators,
                maxDepth=self.max_depth, minInstancesPerNode=self.min_leaf, seed=seed,
            )
        raise ValueError(f"Unknown hazard model: {self.kind}")

    def _replicate_weight(self, replicate: int) -> Column:
        return poisson_one(seeded_draw("__key", self.seed + replicate)).cast("double")

    def fit(self, frame: DataFrame) -> "HazardEnsemble":
        if self.joint:
            return fit_together([self], frame)[0]
        if self.complete_cases:
            usable = frame.dropna(subset=list(self.features))
        else:
            usable = frame.where(any_present(self.features))
        drawn = F.col(self.draw_key) if self.draw_key else F.xxhash64(F.col(self.key))
        rows = person_period(usable, self.years).select(
            drawn.cast("long").alias("__key"), F.col("interval_event").cast("double").alias("__y"), *self._raw()
        )
        with reused(rows) as rows:
            self.imputer = MedianImputer(self.inputs(), empty=0.0).fit(rows)
            self.scaler = Standardizer(self.inputs()).fit(self.imputer.transform(rows)) if self.kind == "logistic" else None
            return self._fit(rows)

    def _fit(self, rows: DataFrame) -> "HazardEnsemble":
        inputs = self.inputs() if self.kind == "logistic" else [VECTOR]
        with reused(self._prepare(rows).select("__key", "__y", *inputs)) as ready:
            return self._fit_replicates(ready)

    def _fit_replicates(self, ready: DataFrame) -> "HazardEnsemble":
        replicates = range(self.n_bootstrap if self.resample else 1)
        weights = {b: self._replicate_weight(b) if self.resample else F.lit(1.0) for b in replicates}
        # Class totals of every replicate, and of the full data, in one aggregate.
        totals = ready.agg(
            F.sum("__y").alias("full_pos"),
            F.count(F.lit(1)).alias("full_n"),
            *[F.sum(w * F.col("__y")).alias(f"pos{b}") for b, w in weights.items()],
            *[F.sum(w).alias(f"n{b}") for b, w in weights.items()],
        ).first()
        if not totals.full_n:
            raise ValueError("No participants have features for this modality")
        self.models, together = [], []
        for b, weight in weights.items():
            pos, n = totals[f"pos{b}"], totals[f"n{b}"]
            if not pos or pos == n:
                weight, pos, n = F.lit(1.0), totals.full_pos, float(totals.full_n)
            if self.kind == "logistic" and 0 < pos < n:
                weight = weight * F.when(F.col("__y") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
            if self.kind == "logistic":
                together.append(weight.cast("double"))
                continue
            weighted = ready.withColumn("__w", weight.cast("double")).where(F.col("__w") > 0)
            self.models.append(self._learner(b).fit(weighted))
        if together:
            points = ready.select(F.array(*self.inputs()).alias("x"), F.col("__y").alias("y"), F.array(*together).alias("w"))
            with reused(points) as points:
                self.models = fit_logistic(points, len(self.inputs()), len(together), penalty=1.0)
        return self

    def hazards(self, frame: DataFrame) -> DataFrame:
        """participant_id, replicate, interval_year, hazard for every person and year.

        All models score one exploded pass; their outputs are then unpivoted.
        """
        if not self.models and self.scorer is None:
            raise RuntimeError("HazardEnsemble must be fitted before prediction")
        people = frame.select(self.key, *self.features)
        rows = people.withColumn("interval_year", F.explode(F.array(*[F.lit(float(y)) for y in range(1, self.years + 1)])))
        scored = self._prepare(rows.select(self.key, "interval_year", *self._raw()))
        if self.kind == "logistic":
            inputs = [F.col(c) for c in self.inputs()]
            hazards = F.array(*[model.probability(inputs) for model in self.models])
            return scored.select(self.key, "interval_year", F.posexplode(hazards).alias("replicate", "hazard"))
        if self.joint:
            hazards = self.scorer.column([F.col(c) for c in self.inputs()], boosting.logistic_probability)
            return scored.select(self.key, "interval_year", F.posexplode(hazards).alias("replicate", "hazard"))
        names = []
        for b, model in enumerate(self.models):
            raw, prob, label = f"__raw{b}", f"__prob{b}", f"__label{b}"
            model = model.copy({model.rawPredictionCol: raw, model.probabilityCol: prob, model.predictionCol: label})
            scored = model.transform(scored).withColumn(f"__s{b}", positive_probability(prob)).drop(raw, prob, label)
            names.append(f"__s{b}")
        return scored.select(
            self.key, "interval_year", F.posexplode(F.array(*names)).alias("replicate", "hazard")
        )

    def predict_distribution(self, frame: DataFrame) -> DataFrame:
        """participant_id, replicate, horizon, risk."""
        return cumulative_risk(self.hazards(frame), (self.key, "replicate"))

    def survival_function(self, frame: DataFrame, times: Sequence[float] | None = None) -> DataFrame:
        """Mean survival over replicates on a day grid (default 1, 3, 5 years)."""
        times = times or [DAYS_PER_YEAR * h for h in contracts.HORIZON_YEARS]
        yearly = cumulative_risk(self.hazards(frame), (self.key, "replicate"), keep_survival=True)
        curve = survival_at(yearly, times, (self.key, "replicate"))
        return curve.groupBy(self.key, "time").agg(F.avg("survival").alias("survival"))

    def risk_scores(self, frame: DataFrame, out: str = "risk") -> DataFrame:
        """participant_id and the mean risk at the last year; higher is worse."""
        dist = cumulative_risk(self.hazards(frame), (self.key, "replicate"), horizons=[self.years])
        return dist.groupBy(self.key).agg(F.avg("risk").alias(out))


def _poisson_weights(key: np.ndarray, there: np.ndarray, seeds: Sequence[int | None]) -> np.ndarray:
    """(models x rows) Poisson(1) counts of the keys, 1 for a model without a seed, 0 where its group is not there."""
    drawn = [
        np.ones(len(key)) if seed is None else np.searchsorted(POISSON_ONE_CDF, seeded_draws(key, np.int64(seed)), side="right")
        for seed in seeds
    ]
    return (np.stack(drawn) * there).astype(np.uint8)


def _class_totals(block: dict) -> np.ndarray:
    """Per model: rows and events of its group, and those drawn."""
    y, w, there = block["y"], block["w"], block["there"]
    return np.stack([there.sum(axis=1), there @ y, w.sum(axis=1), w @ y])


def _undrawn(block: dict, models: Sequence[int]) -> dict:
    w = block["w"].copy()
    w[models] = block["there"][models]
    return block | {"w": w}


def fit_together(ensembles: Sequence[HazardEnsemble], frame: DataFrame) -> list[HazardEnsemble]:
    """Fit boosted ensembles with the same settings on the same rows; all trees of a round grow in the same passes.

    A replicate whose draw has one class only is fitted on all rows of its group.
    """
    one = ensembles[0]
    features = list(dict.fromkeys(f for e in ensembles for f in e.features))
    known = lambda v: v.isNotNull() & ~F.isnan(v)
    whole = [
        F.forall(F.array(*[F.col(c).cast("double") for c in e.features]), known) if e.complete_cases else any_present(e.features)
        for e in ensembles
    ]
    drawn = F.col(one.draw_key) if one.draw_key else F.xxhash64(F.col(one.key))
    usable = frame.select("*", F.array(*whole).alias("__there")).where(F.array_contains("__there", True))
    inputs = HazardEnsemble(features).inputs()
    raw = HazardEnsemble(features)._raw()
    rows = cut_lineage(
        person_period(usable, one.years).select(
            drawn.cast("long").alias("__key"), F.col("interval_event").cast("double").alias("__y"), "__there", *raw
        )
    )
    # A feature that is there makes its group there, so medians and cuts do not depend on the group.
    imputer = MedianImputer(inputs, empty=0.0).fit(rows)
    cuts = boosting.cut_points(rows, inputs)
    models = [(i, e, b) for i, e in enumerate(ensembles) for b in range(e.n_bootstrap if e.resample else 1)]
    group = [i for i, _, _ in models]
    seeds = [e.seed + b if e.resample else None for _, e, b in models]

    def make(batch) -> dict:  # type: ignore[no-untyped-def]
        key, y = (batch[c].to_numpy(zero_copy_only=False) for c in ("__key", "__y"))
        there = boosting.matrix(batch, "__there").astype(np.uint8).T[group]
        x = boosting.binned(boosting.matrix(batch, "__x"), cuts)
        return {"x": x, "y": y, "key": key, "there": there, "w": _poisson_weights(key, there, seeds)}

    spread = rows.sparkSession.sparkContext.defaultParallelism
    filled = imputer.transform(rows).select("__key", "__y", "__there", F.array(*inputs).alias("__x")).repartition(spread)
    base = boosting.blocks(filled, make).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        full_n, full_pos, n, pos = boosting.total(base, _class_totals, (4, len(models)))
        if not full_n.all():
            raise ValueError("No participants have features for this modality")
        single = [m for m in range(len(models)) if pos[m] == 0 or pos[m] == n[m]]
        kept = base.map(partial(_undrawn, models=single)).persist(StorageLevel.MEMORY_AND_DISK) if single else base
        place = {f: i for i, f in enumerate(features)}
        fitted = boosting.Boosting(
            [[*(place[f] for f in e.features), len(features)] for _, e, _ in models], cuts,
            [e.seed + 37 * b for _, e, b in models], one.n_estimators, one.learning_rate, one.max_depth,
            one.min_leaf, one.subsample, first_rate=1.0,
        ).fit(kept, lambda _, m: partial(boosting.logistic_residual, first=m == 0))
        if single:
            kept.unpersist()
    finally:
        base.unpersist()
    for i, e in enumerate(ensembles):
        own = [place[f] for f in e.features] + [len(features)]
        e.imputer = MedianImputer(e.inputs(), empty=0.0, medians={c: imputer.medians[c] for c in e.inputs()})
        e.scorer = fitted.part([m for m, g in enumerate(group) if g == i], own)
    return list(ensembles)


def survival_forest(features: Sequence[str], n_estimators: int = 200, seed: int = 42) -> HazardEnsemble:
    """Hazard forest fitted once on complete cases."""
    return HazardEnsemble(
        features, kind="forest", n_bootstrap=1, resample=False, seed=seed, n_estimators=n_estimators,
        max_depth=8, min_leaf=10, complete_cases=True,
    )


def boosted_survival(
    features: Sequence[str],
    n_estimators: int = 100,
    learning_rate: float = 0.1,
    max_depth: int = 3,
    subsample: float = 1.0,
    seed: int = 42,
) -> HazardEnsemble:
    """Boosted hazard model fitted once, medians for missing values."""
    return HazardEnsemble(
        features, kind="boosted", n_bootstrap=1, resample=False, seed=seed, n_estimators=n_estimators,
        learning_rate=learning_rate, max_depth=max_depth, subsample=subsample, together=True,
    )


def check_survival_input(frame: DataFrame, features: Sequence[str], time: str = "event_time_days", event: str = "event") -> None:
    """Raise on absent columns, or NULL / non-finite / negative times and NULL events."""
    missing = [c for c in [*features, time, event] if c not in frame.columns]
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}")
    t = F.col(time).cast("double")
    bad = t.isNull() | F.isnan(t) | (t == float("inf")) | (t < 0) | F.col(event).isNull()
    count = frame.where(bad).count()
    if count:
        raise ValueError(f"{count} rows have an unusable survival target")


@dataclass
class ParametricSurvival:
    """Accelerated failure time (Weibull) alternative from the ML library."""

    features: Sequence[str]
    imputer: MedianImputer | None = None
    scaler: Standardizer | None = None
    model: object = None

    def _prepare(self, frame: DataFrame) -> DataFrame:
        return assemble(self.scaler.transform(self.imputer.transform(frame)), self.features)

    def fit(self, frame: DataFrame, time: str = "event_time_days", event: str = "event") -> "ParametricSurvival":
        rows = frame.where((F.col(time) > 0) & F.col(event).isNotNull()).select(
            *self.features, F.col(time).cast("double").alias("__t"), F.col(event).cast("double").alias("__c")
        )
        self.imputer = MedianImputer(self.features, empty=0.0).fit(rows)
        self.scaler = Standardizer(self.features).fit(self.imputer.transform(rows))
        self.model = AFTSurvivalRegression(featuresCol=VECTOR, labelCol="__t", censorCol="__c").fit(self._prepare(rows))
        return self

    def risk_scores(self, frame: DataFrame, key: str = "participant_id", out: str = "risk") -> DataFrame:
        """Negative log of the predicted time: higher is worse."""
        scored = self.model.transform(self._prepare(frame.select(key, *self.features)))
        return scored.select(key, (-F.log("prediction")).alias(out))


@dataclass
class EarlyEventHazard:
    """Balanced logistic on 'event within median follow-up', turned into a survival curve."""

    features: Sequence[str]
    classifier: LogisticRisk | None = None

    def fit(self, frame: DataFrame) -> "EarlyEventHazard":
        self.classifier = LogisticRisk(self.features, max_iter=1200).fit(early_event_label(frame), "early_event")
        return self

    def risk_scores(self, frame: DataFrame, out: str = "risk") -> DataFrame:
        return self.classifier.predict_risk(frame, out)

    def survival_function(self, frame: DataFrame, times: Sequence[float] | None = None) -> DataFrame:
        times = times or [DAYS_PER_YEAR * h for h in contracts.HORIZON_YEARS]
        return power_survival(self.risk_scores(frame), times)


def permuted_copies(
    frame: DataFrame, features: Sequence[str], n_repeats: int = 5, seed: int = 42, key: str = "participant_id"
) -> DataFrame:
    """The frame once per (feature, repeat) with that feature shuffled among participants.

    The shuffle joins two orderings of the rows by position: the value at
    place i of a seeded order goes to the row at place i of the base order.
    """
    base = position_within(
        frame.withColumn("__d", F.xxhash64(F.col(key), F.lit(seed))), [], "__d", key, "__position"
    ).drop("__d")
    replicate = F.explode(F.sequence(F.lit(1), F.lit(n_repeats)))
    source = frame.select(key, *features).withColumn("repeat", replicate)
    source = source.withColumn("__d", F.xxhash64(F.col(key), F.lit(seed), F.col("repeat")))
    placed = position_within(source, ["repeat"], "__d", key, "__position").select(
        "repeat", "__position", *[F.col(f).alias(f"__p_{f}") for f in features]
    )
    joined = base.join(placed, "__position")
    copies = joined.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    swapped = [
        F.when(F.col("feature") == c, F.col(f"__p_{c}")).otherwise(F.col(c)).alias(c) if c in features else F.col(f"`{c}`")
        for c in frame.columns
    ]
    return copies.select("feature", "repeat", *swapped)


def permutation_importance(
    frame: DataFrame,
    features: Sequence[str],
    score,
    n_repeats: int = 5,
    seed: int = 42,
    key: str = "participant_id",
    time: str = "event_time_days",
    event: str = "event",
) -> DataFrame:
    """Mean and std of the C-index drop when a feature is shuffled.

    ``score(frame)`` adds a ``risk`` column and keeps the others. Rows with
    NULLs in features or targets are dropped.
    """
    from longspan.operators.survival_metrics import concordance_index

    clean = frame.dropna(subset=[*features, time, event])
    base = concordance_index(score(clean), time, event, "risk").select("c_index").scalar()
    shuffled = concordance_index(
        score(permuted_copies(clean, features, n_repeats, seed, key)), time, event, "risk", by=["feature", "repeat"]
    )
    return (
        shuffled.withColumn("__drop", base - F.col("c_index"))
        .groupBy("feature")
        .agg(F.avg("__drop").alias("importance_mean"), F.stddev_pop("__drop").alias("importance_std"))
    )
