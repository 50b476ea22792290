"""Longitudinal score regression, interpolation and prediction bands."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.functions.columns import clip, dot
from longspan.functions.linalg import cross_products
from longspan.operators.ordered import exact_quantiles
from longspan.operators.scaling import MedianImputer, Standardizer
from longspan.session import reused

FORECAST_YEARS = (0.0, 1.0, 2.0, 3.0, 5.0)
SCORE_LOW, SCORE_HIGH = 0.0, 30.0
TWIN_SHARE = 0.35
BASELINE_WIDTH = 0.25
MIN_BAND = 0.75


@dataclass
class RidgeTrajectory:
    """Impute, standardise, ridge with a free intercept; exact normal equations."""

    features: Sequence[str]
    alpha: float = 1.0
    imputer: MedianImputer | None = None
    scaler: Standardizer | None = None
    coefficients: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0

    def fit(self, frame: DataFrame, target: str = "future_score") -> "RidgeTrajectory":
        rows = frame.where(F.col(target).isNotNull()).select(
            *[F.col(c).cast("double").alias(c) for c in self.features], F.col(target).cast("double").alias("__target")
        )
        with reused(rows) as cached:
            return self._fit(cached)

    def _fit(self, rows: DataFrame) -> "RidgeTrajectory":
        self.imputer = MedianImputer(self.features, empty=0.0).fit(rows)
        filled = self.imputer.transform(rows)
        self.scaler = Standardizer(self.features).fit(filled)
        z = self.scaler.transform(filled)
        gram, _ = cross_products(z, [F.lit(1.0), *[F.col(c) for c in self.features], F.col("__target")])
        p = len(self.features) + 1
        penalty = np.eye(p) * self.alpha
        penalty[0, 0] = 0.0
        beta = np.linalg.solve(gram[:p, :p] + penalty, gram[:p, p])
        self.intercept = float(beta[0])
        self.coefficients = {c: float(b) for c, b in zip(self.features, beta[1:])}
        return self

    def expression(self) -> Column:
        """The prediction as one projection over the raw feature columns."""
        terms = []
        for c in self.features:
            filled = F.coalesce(F.col(c).cast("double"), F.lit(float(self.imputer.medians[c])))
            terms.append((filled - F.lit(float(self.scaler.means[c]))) / F.lit(float(self.scaler.stds[c])))
        return dot(terms, [self.coefficients[c] for c in self.features]) + F.lit(self.intercept)

    def predict(self, frame: DataFrame, out: str = "predicted_future_score") -> DataFrame:
        if not self.coefficients:
            raise RuntimeError("RidgeTrajectory must be fitted before predict")
        return frame.select("*", self.expression().alias(out))


def training_pairs(trajectories: DataFrame, people: DataFrame, features: Sequence[str], score: str = "cognitive_score") -> DataFrame:
    """Follow-up scores of the given people next to their baseline features.

    ``people`` holds participant_id and the baseline features; the baseline
    score keeps its name and the follow-up score becomes ``future_score``.
    """
    later = trajectories.where(F.col("year") > 0).select(
        "participant_id", F.col("year").alias("horizon_years"), F.col(score).alias("future_score")
    )
    return later.join(people.select("participant_id", *features), "participant_id")


def residual_band(pairs: DataFrame, model: RidgeTrajectory, probability: float = 0.8, floor: float = MIN_BAND) -> DataFrame:
    """One row: the quantile of |residual| on validation pairs, at least ``floor``."""
    residuals = model.predict(pairs).select(
        F.abs(F.col("future_score") - F.col("predicted_future_score")).alias("residual")
    )
    return exact_quantiles(residuals, "residual", [probability]).select(
        F.greatest(F.lit(floor), F.col("quantile")).alias("band")
    )


@dataclass
class ParticipantRidge:
    """Ridge per participant on one regressor, with a pooled ridge for everyone else.

    Each participant's sums are one hash aggregate; nothing is grouped into Python.
    """

    feature: str
    group: str = "participant_id"
    alpha: float = 1.0

    def fit(self, frame: DataFrame, target: str = "future_score") -> DataFrame:
        """Participant rows (group, slope, intercept)."""
        rows = frame.select(self.group, F.coalesce(F.col(self.feature).cast("double"), F.lit(0.0)).alias("x"), F.col(target).cast("double").alias("y"))
        return self._solve(rows.where(F.col("y").isNotNull()).groupBy(self.group), [self.group])

    def fit_pooled(self, frame: DataFrame, target: str = "future_score") -> DataFrame:
        """One row (slope, intercept) over all rows."""
        rows = frame.select(F.coalesce(F.col(self.feature).cast("double"), F.lit(0.0)).alias("x"), F.col(target).cast("double").alias("y"))
        return self._solve(rows.where(F.col("y").isNotNull()).groupBy(), [])

    def _solve(self, grouped, keys: Sequence[str]) -> DataFrame:
        sums = grouped.agg(
            F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.avg("x").alias("mx"), F.avg("y").alias("my")
        )
        slope = F.try_divide(F.col("sxy"), F.col("sxx") + self.alpha)
        return sums.select(*keys, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))

    def predict(self, frame: DataFrame, groups: DataFrame, pooled: DataFrame, out: str = "predicted_future_score") -> DataFrame:
        """Group model where the participant is known, else the pooled one."""
        x = F.coalesce(F.col(self.feature).cast("double"), F.lit(0.0))
        own = groups.select(self.group, F.col("slope").alias("__slope"), F.col("intercept").alias("__intercept"))
        slope = F.coalesce("__slope", pooled.select("slope").scalar())
        intercept = F.coalesce("__intercept", pooled.select("intercept").scalar())
        return frame.join(own, self.group, "left").select(*[F.col(f"`{c}`") for c in frame.columns], (intercept + slope * x).alias(out))


@dataclass
class ParticipantRidgeMany:
    """Ridge per participant on several regressors, with a pooled ridge for everyone else.

    Each participant's centred products are one hash aggregate, and its small system is solved by a
    Cholesky factor in column expressions, so nothing is grouped into Python. Missing regressors count as 0.
    """

    features: Sequence[str]
    group: str = "participant_id"
    alpha: float = 1.0

    def _rows(self, frame: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
        x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(self.features)]
        return frame.select(*keys, *x, F.col(target).cast("double").alias("y")).where(F.col("y").isNotNull())

    def fit(self, frame: DataFrame, target: str = "future_score") -> DataFrame:
        """Participant rows (group, coefficients, intercept)."""
        return self._solve(self._rows(frame, target, [self.group]).groupBy(self.group), [self.group])

    def fit_pooled(self, frame: DataFrame, target: str = "future_score") -> DataFrame:
        """One row (coefficients, intercept) over all rows."""
        return self._solve(self._rows(frame, target, []).groupBy(), [])

    def _solve(self, grouped, keys: Sequence[str]) -> DataFrame:
        p = len(self.features)
        n = F.count(F.lit(1))
        products = [(n * F.covar_pop(f"x{i}", f"x{j}")).alias(f"a{i}_{j}") for i in range(p) for j in range(i + 1)]
        targets = [(n * F.covar_pop(f"x{i}", "y")).alias(f"c{i}") for i in range(p)]
        rows = grouped.agg(*products, *targets, *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)], F.avg("y").alias("my"))
        # One projection per unknown: each is named once and used several times.
        for i in range(p):
            for j in range(i + 1):
                rest = F.col(f"a{i}_{j}") + (self.alpha if i == j else 0.0)
                for k in range(j):
                    rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
                rows = rows.withColumn(f"l{i}_{j}", F.sqrt(rest) if i == j else F.try_divide(rest, F.col(f"l{j}_{j}")))
        for i in range(p):
            rest = F.col(f"c{i}")
            for k in range(i):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"z{k}")
            rows = rows.withColumn(f"z{i}", F.try_divide(rest, F.col(f"l{i}_{i}")))
        for i in reversed(range(p)):
            rest = F.col(f"z{i}")
            for k in range(i + 1, p):
                rest = rest - F.col(f"l{k}_{i}") * F.col(f"b{k}")
            rows = rows.withColumn(f"b{i}", F.try_divide(rest, F.col(f"l{i}_{i}")))
        intercept = F.col("my")
        for i in range(p):
            intercept = intercept - F.col(f"b{i}") * F.col(f"m{i}")
        return rows.select(*keys, F.array(*[F.col(f"b{i}") for i in range(p)]).alias("coefficients"), intercept.alias("intercept"))

    def predict(self, frame: DataFrame, groups: DataFrame, pooled: DataFrame, out: str = "predicted_future_score") -> DataFrame:
        """Group model where the participant is known, else the pooled one."""
        own = groups.select(F.col(self.group).alias("__group"), F.col("coefficients").alias("__b"), F.col("intercept").alias("__a"))
        b = F.coalesce("__b", pooled.select("coefficients").scalar())
        value = F.coalesce("__a", pooled.select("intercept").scalar())
        for i, c in enumerate(self.features):
            value = value + b[i] * F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))
        joined = frame.join(own, F.col(self.group) == F.col("__group"), "left")
        return joined.select(*[joined[f"`{c}`"] for c in frame.columns], value.alias(out))


def random_effects(
    frame: DataFrame, group: str = "participant_id", time: str = "horizon_years", target: str = "future_score", min_rows: int = 3
) -> DataFrame:
    """Random intercept and slope per participant, shrunk to the pooled mean.

    Two-stage moment estimator: ordinary least squares per participant, then
    b* = mu + tau2 / (tau2 + s2) (b - mu). Participants with fewer than
    ``min_rows`` rows, or one distinct time, get mu. Only aggregates are used.
    """
    x, y = F.col(time).cast("double"), F.col(target).cast("double")
    per = (
        frame.where(x.isNotNull() & y.isNotNull())
        .select(group, x.alias("x"), y.alias("y"))
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.regr_sxx("y", "x").alias("sxx"),
            F.regr_sxy("y", "x").alias("sxy"),
            F.regr_syy("y", "x").alias("syy"),
            F.avg("x").alias("mx"),
            F.avg("y").alias("my"),
        )
    )
    fitted = (F.col("n") >= min_rows) & (F.col("sxx") > 0)
    slope = F.when(fitted, F.col("sxy") / F.col("sxx"))
    ols = per.select(
        group,
        "n",
        "sxx",
        "mx",
        slope.alias("slope"),
        F.when(fitted, F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.when(fitted, F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))).alias("rss"),
    )
    # One aggregate over the participants gives every pooled number; a fitted
    # participant's sampling variance is the pooled residual variance times a
    # known factor, so means of factors are enough.
    known = F.col("slope").isNotNull()
    ols = ols.withColumns(
        {
            "f_slope": F.when(known, 1.0 / F.col("sxx")),
            "f_intercept": F.when(known, 1.0 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx")),
        }
    )
    variance = F.sum("rss") / F.sum(F.when(known, F.col("n") - 2))
    pooled = ols.agg(
        F.struct(
            variance.alias("variance"),
            *[F.avg(b).alias(f"mu_{b}") for b in ("slope", "intercept")],
            *[
                F.greatest(F.lit(0.0), F.var_samp(b) - variance * F.avg(f"f_{b}")).alias(f"tau2_{b}")
                for b in ("slope", "intercept")
            ],
        ).alias("pooled")
    )
    rows = ols.withColumn("__p", pooled.scalar())

    def shrunk(b: str) -> Column:
        tau2, mu = F.col(f"__p.tau2_{b}"), F.col(f"__p.mu_{b}")
        share = F.try_divide(tau2, tau2 + F.col("__p.variance") * F.col(f"f_{b}"))
        return F.coalesce(mu + F.coalesce(share, F.lit(0.0)) * (F.col(b) - mu), mu)

    return rows.select(
        group,
        "n",
        shrunk("intercept").alias("intercept"),
        shrunk("slope").alias("slope"),
        (shrunk("intercept") - F.col("__p.mu_intercept")).alias("intercept_effect"),
        (shrunk("slope") - F.col("__p.mu_slope")).alias("slope_effect"),
    )


def person_effects(people: DataFrame, effects: DataFrame, group: str = "participant_id") -> DataFrame:
    """Effects of the asked participants; unknown ones get zeros."""
    known = effects.select(group, "intercept_effect", "slope_effect")
    return people.select(group).join(known, group, "left").select(
        group, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("intercept_effect", "slope_effect")]
    )


def conformal_level(n: Column, alpha: float) -> Column:
    return F.least(F.ceil((n + 1) * F.lit(1.0 - alpha)) / n, F.lit(1.0))


def conformal_width(residuals: DataFrame, residual: str = "residual", alpha: float = 0.1, kind: str = "linear", absolute: bool = True) -> DataFrame:
    """One row (width, n): the finite-sample corrected quantile of residuals."""
    values = residuals.select((F.abs(residual) if absolute else F.col(residual)).alias("__r"))
    return exact_quantiles(values, "__r", kind=kind, level=conformal_level(F.col("n"), alpha)).select(
        F.col("quantile").alias("width"), "n"
    )


def with_interval(predictions: DataFrame, width: DataFrame, prediction: str = "prediction") -> DataFrame:
    w = width.select("width").scalar()
    return predictions.select("*", (F.col(prediction) - w).alias("lower"), (F.col(prediction) + w).alias("upper"))


def interpolate(series: DataFrame, years: Sequence[float], key: str = "participant_id", time: str = "year", value: str = "cognitive_score") -> DataFrame:
    """Piecewise-linear value of every series at every year, clamped at the ends.

    For a grid year only two rows of a series matter: the last at or before it
    and the first after it. Both are argmax aggregates, so no window or sort
    over the series is needed and a very long series combines map-side. Rows
    of one series with equal times are reduced to their mean first.
    """
    points = series.where(F.col(value).isNotNull()).groupBy(key, time).agg(F.avg(value).alias("__v"))
    grid = F.explode(F.array(*[F.lit(float(y)) for y in years]))
    rows = points.select(key, F.col(time).alias("__t"), "__v", grid.alias("__year"))
    point = F.struct(F.col("__t").alias("t"), F.col("__v").alias("v"))
    near = rows.groupBy(key, "__year").agg(
        F.max(F.when(F.col("__t") <= F.col("__year"), point)).alias("a"),
        F.min(F.when(F.col("__t") > F.col("__year"), point)).alias("b"),
    )
    share = (F.col("__year") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    between = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * share
    return near.select(
        key,
        F.col("__year").alias(time),
        F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull(), F.col("a.v")).otherwise(between).alias(value),
    )


def twin_dispersion(twin_series: DataFrame, years: Sequence[float] = FORECAST_YEARS[1:], query: str = "query_id") -> DataFrame:
    """Population std of the twins' interpolated scores per query and year; one twin gives 0."""
    keyed = twin_series.withColumn("__pair", F.struct(query, "participant_id"))
    at = interpolate(keyed, years, key="__pair")
    return at.groupBy(F.col(f"__pair.{query}").alias(query), "year").agg(F.stddev_pop("cognitive_score").alias("dispersion"))


def profile_trajectory(profiles: DataFrame, model: RidgeTrajectory, dispersion: DataFrame, band: DataFrame) -> DataFrame:
    """Projected score with its band at years 0, 1, 2, 3, 5 for every profile."""
    years = F.explode(F.array(*[F.lit(y) for y in FORECAST_YEARS]))
    rows = profiles.select("*", years.alias("horizon_years"))
    center = F.when(F.col("horizon_years") == 0, F.col("cognitive_score")).otherwise(model.expression())
    scored = rows.select("participant_id", F.col("horizon_years").alias("year"), clip(center, SCORE_LOW, SCORE_HIGH).alias("predicted_score"))
    spread = dispersion.select(F.col("query_id").alias("participant_id"), "year", "dispersion")
    joined = scored.join(spread, ["participant_id", "year"], "left")
    b = band.select("band").scalar()
    share = TWIN_SHARE * F.coalesce("dispersion", F.lit(0.0))
    width = F.when(F.col("year") == 0, BASELINE_WIDTH).otherwise(F.sqrt(b * b + share * share))
    return joined.select(
        "participant_id",
        "year",
        "predicted_score",
        clip(F.col("predicted_score") - width, SCORE_LOW, SCORE_HIGH).alias("lower"),
        clip(F.col("predicted_score") + width, SCORE_LOW, SCORE_HIGH).alias("upper"),
    )
