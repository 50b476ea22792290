"""Proportional hazards by partial likelihood: linear and boosted, with the Breslow baseline.

Risk sets are running sums over descending time of per-time totals, so no pair of participants is
formed and a time that many share costs one row. Ties count the Breslow way: all events of a
time see the whole risk set.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.functions.columns import dot
from longspan.operators import boosting
from longspan.operators.ordered import range_edges, running
from longspan.operators.scaling import MedianImputer, Standardizer
from longspan.session import cut_lineage, reused
from longspan.sources import contracts

DAYS_PER_YEAR = 365.25
TOLERANCE = 1e-9
MAX_ITERATIONS = 50


def usable_rows(frame: DataFrame, features: Sequence[str], time: str, event: str) -> DataFrame:
    """(t, e, features...) of the rows with a time and an event flag."""
    rows = frame.where(F.col(time).isNotNull() & ~F.isnan(F.col(time).cast("double")) & F.col(event).isNotNull())
    return rows.select(F.col(time).cast("double").alias("__t"), (F.col(event).cast("int") == 1).cast("double").alias("__e"), *features)


def baseline_hazard(scored: DataFrame, time: str = "__t", event: str = "__e", log_risk: str = "log_risk", edges: Sequence[float] | None = None) -> DataFrame:
    """(time, events, at_risk, cumulative_hazard) per distinct time; ``at_risk`` is the sum of exp(log_risk) still under observation."""
    counts = scored.groupBy(F.col(time).alias("time")).agg(F.sum(F.col(event).cast("double")).alias("events"), F.sum(F.exp(log_risk)).alias("__r"))
    risk = running(counts, "time", {"at_risk": F.col("__r")}, descending=True, edges=edges)
    step = F.when(F.col("events") > 0, F.try_divide(F.col("events"), F.col("at_risk"))).otherwise(0.0)
    return running(risk, "time", {"cumulative_hazard": step}, edges=edges).select("time", "events", "at_risk", "cumulative_hazard")


def survival_on_grid(scored: DataFrame, baseline: DataFrame, times: Sequence[float], keys: Sequence[str], log_risk: str = "log_risk") -> DataFrame:
    """(keys, time, survival): exp(-H0(t) exp(log_risk)), H0 being a step function, 0 before the first event.

    Only H0 at the asked times reaches the driver.
    """
    steps = [F.coalesce(F.max(F.when(F.col("time") <= float(t), F.col("cumulative_hazard"))), F.lit(0.0)).alias(f"h{i}") for i, t in enumerate(times)]
    row = baseline.agg(*steps).first()
    grid = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("time"), F.lit(float(row[f"h{i}"])).alias("h")) for i, t in enumerate(times)]))
    rows = scored.select(*keys, log_risk, grid.alias("g"))
    return rows.select(*keys, F.col("g.time").alias("time"), F.exp(-F.col("g.h") * F.exp(log_risk)).alias("survival"))


class _WithBaseline:
    """Risk scores and survival curves of a model that has ``_scored`` rows and a ``baseline``."""

    baseline: DataFrame | None = None

    def risk_scores(self, frame: DataFrame, key: str = "participant_id", out: str = "risk") -> DataFrame:
        """(key, log partial hazard); higher is worse."""
        return self.predict(frame, out).select(key, out)

    def survival_function(self, frame: DataFrame, times: Sequence[float] | None = None, key: str = "participant_id") -> DataFrame:
        times = times or [DAYS_PER_YEAR * h for h in contracts.HORIZON_YEARS]
        return survival_on_grid(self.predict(frame, "log_risk"), self.baseline, times, [key])


@dataclass
class CoxRegression(_WithBaseline):
    """Linear log hazard by Newton's method on the partial likelihood.

    Missing values are filled with training medians; ``standardise`` scales the features first. ``penalty`` / 2
    times the squared coefficients is taken off the log likelihood. Each step is one job.
    """

    features: Sequence[str]
    penalty: float = 0.0
    standardise: bool = True
    imputer: MedianImputer | None = None
    scaler: Standardizer | None = None
    coefficients: dict[str, float] = field(default_factory=dict)
    log_likelihood: float = 0.0

    def fit(self, frame: DataFrame, time: str = "event_time_days", event: str = "event") -> "CoxRegression":
        columns = list(self.features)
        raw = usable_rows(frame, columns, time, event)
        with reused(raw) as raw:
            self.imputer = MedianImputer(columns, empty=0.0).fit(raw)
            filled = self.imputer.transform(raw)
            self.scaler = Standardizer(columns).fit(filled) if self.standardise else None
            ready = self.scaler.transform(filled) if self.scaler else filled
            with reused(ready.select("__t", "__e", *[F.col(c).alias(f"x{i}") for i, c in enumerate(columns)])) as rows:
                edges = range_edges(rows, "__t")
                beta = self._newton(rows, edges)
                self.coefficients = dict(zip(columns, map(float, beta), strict=True))
                log_risk = dot([F.col(f"x{i}") for i in range(len(columns))], beta)
                self.baseline = cut_lineage(baseline_hazard(rows.withColumn("log_risk", log_risk), edges=edges))
        return self

    def _newton(self, rows: DataFrame, edges: Sequence[float]) -> np.ndarray:
        p = len(self.features)
        at, step, best = np.zeros(p), np.zeros(p), -np.inf
        for _ in range(MAX_ITERATIONS):
            trial = at + step
            value, gradient, second = self._derivatives(rows, trial, edges)
            value -= self.penalty / 2.0 * float(trial @ trial)
            gradient, second = gradient - self.penalty * trial, second + self.penalty * np.eye(p)
            if value < best - 1e-12 * abs(best):
                step = step / 2.0
            else:
                at, best = trial, value
                step = np.linalg.lstsq(second, gradient, rcond=None)[0]
            if np.abs(step).max(initial=0.0) <= TOLERANCE * (1.0 + np.abs(at).max(initial=0.0)):
                break
        self.log_likelihood = best
        return at

    def _derivatives(self, rows: DataFrame, beta: np.ndarray, edges: Sequence[float]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log partial likelihood, its gradient and minus its second derivatives."""
        p = len(beta)
        pairs = [(i, j) for i in range(p) for j in range(i + 1)]
        x = [F.col(f"x{i}") for i in range(p)]
        eta = dot(x, beta)
        staged = rows.select("*", eta.alias("eta"), F.exp(eta).alias("r"))
        counts = staged.groupBy("__t").agg(
            F.sum("__e").alias("d"),
            F.sum(F.col("__e") * F.col("eta")).alias("d_eta"),
            *[F.sum(F.col("__e") * x[i]).alias(f"d{i}") for i in range(p)],
            F.sum("r").alias("r"),
            *[F.sum(F.col("r") * x[i]).alias(f"r{i}") for i in range(p)],
            *[F.sum(F.col("r") * x[i] * x[j]).alias(f"r{i}_{j}") for i, j in pairs],
        )
        names = ["r", *[f"r{i}" for i in range(p)], *[f"r{i}_{j}" for i, j in pairs]]
        upto = running(counts, "__t", {f"s{n}": F.col(n) for n in names}, descending=True, edges=edges).where("d > 0")
        d, s = F.col("d"), F.col("sr")
        mean = [F.col(f"sr{i}") / s for i in range(p)]
        row = upto.agg(
            F.coalesce(F.sum(F.col("d_eta") - d * F.log(s)), F.lit(0.0)).alias("value"),
            *[F.coalesce(F.sum(F.col(f"d{i}") - d * mean[i]), F.lit(0.0)).alias(f"g{i}") for i in range(p)],
            *[F.coalesce(F.sum(d * (F.col(f"sr{i}_{j}") / s - mean[i] * mean[j])), F.lit(0.0)).alias(f"h{i}_{j}") for i, j in pairs],
        ).first()
        second = np.zeros((p, p))
        for i, j in pairs:
            second[i, j] = second[j, i] = row[f"h{i}_{j}"]
        return float(row["value"]), np.array([row[f"g{i}"] for i in range(p)]), second

    def expression(self) -> Column:
        terms = []
        for c in self.features:
            value = F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(float(self.imputer.medians[c])))
            terms.append((value - F.lit(float(self.scaler.means[c]))) / F.lit(float(self.scaler.stds[c])) if self.scaler else value)
        return dot(terms, [self.coefficients[c] for c in self.features])

    def predict(self, frame: DataFrame, out: str = "log_risk") -> DataFrame:
        """All columns of ``frame`` and the log partial hazard; a pure projection."""
        if self.imputer is None:
            raise RuntimeError("CoxRegression must be fitted before predict")
        return frame.withColumn(out, self.expression())


def _ends(block: dict, per_time: np.ndarray) -> tuple:
    """(id, first time, last time, sum, its part at the first time, at the last time) of a block."""
    return block["id"], block["t"][0], block["t"][-1], per_time.sum(), per_time[0], per_time[-1]


def _outside(ends: Sequence[tuple]) -> dict:
    """id -> (sum of the blocks before, sum of the rows behind with the block's last time), blocks in order."""
    behind, found = (None, 0.0), {}
    for at, first, last, _, at_first, _ in reversed(ends):
        found[at] = behind[1] if behind[0] == last else 0.0
        behind = (first, at_first + (behind[1] if first == last == behind[0] else 0.0))
    before = 0.0
    for at, _, _, whole, _, _ in ends:
        found[at] = (before, found[at])
        before += whole
    return found


def _relative_risk(block: dict) -> np.ndarray:
    return np.exp(block["score"][0].astype(float))


def _risk_ends(block: dict) -> tuple:
    return _ends(block, np.add.reduceat(_relative_risk(block), block["starts"]))


def _hazard_steps(block: dict, later: dict) -> np.ndarray:
    """The block's events over the whole risk set, per distinct time."""
    at_risk = np.add.reduceat(_relative_risk(block), block["starts"])[::-1].cumsum()[::-1]
    after, same = later[block["id"]]
    at_risk = at_risk + after
    at_risk[0] += same
    return np.add.reduceat(block["y"], block["starts"]) / at_risk


def _hazard_ends(block: dict, later: dict) -> tuple:
    return _ends(block, _hazard_steps(block, later))


def _martingale_residual(block: dict, later: dict, earlier: dict) -> np.ndarray:
    hazard = _hazard_steps(block, later).cumsum()
    before, same = earlier[block["id"]]
    hazard = hazard + before
    hazard[-1] += same
    return (block["y"] - _relative_risk(block) * hazard[block["place"]])[None, :]


def _residuals(state: RDD, _: int) -> Callable[[dict], np.ndarray]:
    """Residuals at the state's scores: two passes, of which every block sends its sums only.

    Blocks hold the rows in order of time, so a risk set is a sum inside the block and the sums of the blocks behind it.
    """
    ends = sorted(state.map(_risk_ends).collect(), reverse=True)
    later = _outside([(at, last, first, whole, at_last, at_first) for at, first, last, whole, at_first, at_last in ends])
    earlier = _outside(sorted(state.map(partial(_hazard_ends, later=later)).collect()))
    return partial(_martingale_residual, later=later, earlier=earlier)


@dataclass
class CoxBoost(_WithBaseline):
    """Boosted log hazard: regression trees on martingale residuals, the negative gradient of the partial likelihood.

    Every round takes the Breslow cumulative hazard at the current scores, fits a tree to
    event - exp(score) H0(time) on a seeded share ``subsample`` of the rows, and adds ``learning_rate`` times it.
    Rows are sorted by time once and binned; a round is two passes for the residuals and one per level of the tree.
    """

    features: Sequence[str]
    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 3
    min_leaf: int = 1
    subsample: float = 1.0
    seed: int = 42
    imputer: MedianImputer | None = None
    scorer: boosting.Scorer | None = None

    def _names(self) -> list[str]:
        return [f"__b_{c}" for c in self.features]

    def _prepare(self, frame: DataFrame, *kept: str) -> DataFrame:
        named = [F.col(c).cast("double").alias(n) for c, n in zip(self.features, self._names(), strict=True)]
        return self.imputer.transform(frame.select(*[F.col(f"`{c}`") for c in kept], *named))

    def fit(self, frame: DataFrame, time: str = "event_time_days", event: str = "event") -> "CoxBoost":
        names = self._names()
        raw = usable_rows(frame, self.features, time, event)
        self.imputer = MedianImputer(names, empty=0.0).fit(raw.select(*[F.col(c).cast("double").alias(n) for c, n in zip(self.features, names, strict=True)]))
        keyed = raw.withColumn("__key", F.xxhash64("__t", "__e", *self.features))
        rows = cut_lineage(self._prepare(keyed, "__t", "__e", "__key"))
        cuts = boosting.cut_points(rows, names)

        def make(batch) -> dict:  # type: ignore[no-untyped-def]
            t, y, key = (batch[c].to_numpy(zero_copy_only=False) for c in ("__t", "__e", "__key"))
            starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            place = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(t)]))
            x = boosting.binned(boosting.matrix(batch, "__x"), cuts)
            return {"x": x, "y": y, "t": t, "key": key, "starts": starts, "place": place, "w": np.ones((1, len(t)), dtype=np.uint8)}

        spread = rows.sparkSession.sparkContext.defaultParallelism
        # The key splits a time that many rows share among partitions.
        ordered = rows.select("__t", "__e", "__key", F.array(*names).alias("__x")).repartitionByRange(spread, "__t", "__key")
        base = boosting.blocks(ordered.sortWithinPartitions("__t", "__key"), make).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            fitted = boosting.Boosting(
                [range(len(names))], cuts, [self.seed], self.n_estimators, self.learning_rate, self.max_depth, self.min_leaf, self.subsample
            ).fit(base, _residuals)
        finally:
            base.unpersist()
        self.scorer = fitted.part([0], range(len(names)))
        scored = rows.withColumn("log_risk", self._score())
        self.baseline = cut_lineage(baseline_hazard(scored, edges=range_edges(rows, "__t")))
        return self

    def _score(self) -> Column:
        return self.scorer.column([F.col(n) for n in self._names()])[0]

    def predict(self, frame: DataFrame, out: str = "log_risk") -> DataFrame:
        """All columns of ``frame`` and the boosted log hazard."""
        if self.scorer is None:
            raise RuntimeError("CoxBoost must be fitted before predict")
        return self._prepare(frame, *frame.columns).withColumn(out, self._score()).drop(*self._names())


def partial_log_likelihood(scored: DataFrame, log_risk: str = "log_risk", time: str = "event_time_days", event: str = "event") -> DataFrame:
    """One row: log partial likelihood of given scores (Breslow ties)."""
    rows = usable_rows(scored, [log_risk], time, event)
    counts = rows.groupBy("__t").agg(F.sum("__e").alias("d"), F.sum(F.col("__e") * F.col(log_risk)).alias("v"), F.sum(F.exp(log_risk)).alias("r"))
    upto = running(counts, "__t", {"s": F.col("r")}, descending=True).where("d > 0")
    return upto.agg(F.sum(F.col("v") - F.col("d") * F.log("s")).alias("log_likelihood"))
