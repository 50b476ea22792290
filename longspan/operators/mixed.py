"""Linear mixed model with a random intercept and slope per participant, by expectation maximisation.

A participant enters by its sums only (5 + 2 per further regressor), which one hash aggregate gives;
they are kept in binary blocks, and every step is one pass over them without a shuffle: tasks add up the
expected random effects in vectorised steps and send one array each. The likelihood never falls from step to step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.functions.columns import dot
from longspan.functions.linalg import cross_products
from longspan.operators.newton import partial_sums
from longspan.session import cut_lineage, reused

TOLERANCE = 1e-7
MAX_ITERATIONS = 200


def _expected(beta: np.ndarray, spread: np.ndarray, variance: float):  # type: ignore[no-untyped-def]
    """rows of sums -> (effects, their variances, Z'Z, Z'y, Z'X, quadratic form, log determinant) per participant."""
    inverse, log_spread = np.linalg.inv(spread), float(np.log(np.linalg.det(spread)))

    def run(s: np.ndarray):  # type: ignore[no-untyped-def]
        zz = np.stack([s[:, 0], s[:, 1], s[:, 1], s[:, 2]], axis=1).reshape(-1, 2, 2)
        zy = s[:, 3:5]
        # Columns of Z'X: the constant first, then the regressors.
        zx = np.concatenate([zz[:, :, :1], s[:, 5:].reshape(len(s), -1, 2).transpose(0, 2, 1)], axis=2)
        precision = zz / variance + inverse
        v = np.linalg.inv(precision)
        r = zy - zx @ beta
        b = np.einsum("nij,nj->ni", v, r) / variance
        quadratic = np.einsum("ni,ni->n", r, b) / variance
        return b, v, zz, zy, zx, quadratic, np.log(np.linalg.det(precision)) + log_spread

    return run


def _sums(batch: pa.RecordBatch) -> np.ndarray:
    return batch["sums"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _blocks(people: DataFrame) -> DataFrame:
    """The sums of up to an Arrow batch of participants as one binary value, which a step reads without conversion."""

    def run(batches):  # type: ignore[no-untyped-def]
        for batch in batches:
            if batch.num_rows:
                block = np.ascontiguousarray(_sums(batch), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([block.tobytes()])], ["n", "block"])

    return people.select("sums").mapInArrow(run, "n long, block binary")


def _step(beta: np.ndarray, spread: np.ndarray, variance: float):  # type: ignore[no-untyped-def]
    expected = _expected(beta, spread, variance)

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        return sum(one(np.frombuffer(block.as_py()).reshape(n.as_py(), -1)) for n, block in zip(batch["n"], batch["block"]))

    def one(block: np.ndarray) -> np.ndarray:
        b, v, zz, zy, zx, quadratic, log_det = expected(block)
        second = np.einsum("ni,nj->nij", b, b) + v
        return np.concatenate([
            second.sum(axis=0).ravel(), np.einsum("niq,ni->q", zx, b),
            [(zy * b).sum(), np.einsum("nij,nji->", zz, second), quadratic.sum(), log_det.sum(), len(b)],
        ])

    return sums


@dataclass
class MixedModel:
    """y = b'x + (random intercept) + (random slope) time + noise, fitted by maximum likelihood.

    Missing regressors and times count as 0; rows without a target or a group are left out. Unknown groups
    are predicted by the fixed part.
    """

    features: Sequence[str]
    time: str = "horizon_years"
    group: str = "participant_id"
    max_iterations: int = MAX_ITERATIONS
    tolerance: float = TOLERANCE
    coefficients: list[float] = field(default_factory=list)
    spread: np.ndarray | None = None
    variance: float = 0.0
    log_likelihoods: list[float] = field(default_factory=list)
    effects: DataFrame | None = None

    def _x(self) -> list[Column]:
        return [self._filled(c) for c in self.features]

    @staticmethod
    def _filled(column: str) -> Column:
        value = F.col(column).cast("double")
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))

    def fit(self, frame: DataFrame, target: str = "future_score") -> "MixedModel":
        y, t, x = F.col(target).cast("double"), self._filled(self.time), self._x()
        kept = frame.where(y.isNotNull() & ~F.isnan(y) & F.col(self.group).isNotNull())
        # Three passes read the rows: written once, without the plan behind them.
        rows = cut_lineage(
            kept.select(F.col(self.group).alias("group"), t.alias("t"), y.alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
        )
        y, t, x = F.col("y"), F.col("t"), [F.col(f"x{i}") for i in range(len(x))]
        gram, n = cross_products(rows, [F.lit(1.0), *x, y])
        if not n:
            raise ValueError("No rows to fit")
        q = len(x) + 1
        sums = [F.count(F.lit(1)).cast("double"), F.sum(t), F.sum(t * t), F.sum(y), F.sum(t * y)]
        for c in x:
            sums += [F.sum(c), F.sum(t * c)]
        # As a table the sums are read in few partitions, whatever the shuffle had: each of up to 200 steps starts a task for each.
        people = cut_lineage(rows.groupBy("group").agg(F.array(*sums).alias("sums")).coalesce(rows.sparkSession.sparkContext.defaultParallelism))
        with reused(_blocks(people)) as blocks:
            self._maximise(blocks, gram[:q, :q], gram[:q, q], gram[q, q], n, float(rows.agg(F.avg(t * t)).first()[0]))
        self.effects = cut_lineage(self._effects(people))
        return self

    def _maximise(self, blocks: DataFrame, xx: np.ndarray, xy: np.ndarray, yy: float, n: int, mean_square_time: float) -> None:
        q = len(xy)
        beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
        variance = max((yy - 2 * beta @ xy + beta @ xx @ beta) / n, 1e-9)
        spread = np.diag([variance / 2, variance / 2 / max(mean_square_time, 1e-9)])
        self.log_likelihoods = []
        for _ in range(self.max_iterations):
            total = partial_sums(blocks, _step(beta, spread, variance), 9 + q)
            second, xzb = total[:4].reshape(2, 2), total[4 : 4 + q]
            yzb, trace, quadratic, log_det, groups = total[4 + q :]
            rss = yy - 2 * beta @ xy + beta @ xx @ beta
            self.log_likelihoods.append(-0.5 * (n * np.log(2 * np.pi * variance) + log_det + rss / variance - quadratic))
            self.coefficients, self.spread, self.variance = [float(v) for v in beta], spread, variance
            if len(self.log_likelihoods) > 1 and self.log_likelihoods[-1] - self.log_likelihoods[-2] <= self.tolerance * (1 + abs(self.log_likelihoods[-1])):
                break
            beta = np.linalg.lstsq(xx, xy - xzb, rcond=None)[0]
            spread = second / groups + 1e-12 * np.eye(2)
            rss = yy - 2 * beta @ xy + beta @ xx @ beta
            variance = max((rss - 2 * (yzb - beta @ xzb) + trace) / n, 1e-9)

    def _effects(self, people: DataFrame) -> DataFrame:
        expected = _expected(np.array(self.coefficients), self.spread, self.variance)

        def run(batches):  # type: ignore[no-untyped-def]
            for batch in batches:
                if batch.num_rows:
                    b = expected(_sums(batch))[0]
                    yield pa.RecordBatch.from_arrays([batch["group"], pa.array(b[:, 0]), pa.array(b[:, 1])], ["group", "intercept_effect", "slope_effect"])

        kind = people.schema["group"].dataType.simpleString()
        found = people.mapInArrow(run, f"group {kind}, intercept_effect double, slope_effect double")
        return found.withColumnRenamed("group", self.group)

    def fixed(self) -> Column:
        return dot(self._x(), self.coefficients[1:]) + F.lit(self.coefficients[0])

    def predict(self, frame: DataFrame, out: str = "predicted_future_score") -> DataFrame:
        """All columns of ``frame`` and the prediction with the person's effects, 0 for unknown ones."""
        if self.effects is None:
            raise RuntimeError("MixedModel must be fitted before predict")
        own = self.effects.select(F.col(self.group).alias("__group"), "intercept_effect", "slope_effect")
        joined = frame.select("*", self.fixed().alias("__fixed"), self._filled(self.time).alias("__time")).join(
            own, F.col(self.group) == F.col("__group"), "left"
        )
        effect = F.coalesce(F.col("intercept_effect"), F.lit(0.0)) + F.coalesce(F.col("slope_effect"), F.lit(0.0)) * F.col("__time")
        return joined.select(*[joined[f"`{c}`"] for c in frame.columns], (F.col("__fixed") + effect).alias(out))

    def person_effects(self, people: DataFrame) -> DataFrame:
        """Effects of the asked participants; unknown ones get zeros."""
        found = people.select(self.group).join(self.effects, self.group, "left")
        return found.select(self.group, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("intercept_effect", "slope_effect")])
