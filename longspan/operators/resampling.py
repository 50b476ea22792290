"""Bootstrap replicates as arrays: the rows move once, whatever the number of replicates.

Every row is dealt to the range of its score once. A task draws the Poisson(1) weights of its rows
for all replicates in vectorised steps (the same integer draw as ``seeded_draw``), sums them per
distinct score and scans the scores, so a replicate is a column of an array and not a copy of the table.
A range sends its totals only: 4 doubles per replicate. A score that alone would overfill a range is
summed by (score, replicate) before, map-side, so a hot score costs replicates, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.functions.columns import DRAW_MODULI, POISSON_ONE_CDF, poisson_one, seeded_draw
from longspan.operators.newton import partial_sums
from longspan.operators.ordered import RANGE, range_edges, with_range

#: Ranges whose totals reach the driver: at most this many arrays per model and pass.
MAX_RANGES = 512
HOT_ROWS = 20_000
BATCH = 1024


def _weights_function(n_bootstrap: int, seed: int):  # type: ignore[no-untyped-def]
    """keys -> (keys x (1 + replicates)) weights; column 0 is the full sample."""
    moduli, thresholds = DRAW_MODULI, np.array(POISSON_ONE_CDF)

    def weights(keys: np.ndarray) -> np.ndarray:
        seeds = np.arange(n_bootstrap, dtype=np.int64)[None, :] + seed
        total = np.zeros((len(keys), n_bootstrap))
        for m in moduli:
            k = (keys.astype(np.int64) % m)[:, None]
            a = (k * 1_103_515_245 + seeds * 12_345 + 6_789) % m
            total = total + ((a * a + k) % m).astype(float) / float(m)
        drawn = np.searchsorted(thresholds, total - np.floor(total), side="right")
        return np.hstack([np.ones((len(keys), 1)), drawn])

    return weights


def replicate_totals(frame: DataFrame, columns: Sequence[str], n_bootstrap: int, seed: int = 42, key: str = "participant_key") -> np.ndarray:
    """(replicates x (2 + columns)): drawn units, sum of weights, and weighted sum of every column; nothing is shuffled but one array per task."""
    weights = _weights_function(n_bootstrap, seed)
    width = n_bootstrap * (2 + len(columns))
    names = list(columns)

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((n_bootstrap, 2 + len(names)))
        keys = batch["key"].to_numpy(zero_copy_only=False)
        values = [batch[c].to_numpy(zero_copy_only=False).astype(float) for c in names]
        for start in range(0, len(keys), 1024):
            w = weights(keys[start : start + 1024])[:, 1:]
            out[:, 0] += (w > 0).sum(axis=0)
            out[:, 1] += w.sum(axis=0)
            for i, v in enumerate(values):
                out[:, 2 + i] += v[start : start + 1024] @ w
        return out.ravel()

    rows = frame.select(F.col(key).cast("long").alias("key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    return partial_sums(rows, sums, width).reshape(n_bootstrap, 2 + len(names))


def _score_sums(weights, width: int, batch_rows: int):  # type: ignore[no-untyped-def]
    """table -> batches (scores ascending, positives x replicates, negatives x replicates)."""

    def groups(table: pa.Table):  # type: ignore[no-untyped-def]
        score = table["score"].to_numpy(zero_copy_only=False)
        order = np.argsort(score, kind="stable")
        score = score[order]
        unit = table["unit"].fill_null(0).to_numpy(zero_copy_only=False)[order]
        y = table["y"].fill_null(0).to_numpy(zero_copy_only=False)[order]
        place = table["place"].fill_null(-1).to_numpy(zero_copy_only=False)[order]
        pos, neg = (table[c].fill_null(0.0).to_numpy(zero_copy_only=False)[order] for c in ("pos", "neg"))
        pending = None
        for start in range(0, len(score), batch_rows):
            at = slice(start, start + batch_rows)
            drawn = weights(unit[at])
            summed = place[at] >= 0
            drawn[summed] = 0.0
            one = drawn * (y[at] == 1)[:, None]
            zero = drawn - one
            rows = np.flatnonzero(summed)
            one[rows, place[at][rows]] = pos[at][rows]
            zero[rows, place[at][rows]] = neg[at][rows]
            values, first = np.unique(score[at], return_index=True)
            one, zero = np.add.reduceat(one, first), np.add.reduceat(zero, first)
            if pending is not None:
                if pending[0] == values[0]:
                    one[0] += pending[1]
                    zero[0] += pending[2]
                else:
                    values = np.concatenate([[pending[0]], values])
                    one, zero = np.vstack([pending[1], one]), np.vstack([pending[2], zero])
            pending = (values[-1], one[-1], zero[-1])
            if len(values) > 1:
                yield values[:-1], one[:-1], zero[:-1]
        if pending is not None:
            yield np.array([pending[0]]), pending[1][None], pending[2][None]

    return groups


def _totals(groups, width: int):  # type: ignore[no-untyped-def]
    def totals(table: pa.Table) -> pa.Table:
        p, n, wins, squared = (np.zeros(width) for _ in range(4))
        for score, one, zero in groups(table):
            upto = n + np.cumsum(zero, axis=0)
            wins += (one * (upto - zero / 2.0)).sum(axis=0)
            p += one.sum(axis=0)
            n = upto[-1]
            squared += (one * ((1.0 - score) ** 2)[:, None] + zero * (score**2)[:, None]).sum(axis=0)
        return pa.table({"model": table["model"][:1], "part": table["part"][:1], "sums": pa.array([np.concatenate([p, n, wins, squared])], pa.list_(pa.float64()))})

    return totals


def _precisions(groups, width: int, shared):  # type: ignore[no-untyped-def]
    def precisions(table: pa.Table) -> pa.Table:
        p, n = shared.value[table["model"][0].as_py(), table["part"][0].as_py()]
        total = np.zeros(width)
        for _, one, zero in groups(table):
            # Above and at each score, counted down from what lies at or above the batch.
            tp = p - (np.cumsum(one, axis=0) - one)
            fp = n - (np.cumsum(zero, axis=0) - zero)
            size = tp + fp
            total += np.where(size > 0, one * tp / np.where(size > 0, size, 1.0), 0.0).sum(axis=0)
            p, n = p - one.sum(axis=0), n - zero.sum(axis=0)
        return pa.table({"model": table["model"][:1], "part": table["part"][:1], "sums": pa.array([total], pa.list_(pa.float64()))})

    return precisions


def replicate_metrics(
    frame: DataFrame, y: str, scores: Sequence[str], n_bootstrap: int, seed: int, key: Column, precision: bool = True,
    hot_rows: int = HOT_ROWS, batch_rows: int = BATCH,
) -> DataFrame:
    """(replicate, model, auroc, auprc, brier); replicate -1 is the full sample.

    ``precision=False`` leaves auprc NULL and saves the second pass. Replicates without both classes have NULL metrics.
    """
    spark = frame.sparkSession
    width = n_bootstrap + 1
    cells = [F.struct(F.lit(i).alias("model"), F.col(s).cast("double").alias("score")) for i, s in enumerate(scores)]
    rows = frame.where(F.col(y).isNotNull()).select(F.col(y).cast("int").alias("y"), key.cast("long").alias("unit"), F.explode(F.array(*cells)).alias("c"))
    rows = rows.select("c.model", "c.score", "y", "unit").where(F.col("score").isNotNull())
    ranges = min(MAX_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = range_edges(rows, "score", ranges)
    # At most ``ranges`` scores per model exceed their fair share.
    counts = rows.groupBy("model", "score").agg(F.count(F.lit(1)).alias("n"))
    fair = max(hot_rows, rows.count() // (ranges * max(1, len(scores))))
    hot = F.broadcast(counts.where(F.col("n") > fair).select("model", "score"))
    replicate = F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap))).alias("place")
    drawn = rows.join(hot, ["model", "score"], "left_semi").select("model", "score", "y", "unit", replicate)
    weight = F.when(F.col("place") == 0, 1).otherwise(poisson_one(seeded_draw("unit", F.lit(seed - 1) + F.col("place")))).cast("double")
    summed = drawn.groupBy("model", "score", "place").agg(
        F.sum(F.when(F.col("y") == 1, weight).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0.0).otherwise(weight)).alias("neg")
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in (("place", "int"), ("pos", "double"), ("neg", "double"))]
    cold = rows.join(hot, ["model", "score"], "left_anti").select("model", "score", "y", "unit", *none)
    parts = cold.unionByName(summed.select("model", "score", F.lit(None).cast("int").alias("y"), F.lit(None).cast("long").alias("unit"), "place", "pos", "neg"))
    dealt = with_range(parts, "score", edges).withColumnRenamed(RANGE, "part").groupBy("model", "part")
    groups = _score_sums(_weights_function(n_bootstrap, seed), width, batch_rows)
    schema = "model int, part double, sums array<double>"
    found = {(r.model, r.part): np.array(r.sums).reshape(4, width) for r in dealt.applyInArrow(_totals(groups, width), schema).collect()}
    p, n, wins, squared = (np.zeros((len(scores), width)) for _ in range(4))
    above = {}
    for (model, part), sums in sorted(found.items()):
        wins[model] += sums[2] + sums[0] * n[model]
        p[model] += sums[0]
        n[model] += sums[1]
        squared[model] += sums[3]
    left_p, left_n = p.copy(), n.copy()
    for (model, part), sums in sorted(found.items()):
        above[model, part] = (left_p[model].copy(), left_n[model].copy())
        left_p[model] -= sums[0]
        left_n[model] -= sums[1]
    average = np.zeros((len(scores), width))
    if precision and found:
        shared = spark.sparkContext.broadcast(above)
        for r in dealt.applyInArrow(_precisions(groups, width, shared), schema).collect():
            average[r.model] += np.array(r.sums)
    out = []
    for i, name in enumerate(scores):
        for b in range(width):
            usable = p[i, b] > 0 and n[i, b] > 0
            out.append((
                b - 1, name, float(wins[i, b] / (p[i, b] * n[i, b])) if usable else None,
                float(average[i, b] / p[i, b]) if usable and precision else None, float(squared[i, b] / (p[i, b] + n[i, b])) if usable else None,
            ))
    return spark.createDataFrame(out, "replicate int, model string, auroc double, auprc double, brier double")
