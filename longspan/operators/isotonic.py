"""Exact isotonic regression by pooling adjacent violators in parallel.

Equal scores are counted first. The distinct scores are cut into ranges, and each task pools the
violators of its range, which gives blocks; pooling is free to go in any order, so blocks pooled
in a range are blocks of a coarser problem with the same solution. Where the last block of a range is not
below the first of the next, the two ranges are pooled as one, until no border is violated. Of the
blocks, only the first and last of every range reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.functions.columns import null_if_nan
from longspan.operators.ordered import RANGE, range_edges, with_range
from longspan.session import cut_lineage

RANGE_POINTS = 200_000
MAX_RANGES = 4096
BROADCAST_KNOTS = 500_000
SCHEMA = "lo double, hi double, total double, weight double, part double"


def _pooling():  # type: ignore[no-untyped-def]
    """Pools the violators of one range; the range number goes along as ``part``."""
    part_column, names = RANGE, ("lo", "hi", "total", "weight")

    def pool(table: pa.Table) -> pa.Table:
        order = np.argsort(table["lo"].to_numpy(), kind="stable")
        blocks: list[list[float]] = [[], [], [], []]
        first, last, sums, sizes = blocks
        for a, b, s, w in zip(*(table[c].to_numpy()[order].tolist() for c in names), strict=True):
            while sums and sums[-1] * w >= s * sizes[-1]:
                a, s, w = first.pop(), s + sums.pop(), w + sizes.pop()
                last.pop()
            for column, value in zip(blocks, (a, b, s, w), strict=True):
                column.append(value)
        out = {c: pa.array(v, pa.float64()) for c, v in zip(names, blocks, strict=True)}
        return pa.table({**out, "part": pa.array([table[part_column][0].as_py()] * len(first), pa.float64())})

    return pool


def violated_borders(blocks: DataFrame, edges: Sequence[float]) -> list[float]:
    """Edges between ranges whose neighbouring blocks are out of order; of a row of such edges every other one."""
    mean = F.struct(F.col("total"), F.col("weight"))
    ends = blocks.groupBy("part").agg(
        F.min("lo").alias("lo"), F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last")
    ).orderBy("part").collect()
    found: list[float] = []
    skipped = True
    for left, right in zip(ends, ends[1:], strict=False):
        skipped = not (skipped and left["last"].total * right["first"].weight >= right["first"].total * left["last"].weight)
        if not skipped:
            # Empty ranges between the two go with them.
            found += [e for e in edges if left.lo < e <= right.lo]
    return found


def isotonic_blocks(
    scored: DataFrame, y: str, score: str, weight: Column | None = None, range_points: int = RANGE_POINTS
) -> DataFrame:
    """Blocks (lo, hi, total, weight) of the non-decreasing least-squares fit of ``y`` on ``score``.

    A block's value is total / weight. Rows with a NULL or NaN score, a NULL label or no weight are
    left out; without rows there is no block.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = scored.select(null_if_nan(F.col(score).cast("double")).alias("lo"), F.col(y).cast("double").alias("__y"), w.alias("__w"))
    rows = rows.where(F.col("lo").isNotNull() & F.col("__y").isNotNull() & (F.col("__w") > 0))
    points = rows.groupBy("lo").agg(F.sum(F.col("__y") * F.col("__w")).alias("total"), F.sum("__w").alias("weight"))
    blocks = cut_lineage(points.select("lo", F.col("lo").alias("hi"), "total", "weight"))
    edges = range_edges(blocks, "lo", max(1, min(MAX_RANGES, math.ceil(blocks.count() / range_points))))
    while True:
        ranged = with_range(blocks.drop("part"), "lo", edges)
        blocks = cut_lineage(ranged.groupBy(RANGE).applyInArrow(_pooling(), SCHEMA))
        merged = violated_borders(blocks, edges)
        if not merged:
            return blocks.drop("part")
        edges = [e for e in edges if e not in merged]


@dataclass
class IsotonicMap:
    """Calibration map: a block's value inside it, linear between blocks, constant outside."""

    knots: DataFrame | None = None
    size: int = 0
    broadcast_knots: int = BROADCAST_KNOTS

    def fit(self, scored: DataFrame, y: str, score: str, weight: Column | None = None, range_points: int = RANGE_POINTS) -> "IsotonicMap":
        value = F.col("total") / F.col("weight")
        blocks = isotonic_blocks(scored, y, score, weight, range_points).select("lo", "hi", value.alias("v"))
        self.knots = cut_lineage(blocks.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), "v"))
        self.size = self.knots.count()
        return self

    def transform(self, frame: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
        """All columns of ``frame`` and the calibrated score; NULL and NaN scores give NULL.

        A map of at most ``broadcast_knots`` knots is broadcast; a larger one meets the distinct scores
        range by range.
        """
        if self.knots is None:
            raise RuntimeError("IsotonicMap must be fitted before transform")
        if not self.size:
            return frame.withColumn(out, F.lit(None).cast("double"))
        if self.size > self.broadcast_knots:
            return self._by_ranges(frame, score, out)
        rows = sorted(map(tuple, self.knots.collect()))
        shared = frame.sparkSession.sparkContext.broadcast(tuple(np.array(c) for c in zip(*rows, strict=True)))

        @F.pandas_udf("double")
        def interpolated(values):  # type: ignore[no-untyped-def]
            import pandas as pd

            x, v = shared.value
            s = values.to_numpy(dtype=float)
            return pd.Series(np.where(np.isnan(s), np.nan, np.interp(s, x, v))).astype("Float64").mask(np.isnan(s))

        return frame.withColumn(out, interpolated(F.col(score).cast("double")))

    def _by_ranges(self, frame: DataFrame, score: str, out: str) -> DataFrame:
        asked = null_if_nan(F.col(score).cast("double"))
        scores = frame.where(asked.isNotNull()).select(asked.alias("x")).distinct()
        edges = range_edges(self.knots, "x", min(MAX_RANGES, math.ceil(self.size / RANGE_POINTS) + 1))
        both = self.knots.unionByName(scores.select("x", F.lit(None).cast("double").alias("v")))
        ranged = with_range(both, "x", edges)
        knot = F.when(F.col("v").isNotNull(), F.struct("x", "v"))
        inside = Window.partitionBy(RANGE).orderBy("x", F.col("v").isNull())
        near = ranged.select(
            RANGE, "x", "v",
            F.last(knot, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("before"),
            F.first(knot, ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
        ).where("v IS NULL")
        # Knots of other ranges: one row per range, so this window is at most MAX_RANGES rows.
        ends = ranged.groupBy(RANGE).agg(F.min(knot).alias("first"), F.max(knot).alias("last"))
        every = Window.partitionBy(F.lit(0)).orderBy(RANGE)
        ends = ends.select(
            RANGE,
            F.last("last", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, -1)).alias("left"),
            F.first("first", ignorenulls=True).over(every.rowsBetween(1, Window.unboundedFollowing)).alias("right"),
        )
        placed = near.join(ends, RANGE).select("x", F.coalesce("before", "left").alias("a"), F.coalesce("after", "right").alias("b"))
        share = (F.col("x") - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))
        between = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * share
        value = F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull(), F.col("a.v")).otherwise(between)
        found = placed.select(F.col("x").alias("__x"), value.alias(out))
        return frame.join(found, asked == F.col("__x"), "left").select(*[F.col(f"`{c}`") for c in frame.columns], out)
