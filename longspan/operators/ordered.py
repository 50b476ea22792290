"""Running totals, ranks and exact quantiles that never need one big task.

A window without a partition column, or with a hot one, sorts a whole group
in a single task. Here the order key is first cut into ranges. Each range is
scanned by its own window partition, and the (small) range totals are scanned
once more to give every range its starting value.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.session import cut_lineage

RANGE = "__range"


def range_edges(df: DataFrame, order: str, ranges: int | None = None) -> list[float]:
    """Approximate equal-count edges of ``order``; at most ``ranges`` doubles."""
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(ranges, 4096))
    if ranges == 1:
        return []
    cuts = [i / ranges for i in range(1, ranges)]
    row = df.select(
        F.percentile_approx(F.col(order).cast("double"), cuts, max(1000, 20 * ranges)).alias("edges")
    ).first()
    return sorted(set(row.edges or []))


def with_range(df: DataFrame, order: str, edges: Sequence[float]) -> DataFrame:
    """Add the range index of ``order``; equal keys always share a range."""
    if not edges:
        return df.withColumn(RANGE, F.lit(0.0))
    keyed = df.withColumn("__order", F.col(order).cast("double"))
    splits = [-math.inf, *edges, math.inf]
    return Bucketizer(splits=splits, inputCol="__order", outputCol=RANGE, handleInvalid="keep").transform(keyed).drop("__order")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` that keeps rows whose key is NULL; the columns of both sides, the keys once."""
    there = right.select(*[F.col(k).alias(f"__key_{i}") if k in keys else F.col(k) for i, k in enumerate(right.columns)])
    condition = F.lit(True)
    for i, k in enumerate(right.columns):
        if k in keys:
            condition = condition & left[k].eqNullSafe(there[f"__key_{i}"])
    return left.join(there, condition).drop(*[c for c in there.columns if c.startswith("__key_")])


def running(
    df: DataFrame,
    order: str,
    totals: Mapping[str, Column] | None = None,
    products: Mapping[str, Column] | None = None,
    by: Sequence[str] = (),
    descending: bool = False,
    exclusive: bool = False,
    ranges: int | None = None,
    range_key: Column | None = None,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Cumulative sums / products along ``order`` within ``by``.

    ``df`` holds one row per (``by``, ``order``). ``range_key`` may give a
    column that is monotone in ``order`` (a year for dates), or ``edges`` the
    range borders; either saves the pass that looks for them.
    """
    totals, products, by = dict(totals or {}), dict(products or {}), list(by)
    if range_key is not None:
        ranged = df.withColumn(RANGE, range_key.cast("double"))
    else:
        ranged = with_range(df, order, range_edges(df, order, ranges) if edges is None else edges)
    key = F.col(order).desc() if descending else F.col(order).asc()
    range_order = F.col(RANGE).desc() if descending else F.col(RANGE).asc()
    last = -1 if exclusive else Window.currentRow
    inner = Window.partitionBy(*by, RANGE).orderBy(key).rowsBetween(Window.unboundedPreceding, last)
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(range_order).rowsBetween(Window.unboundedPreceding, -1)

    staged = ranged.select(
        "*",
        *[c.alias(f"__v_{name}") for name, c in {**totals, **products}.items()],
    )
    starts = staged.groupBy(*by, RANGE).agg(
        *[F.sum(f"__v_{n}").alias(f"__r_{n}") for n in totals],
        *[F.product(f"__v_{n}").alias(f"__r_{n}") for n in products],
    )
    starts = starts.select(
        *by,
        RANGE,
        *[F.coalesce(F.sum(f"__r_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in totals],
        *[F.coalesce(F.product(f"__r_{n}").over(before), F.lit(1.0)).alias(f"__s_{n}") for n in products],
    )
    local = staged.select(
        "*",
        *[F.coalesce(F.sum(f"__v_{n}").over(inner), F.lit(0)).alias(f"__l_{n}") for n in totals],
        *[F.coalesce(F.product(f"__v_{n}").over(inner), F.lit(1.0)).alias(f"__l_{n}") for n in products],
    )
    joined = join_null_safe(local, starts, [*by, RANGE])
    return joined.select(
        *df.columns,
        *[(F.col(f"__l_{n}") + F.col(f"__s_{n}")).alias(n) for n in totals],
        *[(F.col(f"__l_{n}") * F.col(f"__s_{n}")).alias(n) for n in products],
    )


def position_within(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    tie: str,
    out: str = "position",
    range_key: Column | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """0-based position of every row inside ``by``, ordered by ``order`` then ``tie``.

    Same result as ``row_number() - 1``, but a hot ``by`` group is spread over
    ranges of ``order``.
    """
    by = list(by)
    if range_key is not None:
        ranged = df.withColumn(RANGE, range_key.cast("double"))
    else:
        ranged = with_range(df, order, range_edges(df, order, ranges))
    inner = Window.partitionBy(*by, RANGE).orderBy(F.col(order).asc_nulls_last(), F.col(tie))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col(RANGE).asc_nulls_last())
    starts = ranged.groupBy(*by, RANGE).agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select(
        *by,
        F.col(RANGE).alias("__start_range"),
        F.coalesce(F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"),
    )
    local = ranged.withColumn("__local", F.row_number().over(inner) - 1)
    condition = F.col(f"l.{RANGE}").eqNullSafe(F.col("s.__start_range"))
    for name in by:
        condition = condition & F.col(f"l.{name}").eqNullSafe(F.col(f"s.{name}"))
    return (
        local.alias("l")
        .join(starts.alias("s"), condition)
        .select(*[F.col(f"l.{c}") for c in df.columns], (F.col("__local") + F.col("__start")).alias(out))
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float] | None = None,
    by: Sequence[str] = (),
    kind: str = "linear",
    ranges: int | None = None,
    level: Column | None = None,
) -> DataFrame:
    """Exact quantiles per group as rows (``by``, ``probability``, ``quantile``, ``n``).

    ``kind`` is ``linear`` (interpolated) or ``higher`` (next order statistic).
    Instead of fixed ``probabilities``, ``level`` may be an expression over the
    group size ``n``. Values are counted first, so the built-in exact
    percentile's one-task value map is not needed; the counts are written once,
    because four passes read them, and ``df`` may be a long plan.
    """
    by = list(by)
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c")))
    upto = running(counts, value, {"__upto": F.col("__c")}, by=by, ranges=ranges)
    sizes = counts.groupBy(*by).agg(F.sum("__c").alias("n"))
    placed = upto.join(sizes, by) if by else upto.withColumn("n", sizes.scalar())
    if level is not None:
        placed = placed.withColumn("probability", level)
    else:
        placed = placed.withColumn(
            "probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
        )
    # The product p * (n - 1) carries rounding noise; snap it to the integer it stands for.
    place = F.col("probability") * (F.col("n") - 1)
    place = F.when(F.abs(place - F.round(place)) < 1e-9, F.round(place)).otherwise(place)
    placed = placed.withColumn("__h", place)
    first, last = F.col("__upto") - F.col("__c"), F.col("__upto")
    covers_low = (first <= F.floor("__h")) & (F.floor("__h") < last)
    covers_high = (first <= F.ceil("__h")) & (F.ceil("__h") < last)
    picked = (
        placed.where(covers_low | covers_high)
        .groupBy(*by, "probability", "n", "__h")
        .agg(
            F.max(F.when(covers_low, F.col(value))).cast("double").alias("__low"),
            F.max(F.when(covers_high, F.col(value))).cast("double").alias("__high"),
        )
    )
    if kind == "higher":
        quantile = F.col("__high")
    else:
        quantile = F.col("__low") + (F.col("__high") - F.col("__low")) * (F.col("__h") - F.floor("__h"))
    return picked.select(*by, "probability", quantile.alias("quantile"), "n")


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], ranges: int | None = None
) -> dict[str, list[float | None]]:
    """Exact quantiles of many columns at once; the result has one row per column."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
        ).alias("cell")
    ).select("cell.feature", "cell.value")
    rows = exact_quantiles(long, "value", probabilities, by=["feature"], ranges=ranges).collect()
    found = {(row.feature, row.probability): row["quantile"] for row in rows}
    return {c: [found.get((c, float(p))) for p in probabilities] for c in columns}
