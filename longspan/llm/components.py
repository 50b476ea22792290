"""Connected components of a link table by alternating stars, on Spark joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.session import cut_lineage


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours (larger ones, or all smaller ones and the node) move to the smallest neighbour."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    moved = both.join(least, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        own = least.where("least < a").select("a", F.col("least").alias("b"))
        moved = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(own)
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b) but the smallest of each component.

    Each round is a large and a small star (logarithmically many); the labels stand still when every
    node points to a root that points nowhere. Only that count reaches the driver.
    """
    links = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("x"))
        ups = ends.select("x.*").groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
        # Done when a node either points up once and is pointed at by none, or only is pointed at.
        if ups.where("up > 1 OR (up = 1 AND n > 1)").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        links = cut_lineage(_stars(_stars(links, True), False))
