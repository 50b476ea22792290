"""Exact path-dependent Shapley attributions of tree models.

A fitted tree is read as a table of nodes. Each leaf becomes one row of conditions: per feature on its path
an interval, and the share of the training rows that the path keeps at the splits on that feature. A leaf then
plays a product game: a known feature counts 1 or 0, inside or outside its interval, an unknown one its share.
The Shapley value of feature i in a product game is

    value * (inside_i - share_i) * integral over t in [0, 1] of prod_{j != i} ((1 - t) * share_j + t * inside_j)

because s! (m - s)! / (m + 1)! is the integral of t^s (1 - t)^(m - s). The integrand is a polynomial of a degree
below the number of features on the path, so a few Gauss-Legendre points give it exactly, and no subsets
are listed.

Rows never meet or move: the attribution is a projection over Arrow batches, in blocks of rows of bounded size.
Only the model, trees x 2^depth leaves, goes through the driver and to the tasks.

Defined results: per row the attributions and the base (the mean over the training rows as the nodes counted
them) add up to the model's output. A feature that no tree splits on gets 0, a tree of one leaf adds to
the base alone. NaN goes to the right at every split, as in the model. Splits on categories raise
ValueError. An empty frame gives an empty frame.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.operators.risk import VECTOR, BoostedRisk
from longspan.session import fresh_path

BLOCK_CELLS = 2_000_000


@dataclass
class LeafPaths:
    """The leaves of one tree; unused places hold an interval that all values meet and a share of 1."""

    value: np.ndarray  # leaf
    feature: np.ndarray  # leaf, place
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    @property
    def base(self) -> float:
        return float((self.value * self.share.prod(axis=1)).sum())

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """rows x features."""
        leaves, places = self.share.shape
        out = np.zeros(x.shape)
        if not places:
            return out
        points, weights = np.polynomial.legendre.leggauss((places + 1) // 2)
        points, weights = (points + 1) / 2, weights / 2
        onto = np.zeros((leaves * places, x.shape[1]))
        onto[np.arange(leaves * places), self.feature.ravel()] = 1.0
        block = max(1, BLOCK_CELLS // (leaves * places * len(points)))
        for at in range(0, len(x), block):
            own = x[at : at + block][:, self.feature]
            inside = ~(own <= self.low) & ((own <= self.high) | np.isposinf(self.high))
            known = self.share[..., None] * (1 - points) + inside[..., None] * points
            others = (known.prod(axis=2, keepdims=True) / known) @ weights
            cells = self.value[:, None] * (inside - self.share) * others
            out[at : at + block] = cells.reshape(len(own), -1) @ onto
        return out


def _leaves(nodes: dict, scale: float, probability: bool) -> LeafPaths:
    rows: list[tuple[float, dict[int, tuple[float, float, float]]]] = []
    open_nodes = [(nodes[0], {})]
    while open_nodes:
        node, path = open_nodes.pop()
        if node.leftChild < 0:
            stats = node.impurityStats
            value = stats[1] / sum(stats) if probability else node.prediction
            rows.append((scale * value, path))
            continue
        if node.split.numCategories != -1:
            raise ValueError("Splits on categories have no interval")
        feature, cut = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
        left, right = nodes[node.leftChild], nodes[node.rightChild]
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        kept = left.rawCount / (left.rawCount + right.rawCount)
        open_nodes.append((left, {**path, feature: (low, min(high, cut), share * kept)}))
        open_nodes.append((right, {**path, feature: (max(low, cut), high, share * (1 - kept))}))
    shape = (len(rows), max(len(path) for _, path in rows))
    out = LeafPaths(
        np.array([v for v, _ in rows]), np.zeros(shape, int), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape)
    )
    for i, (_, path) in enumerate(rows):
        for j, (feature, (low, high, share)) in enumerate(path.items()):
            out.feature[i, j], out.low[i, j], out.high[i, j], out.share[i, j] = feature, low, high, share
    return out


def node_table(model, spark: SparkSession) -> DataFrame:  # type: ignore[no-untyped-def]
    """One row per node of every tree: tree, and the fields of the saved model."""
    path = fresh_path(spark)
    model.save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "treeID" in saved.columns:
        return saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    return saved.select(F.lit(0).alias("tree"), "*")


def leaf_paths(model, spark: SparkSession) -> list[LeafPaths]:  # type: ignore[no-untyped-def]
    """The trees of a Spark ML model, weighted so that their sum is its output.

    That is the prediction of a regression, the probability of class 1 of a forest or tree that classifies,
    and the log-odds (twice the margin) of boosted trees that classify.
    """
    trees: dict[int, dict] = {}
    for node in node_table(model, spark).collect():
        trees.setdefault(node.tree, {})[node.id] = node
    boosted, classes = type(model).__name__.startswith("GBT"), getattr(model, "numClasses", 0)
    if classes > 2:
        raise ValueError("Attributions need two classes")
    if boosted:
        scales = [w * (2.0 if classes else 1.0) for w in model.treeWeights]
    else:
        scales = [1.0 / len(trees)] * len(trees)
    return [_leaves(trees[t], scales[t], bool(classes) and not boosted) for t in sorted(trees)]


def shapley_values(vector: Column, paths: Sequence[LeafPaths]) -> Column:
    """array<double>, one attribution per element of an array of features."""

    @F.pandas_udf("array<double>")
    def values(rows: pd.Series) -> pd.Series:
        if rows.empty:
            return pd.Series([], dtype=object)
        x = np.stack(rows.to_numpy()).astype(float)
        return pd.Series(list(sum((p.attributions(x) for p in paths), np.zeros(x.shape))))

    return values(vector)


def tree_attribution(
    frame: DataFrame, model, features: Sequence[str], vector: str = VECTOR, keys: Sequence[str] = ("participant_id",)
) -> DataFrame:  # type: ignore[no-untyped-def]
    """Keys, one attribution per feature, and ``base``; ``vector`` is the model's feature column."""
    return _named(frame, leaf_paths(model, frame.sparkSession), features, vector, keys)


def boosted_attribution(model: BoostedRisk, frame: DataFrame, keys: Sequence[str] = ("participant_id",)) -> DataFrame:
    """Attributions to the log-odds before calibration, the mean over the fold models.

    A column's indicator of missing values counts with the column.
    """
    if not model.models:
        raise RuntimeError("BoostedRisk must be fitted before its attributions")
    paths = [p for fitted in model.models for p in leaf_paths(fitted, frame.sparkSession)]
    for p in paths:
        p.value = p.value / len(model.models)
    names = [f"__a{i}" for i in range(2 * len(model.columns))]
    parts = _named(model._prepare(frame), paths, names, VECTOR, keys)
    own = [(F.col(names[i]) + F.col(names[len(model.columns) + i])).alias(c) for i, c in enumerate(model.columns)]
    return parts.select(*keys, *own, "base")


def _named(frame: DataFrame, paths: Sequence[LeafPaths], features: Sequence[str], vector: str, keys: Sequence[str]) -> DataFrame:
    scored = frame.select(*keys, shapley_values(vector_to_array(F.col(vector)), paths).alias("__values"))
    base = F.lit(float(sum(p.base for p in paths))).alias("base")
    return scored.select(*keys, *[F.col("__values")[i].alias(f) for i, f in enumerate(features)], base)
