"""Tree attributions against all feature subsets of small models."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from longspan.operators import risk
from longspan.operators.tree_attribution import boosted_attribution, leaf_paths, node_table, tree_attribution

NAMES = ("a", "b", "c", "d")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=300) * 0.3 > 0).astype(float)
    rows = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "participant_id long, a double, b double, c double, d double, y double")
    return risk.assemble(rows, NAMES).cache()


def expected(nodes, at, x, known, value):
    """Mean of a tree's leaves where only the ``known`` features are followed."""
    node = nodes[at]
    if node.leftChild < 0:
        return value(node)
    left, right, feature = node.leftChild, node.rightChild, node.split.featureIndex
    if feature in known:
        return expected(nodes, left if x[feature] <= node.split.leftCategoriesOrThreshold[0] else right, x, known, value)
    share = nodes[left].rawCount / (nodes[left].rawCount + nodes[right].rawCount)
    return share * expected(nodes, left, x, known, value) + (1 - share) * expected(nodes, right, x, known, value)


def by_subsets(model, spark, x, scales, value):
    trees = {}
    for node in node_table(model, spark).collect():
        trees.setdefault(node.tree, {})[node.id] = node

    def game(known):
        return sum(scales[t] * expected(nodes, 0, x, known, value) for t, nodes in trees.items())

    n, out = len(x), []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        out.append(sum(
            factorial(s) * factorial(n - 1 - s) / factorial(n) * (game({*chosen, i}) - game(set(chosen)))
            for s in range(n) for chosen in combinations(rest, s)
        ))
    return out, game(set())


def learners():
    own = {"featuresCol": risk.VECTOR, "labelCol": "y", "seed": 3}
    forest = {"numTrees": 4, "maxDepth": 5, **own}
    share = lambda node: node.impurityStats[1] / sum(node.impurityStats)
    plain = lambda node: node.prediction
    return [
        (RandomForestRegressor(**forest), [0.25] * 4, plain, F.col("prediction")),
        (RandomForestClassifier(**forest), [0.25] * 4, share, risk.positive_probability()),
        (DecisionTreeRegressor(maxDepth=6, **own), [1.0], plain, F.col("prediction")),
        (GBTClassifier(maxIter=3, maxDepth=4, stepSize=0.1, **own), [2.0, 0.2, 0.2], plain, None),
    ]


@pytest.mark.parametrize("case", range(4))
def test_equals_all_subsets_and_adds_up(spark, points, case):
    learner, scales, value, output = learners()[case]
    model = learner.fit(points)
    if output is None:
        p = risk.positive_probability()
        output = F.log(p / (1 - p))
    out = tree_attribution(points, model, NAMES).join(
        model.transform(points).select("participant_id", *[F.col(c).alias(f"x_{c}") for c in NAMES], output.alias("out")), "participant_id"
    ).collect()
    assert len(out) == 300
    for r in out:
        assert sum(r[c] for c in NAMES) + r.base == pytest.approx(r.out, abs=1e-9)
    for r in out[:5]:
        values, base = by_subsets(model, spark, [r[f"x_{c}"] for c in NAMES], scales, value)
        assert [r[c] for c in NAMES] == pytest.approx(values, abs=1e-10)
        assert r.base == pytest.approx(base, abs=1e-10)


def test_one_leaf_unused_features_nan_and_empty(spark, points):
    flat = DecisionTreeRegressor(featuresCol=risk.VECTOR, labelCol="one").fit(points.withColumn("one", F.lit(1.0)))
    row = tree_attribution(points, flat, NAMES).first()
    assert [row[c] for c in NAMES] == [0.0] * 4 and row.base == 1.0
    model = DecisionTreeRegressor(featuresCol=risk.VECTOR, labelCol="y", maxDepth=3).fit(points)
    assert tree_attribution(points.limit(0), model, NAMES).count() == 0
    path = leaf_paths(model, spark)[0]
    # NaN and a value above every threshold take the same way.
    assert np.allclose(path.attributions(np.full((1, 4), np.nan)), path.attributions(np.full((1, 4), 1e9)))


def test_boosted_risk_with_missing_values_and_folds(spark, points):
    rows = points.drop(risk.VECTOR).withColumn("a", F.when(F.col("participant_id") % 5 > 0, F.col("a")))
    model = risk.BoostedRisk(("a", "b"), n_estimators=3, learning_rate=0.1, max_depth=2).fit(rows, "y")
    out = boosted_attribution(model, rows).join(model.predict_risk(rows).select("participant_id", "risk"), "participant_id").collect()
    assert len(out) == 300
    for r in out:
        assert 1 / (1 + np.exp(-(r.a + r.b + r.base))) == pytest.approx(r.risk, abs=1e-9)
    folded = risk.BoostedRisk(("a", "b"), n_estimators=2, max_depth=2, calibrate=True, folds=2).fit(rows, "y")
    assert boosted_attribution(folded, rows).columns == ["participant_id", "a", "b", "base"]
    with pytest.raises(RuntimeError):
        boosted_attribution(risk.BoostedRisk(("a",)), rows)
