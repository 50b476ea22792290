"""Newton fits, exact isotonic calibration, array bootstrap and the normal tail against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan.functions.columns import erfc
from longspan.operators import comparison, isotonic, newton, resampling, risk, survival
from longspan.operators.discrimination import binary_metrics
from longspan.operators.isotonic import IsotonicMap, isotonic_blocks


def plain_newton(x, y, w, penalty, steps=60):
    z = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([0.0, *[penalty] * x.shape[1]])
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ beta)
    return beta


def test_newton_fits_all_replicates_at_once(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    w = rng.poisson(1.0, size=(300, 4)).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b), c.tolist()) for a, b, c in zip(x, y, w)], "x array<double>, y double, w array<double>").cache()
    passes = []
    whole = newton.partial_sums
    try:
        newton.partial_sums = lambda *a: passes.append(1) or whole(*a)
        models = newton.fit_logistic(rows, 3, 4, penalty=1.0)
    finally:
        newton.partial_sums = whole
    assert len(passes) <= 12  # one job a step, whatever the number of replicates
    for b, model in enumerate(models):
        assert [model.intercept, *model.coefficients] == pytest.approx(plain_newton(x, y, w[:, b], 1.0).tolist(), abs=1e-9)
    empty = newton.fit_logistic(rows.limit(0), 3, 2, penalty=1.0)
    assert all(m.coefficients == [0.0] * 3 for m in empty)


def test_newton_stops_on_separable_classes(spark):
    rows = spark.createDataFrame([([float(i)], float(i > 5), [1.0]) for i in range(11)], "x array<double>, y double, w array<double>").cache()
    model = newton.fit_logistic(rows, 1, max_iterations=15)[0]
    assert model.coefficients[0] > 1 and math.isfinite(model.intercept)


def test_hazard_replicates_share_their_jobs(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"p{i}", float(rng.normal()), int(rng.random() < 0.5), int(rng.integers(30, 2000))) for i in range(120)]
    frame = spark.createDataFrame(rows, "participant_key long, participant_id string, f double, event int, event_time_days int")
    model = survival.HazardEnsemble(["f"], n_bootstrap=5, draw_key="participant_key").fit(frame)
    assert len(model.models) == 5 and len({m.intercept for m in model.models}) == 5
    assert model.predict_distribution(frame).where("risk is null or risk < 0 or risk > 1").count() == 0


# ---- isotonic


def plain_pav(x, y, w):
    blocks = []
    for v in sorted(set(x.tolist())):
        at = x == v
        blocks.append([v, v, float((y[at] * w[at]).sum()), float(w[at].sum())])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            _, hi, s, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + s, blocks[-1][3] + n]
    return blocks


def scored_rows(kind, n=700):
    rng = np.random.default_rng(11)
    x = np.round(rng.random(n), 3)
    if kind == "rising":
        y = (rng.random(n) < x).astype(int)
    elif kind == "falling":
        y = (rng.random(n) > x).astype(int)
    elif kind == "one score":
        x, y = np.full(n, 0.25), (rng.random(n) < 0.3).astype(int)
    else:  # rare events on scores closer than 1e-4
        x = 1e-5 * rng.random(n)
        y = (rng.random(n) < 0.02 + 4e3 * x).astype(int)
    return x, y


@pytest.mark.parametrize("kind", ["rising", "falling", "one score", "rare"])
@pytest.mark.parametrize("range_points", [10**6, 37])
def test_isotonic_equals_plain_pooling(spark, kind, range_points):
    x, y = scored_rows(kind)
    w = np.arange(len(x)) % 3 + 1.0
    frame = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(x, y, w)] + [(None, 1, 1.0), (0.5, None, 1.0), (float("nan"), 1, 1.0)], "s double, y int, w double")
    want = plain_pav(x, y.astype(float), w)
    got = sorted((r.lo, r.hi, r.total, r.weight) for r in isotonic_blocks(frame, "y", "s", F.col("w"), range_points).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(tuple(b))


@pytest.mark.parametrize("broadcast_knots", [500_000, 0])
def test_calibration_map(spark, monkeypatch, broadcast_knots):
    monkeypatch.setattr(isotonic, "RANGE_POINTS", 5)
    x, y = scored_rows("rising")
    frame = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "s double, y int")
    model = IsotonicMap(broadcast_knots=broadcast_knots).fit(frame, "y", "s", range_points=50)
    blocks = plain_pav(x, y.astype(float), np.ones(len(x)))
    knots = sorted({(v, b[2] / b[3]) for b in blocks for v in b[:2]})
    asked = [-1.0, 0.0, 0.0005, 0.3333, 0.5, 0.77777, 1.0, 2.0, None, float("nan")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(asked)], "i int, s double")
    got = {r.i: r.c for r in model.transform(rows, "s", "c").collect()}
    want = np.interp(asked[:8], [k[0] for k in knots], [k[1] for k in knots])
    assert [got[i] for i in range(8)] == pytest.approx(want.tolist())
    assert got[8] is None and got[9] is None
    empty = IsotonicMap(broadcast_knots=broadcast_knots).fit(frame.limit(0), "y", "s")
    assert [r.c for r in empty.transform(rows.limit(1), "s", "c").collect()] == [None]


def test_borders_that_violate_are_named_every_other_one(spark):
    rows = [(float(i), float(i), 10.0 - i, 1.0, float(i)) for i in range(5)]
    blocks = spark.createDataFrame(rows, "lo double, hi double, total double, weight double, part double")
    assert isotonic.violated_borders(blocks, [1.0, 2.0, 3.0, 4.0]) == [1.0, 3.0]


# ---- bootstrap


@pytest.mark.parametrize("hot_rows,batch_rows", [(20_000, 1024), (20, 1024), (20_000, 7), (5, 3)])
def test_replicate_arrays_equal_exploded_rows(spark, hot_rows, batch_rows):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.random() < 0.4), 0.5 if i % 3 == 0 else float(np.round(rng.random(), 2)), float(rng.random())) for i in range(250)]
    rows += [(1000, None, 0.1, 0.1), (1001, 1, None, 0.9)]
    frame = spark.createDataFrame(rows, "id long, y int, a double, b double")
    got = resampling.replicate_metrics(frame, "y", ["a", "b"], 9, 42, F.col("id"), hot_rows=hot_rows, batch_rows=batch_rows).collect()
    full = frame.select("*", F.lit(-1).alias("replicate"), F.lit(1).alias("weight"))
    drawn = survival.bootstrap_weights(frame, 9, 42, F.col("id")).select(*full.columns).unionByName(full)
    for name in ("a", "b"):
        plain = {r.replicate: r for r in binary_metrics(drawn, "y", name, ["replicate"], F.col("weight"), min_n=1).collect()}
        mine = {r.replicate: r for r in got if r.model == name}
        assert set(mine) == set(plain) == set(range(-1, 9))
        for b, r in mine.items():
            assert (r.auroc, r.auprc, r.brier) == pytest.approx((plain[b].auroc, plain[b].auprc, plain[b].brier))


def test_replicate_totals_equal_exploded_rows(spark):
    frame = spark.createDataFrame([(i, i % 2) for i in range(300)], "participant_key long, event int")
    got = resampling.replicate_totals(frame, ["event"], 11)
    plain = survival.bootstrap_weights(frame, 11, 42, F.col("participant_key")).groupBy("replicate").agg(
        F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("event")).alias("e")
    )
    for r in plain.collect():
        assert got[r.replicate].tolist() == [r.n, r.w, r.e]


def test_bootstrap_of_one_class_is_null(spark):
    frame = spark.createDataFrame([(i, 1, i / 10) for i in range(10)], "id long, y int, a double")
    row = comparison.bootstrap_interval(frame, "y", "a", n_bootstrap=5, key=F.col("id")).first()
    assert row.point is None and row.lower is None


# ---- the normal tail


def test_erfc_far_into_the_tail(spark):
    values = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.7, 1.999999, 2.0, 2.5, 4.0, 8.3, 15.0, 21.3, 26.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for r in rows.select("x", erfc(F.col("x")).alias("e")).collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-12)
    z = spark.createDataFrame([(30.0,), (-30.0,), (None,)], "z double").select(comparison.two_sided_p(F.col("z")).alias("p")).collect()
    assert z[0].p == z[1].p == pytest.approx(math.erfc(30 / math.sqrt(2)), rel=1e-12) and z[2].p is None


def test_delong_by_group_equals_single_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(rng.random() < 0.5), float(np.round(rng.random(), 1)), float(rng.random())) for g in "ab" for _ in range(40)]
    rows += [("one class", 1, 0.5, 0.5), (None, 1, 0.1, 0.2)]
    frame = spark.createDataFrame(rows, "g string, y int, a double, b double")
    got = {r.g: r for r in comparison.delong_components(frame, "y", "a", "b", ["g"]).collect()}
    assert set(got) == {"a", "b", "one class"} and got["one class"].p_value is None and got["one class"].n == 0
    for g in "ab":
        alone = comparison.delong_components(frame.where(F.col("g") == g), "y", "a", "b").first()
        for c in ("auc_a", "auc_b", "variance", "z", "p_value"):
            assert got[g][c] == pytest.approx(alone[c])


def test_calibrated_boosting_uses_exact_maps(spark):
    rng = np.random.default_rng(2)
    rows = [(f"p{i}", float(rng.normal()), int(rng.random() < 0.3)) for i in range(90)]
    frame = spark.createDataFrame(rows, "participant_id string, f double, event int")
    model = risk.BoostedRisk(["f"], n_estimators=2, max_depth=2, calibrate=True, folds=2).fit(frame)
    assert all(isinstance(c, IsotonicMap) for c in model.calibrators)
    assert model.predict_risk(frame).where("risk is null or risk < 0 or risk > 1").count() == 0
