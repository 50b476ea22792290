"""Statistics and models against brute force on small data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan.operators import (
    attribution,
    audit,
    calibration,
    comparison,
    discrimination,
    fusion,
    neighbors,
    risk,
    scaling,
    survival,
    survival_metrics,
    trajectory,
    uncertainty,
)


def rows_of(spark, schema, *columns):
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in zip(*columns)], schema)


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(3)
    n = 120
    f1, f2 = rng.normal(size=n), rng.normal(size=n)
    event = (rng.random(n) < 1 / (1 + np.exp(-1.5 * f1))).astype(int)
    time = rng.integers(30, 2200, n)
    frame = rows_of(
        spark, "participant_id string, f1 double, f2 double, event int, event_time_days int",
        [f"p{i}" for i in range(n)], f1, f2, event, time,
    )
    return frame.withColumn("f2", F.when(F.xxhash64("participant_id") % 10 != 0, F.col("f2"))).cache()


def test_standardizer_and_imputer(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    test = spark.createDataFrame([(100.0,)], "x double")
    assert scaling.Standardizer(["x"]).fit(train).transform(test).first().x == pytest.approx(120.025, abs=1e-3)
    with pytest.raises(RuntimeError):
        scaling.Standardizer(["x"]).transform(test)
    gaps = spark.createDataFrame([(4.0,), (5.0,), (None,), (float("nan"),)], "x double")
    assert [r.x for r in scaling.MedianImputer(["x"]).fit(gaps).transform(gaps).collect()] == [4.0, 5.0, 4.5, 4.5]


def test_batch_corrector_aligns_batches(spark):
    rng = np.random.default_rng(0)
    shift = np.array([0.0] * 50 + [5.0] * 50)
    frame = rows_of(spark, "cohort string, f1 double", ["a"] * 50 + ["b"] * 50, rng.normal(size=100) + shift)
    fixed = scaling.BatchCorrector("cohort", ["f1"], ()).fit_transform(frame)
    means = [r[0] for r in fixed.groupBy("cohort").agg(F.avg("f1")).select(F.col("avg(f1)")).collect()]
    assert abs(means[0] - means[1]) < 1e-9
    unseen = spark.createDataFrame([("z", 1.0)], "cohort string, f1 double")
    assert scaling.BatchCorrector("cohort", ["f1"], ()).fit(frame).transform(unseen).count() == 1


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(neg < p).mean() + 0.5 * (neg == p).mean() for p in pos])


def test_binary_metrics_with_ties(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 1)
    frame = rows_of(spark, "y int, s double, g string", y, s, ["u" if i % 3 else "v" for i in range(300)])
    one = discrimination.binary_metrics(frame, "y", "s", ranges=4).first()
    assert one.auroc == pytest.approx(brute_auc(y, s)) and one.brier == pytest.approx(np.mean((y - s) ** 2))
    order = sorted(set(s), reverse=True)
    ap, seen = 0.0, 0
    for v in order:
        tp, n = ((s >= v) & (y == 1)).sum(), (s >= v).sum()
        ap += (tp - seen) / y.sum() * tp / n
        seen = tp
    assert one.auprc == pytest.approx(ap)
    few = discrimination.binary_metrics(frame.limit(3), "y", "s").first()
    assert few.auroc is None


def test_delong_and_bootstrap(spark):
    frame = rows_of(spark, "y int, a double, b double", [0, 0, 1, 1, 1, 0], [0.1, 0.4, 0.35, 0.8, 0.7, 0.2], [0.1, 0.4, 0.35, 0.8, 0.7, 0.2])
    assert comparison.delong_test(frame, "y", "a", "b") == 1.0
    with pytest.raises(ValueError):
        comparison.delong_test(frame.where("y = 1"), "y", "a", "b")
    rng = np.random.default_rng(2)
    y = np.array([0, 0, 0, 1, 1, 1] * 20)
    noise = rng.random(120)
    both = rows_of(spark, "id long, y int, a double, b double", range(120), y, y.astype(float), noise)
    got = comparison.bootstrap_comparison(both, "y", "a", "b", n_bootstrap=60, key=F.col("id")).first()
    assert got.delta > 0 and got.p_value < 0.05 and got.ci_lower > 0
    same = comparison.bootstrap_comparison(both.withColumn("c", F.col("b")), "y", "b", "c", n_bootstrap=20, key=F.col("id")).first()
    assert abs(same.delta) < 1e-9 and same.p_value == 1.0
    p = comparison.delong_components(both, "y", "a", "b").first()
    assert p.auc_a == 1.0 and p.auc_b == pytest.approx(brute_auc(y, noise))
    ci = comparison.bootstrap_interval(both, "y", "b", n_bootstrap=60, key=F.col("id")).first()
    assert ci.lower <= ci.point <= ci.upper


def test_reports(spark):
    R = comparison.ModelReport
    rows = comparison.report_rows(
        spark, [R("ModelA", {"auroc": 0.8, "f1": 0.7}, "external"), R("ModelB", {"auroc": 0.85, "f1": 0.75}, "external"), R("ModelC", {"auroc": 0.9}, "internal")]
    )
    assert comparison.compare_models(rows, ["auroc", "f1"]).columns == ["model_name", "cohort", "auroc", "f1"]
    assert comparison.select_best_model(rows, "auroc", "external") == "ModelB"
    assert comparison.select_best_model(rows, "auroc", "internal") == "ModelC"
    assert comparison.select_best_model(rows, "f1_score", "external") is None
    assert comparison.select_best_model(rows, "auroc", "unknown") is None


def test_concordance(spark):
    frame = spark.createDataFrame([(100, 1, 3.0), (200, 1, 2.0), (300, 1, 1.0)], "event_time_days int, event int, risk double")
    assert survival_metrics.concordance_index(frame).first().c_index == 1.0
    rng = np.random.default_rng(5)
    t, e, r = rng.integers(1, 40, 150), rng.integers(0, 2, 150), rng.integers(0, 9, 150) / 10
    c = p = 0.0
    for i in range(150):
        if e[i]:
            later = t > t[i]
            p += later.sum()
            c += (r[i] > r[later]).sum() + 0.5 * (r[i] == r[later]).sum()
    got = survival_metrics.concordance_index(rows_of(spark, "event_time_days int, event int, risk double", t, e, r), ranges=3).first()
    assert (got.concordant, got.permissible) == (c, p)
    alone = spark.createDataFrame([(5, 0, 1.0)], "event_time_days int, event int, risk double")
    assert survival_metrics.concordance_index(alone).first().c_index == 0.5


def test_kaplan_meier(spark):
    frame = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 1), (None, 1)], "event_time_days int, event int")
    got = {r.time: (r.at_risk, r.events, r.censored, round(r.survival, 6)) for r in survival.kaplan_meier(frame, ranges=2).collect()}
    assert got == {1: (4, 1, 0, 0.75), 2: (3, 1, 1, 0.5), 3: (1, 1, 0, 0.0)}


def test_integrated_brier_bounds(spark):
    people_rows = [(i, t, 1) for i, t in enumerate((100, 200, 300))]
    surv = {0: (0.1, 0.1), 1: (0.8, 0.2), 2: (0.9, 0.7)}
    curve = spark.createDataFrame(
        [(i, float(et), surv[i][j], t, e) for i, t, e in people_rows for j, et in enumerate((150, 250))],
        "participant_id int, eval_time double, survival double, event_time_days int, event int",
    )
    value = survival_metrics.integrated_brier(curve, [150, 250]).first()[0]
    assert 0 <= value <= 1


def test_fusion(spark):
    frame = spark.createDataFrame([(0.2, 0.8), (0.4, None), (None, None)], "clinical double, mri double")
    got = [r.fused_score for r in fusion.fuse_scores(frame, {"clinical": 0.75, "mri": 0.25}).collect()]
    assert got[0] == pytest.approx(0.35) and got[1] == pytest.approx(0.4) and got[2] is None
    with pytest.raises(ValueError):
        fusion.fuse_scores(frame, {"other": 1.0})
    with pytest.raises(ValueError):
        fusion.fuse_scores(frame, {"mri": -1.0})


def test_neighbours_small_and_brute(spark):
    frame = spark.createDataFrame([("p1", 60.0, 20.0), ("p2", 61.0, 19.5), ("p3", 80.0, 5.0)], "participant_id string, a double, b double")
    space = neighbors.NeighborSpace(["a", "b"]).fit(frame)
    got = space.query(frame.where("participant_id = 'p1'"), k=1).collect()
    assert got[0].participant_id == "p2"
    rng = np.random.default_rng(9)
    # Two thirds of the rows sit in one tight clump.
    x = np.vstack([rng.normal(size=(200, 3)) * 0.01, rng.normal(size=(100, 3)) * 5])
    vectors = rows_of(spark, "id string, vector array<double>, stratum string", [f"v{i:03d}" for i in range(300)], x.tolist(), [str(i % 4) for i in range(300)])
    ref = vectors.withColumnRenamed("id", "rid")
    q = vectors.select(F.col("id").alias("qid"), "vector", F.col("id").alias("exclude"))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = neighbors.knn_join(q, ref, 4, pivots=16, block_rows=32).groupBy("qid").agg(F.sort_array(F.collect_list("distance")).alias("d")).collect()
    assert len(got) == 300
    for r in got:
        assert r.d == pytest.approx(np.sort(d[int(r.qid[1:])])[:4].tolist())
    bal = neighbors.knn_join(q, ref, 4, per_stratum=2, pivots=16, block_rows=32).groupBy("qid").agg(F.sort_array(F.collect_list("distance")).alias("d")).collect()
    for r in bal:
        i = int(r.qid[1:])
        best = sorted(v for s in range(4) for v in np.sort(d[i][np.arange(300) % 4 == s])[:2])[:4]
        assert r.d == pytest.approx(best)


def test_conformal(spark):
    res = spark.createDataFrame([(-1.0,), (0.5,), (2.0,), (-3.0,), (1.5,)], "residual double")
    assert trajectory.conformal_width(res).first().width == 3.0
    values = spark.createDataFrame([(float(i),) for i in range(1, 21)], "residual double")
    got = trajectory.conformal_width(values, kind="higher", absolute=False).first().width
    q = min(math.ceil(21 * 0.9) / 20, 1.0)
    assert got == np.quantile(np.arange(1, 21), q, method="higher")


def test_interpolation(spark):
    series = spark.createDataFrame([("a", 0.0, 10.0), ("a", 2.0, 20.0), ("a", 3.0, 0.0)], "participant_id string, year double, cognitive_score double")
    got = {r.year: r.cognitive_score for r in trajectory.interpolate(series, [-1.0, 0.5, 2.0, 2.5, 9.0]).collect()}
    want = np.interp([-1.0, 0.5, 2.0, 2.5, 9.0], [0, 2, 3], [10, 20, 0])
    assert [got[y] for y in (-1.0, 0.5, 2.0, 2.5, 9.0)] == pytest.approx(want.tolist())


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 2)), rng.normal(size=60)
    frame = rows_of(spark, "f1 double, f2 double, future_score double", x[:, 0], x[:, 1], y)
    model = trajectory.RidgeTrajectory(["f1", "f2"]).fit(frame)
    z = (x - x.mean(0)) / x.std(0)
    design = np.column_stack([np.ones(60), z])
    beta = np.linalg.solve(design.T @ design + np.diag([0.0, 1.0, 1.0]), design.T @ y)
    got = [r.predicted_future_score for r in model.predict(frame).collect()]
    assert got == pytest.approx((design @ beta).tolist())


def test_calibration(spark):
    rng = np.random.default_rng(6)
    p = rng.random(200)
    y = (rng.random(200) < p).astype(int)
    frame = rows_of(spark, "y int, p double", y, p)
    rel = calibration.reliability(frame, "y", "p", 10).collect()
    assert len(rel) == 10 and sum(r["count"] for r in rel) == 200 and 0 <= rel[0].ece <= rel[0].mce
    bins = calibration.quantile_bins(frame, "y", "p", 10).collect()
    assert sorted(r.n for r in bins) == [20] * 10
    slope = calibration.calibration_slope(frame, "y", "p").first().slope
    assert 0.5 < slope < 2.0


def test_logistic_matches_newton(spark, people):
    model = risk.LogisticRisk(["f1", "f2"]).fit(people)
    rows = people.toPandas()
    x = rows[["f1", "f2"]].fillna(rows[["f1", "f2"]].median()).to_numpy()
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    y = rows["event"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = z.T @ (w * (p - y)) + np.array([0, beta[1], beta[2]])
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag([0.0, 1.0, 1.0])
        beta -= np.linalg.solve(hess, grad)
    got = {r.participant_id: r.risk for r in model.predict_risk(people).collect()}
    want = dict(zip(rows["participant_id"], 1 / (1 + np.exp(-z @ beta))))
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_hazards_are_monotone(people):
    model = survival.HazardEnsemble(["f1", "f2"], "logistic", n_bootstrap=2).fit(people)
    rows = model.predict_distribution(people)
    bad = rows.groupBy("participant_id", "replicate").pivot("horizon", [1, 3, 5]).agg(F.first("risk")).where("`1` > `3` or `3` > `5` or `5` > 1")
    assert bad.count() == 0 and rows.count() == 120 * 2 * 3
    curve = model.survival_function(people, [100.0, 400.0, 3000.0]).where("survival < 0 or survival > 1")
    assert curve.count() == 0
    with pytest.raises(ValueError):
        survival.check_survival_input(people, ["absent"])


def test_boosted_and_importance(spark, people):
    model = risk.BoostedRisk(["f1", "f2"], n_estimators=3, max_depth=2, calibrate=True, folds=2).fit(people)
    scored = model.predict_risk(people)
    assert scored.where("risk < 0 or risk > 1 or risk is null").count() == 0
    assert set(r.feature for r in model.feature_importance(spark).collect()) == {"f1", "f2", "f1__missing", "f2__missing"}
    centroid = risk.CentroidRisk(["f1"]).fit(people)
    imp = survival.permutation_importance(people, ["f1"], centroid.predict_risk, n_repeats=2).collect()
    assert [r.feature for r in imp] == ["f1"]


def test_stacking_and_attribution(spark, people):
    folds = fusion.out_of_fold_scores(people, lambda rows: risk.CentroidRisk(["f1"]).fit(rows), n_folds=3, out="a")
    assert folds.count() == people.count()
    meta = fusion.StackedFusion(["a"]).fit(folds, "event")
    assert meta.predict(folds).where("fused_score between 0 and 1").count() == people.count()
    assert meta.learned_weights(spark).count() == 1
    model = risk.CentroidRisk(["f1", "f2"]).fit(people)
    att = attribution.linear_attribution(model.standardized(people), model.direction)
    top = attribution.top_drivers(att, ["f1", "f2"], k=3).first()
    assert abs(top.value_1) >= abs(top.value_2) and top.feature_3 is None
    assert uncertainty.ood_score(people.na.drop(), people.na.drop(), ["f1", "f2"]).where("ood_score < 0").count() == 0


def test_what_if_and_profiles(spark):
    frame = audit.profiles_frame(spark, [{"participant_id": "x", "sex": "Male", "urban_rural": "rural", "age": 71, "cognitive_score": 24.8}])
    row = frame.first()
    assert (row.sex_binary, row.rural_indicator, row.hba1c_percent) == (1, 1, None)
    varied = audit.what_if(frame, {"same": {}, "urban": {"urban_rural": "urban", "age": 60.0}})
    got = {r.scenario: (r.age, r.rural_indicator) for r in varied.collect()}
    assert got == {"same": (71.0, 1), "urban": (60.0, 0)}
    warned = audit.participant_warnings(frame, {"age": (50.0, 70.0)}).first()
    assert warned.available_modalities == ["Cognition + clinical"] and len(warned.warnings) == 4


def test_export(spark, people, tmp_path):
    from longspan.sources import sinks

    model = risk.LogisticRisk(["f1"], max_iter=5).fit(people)
    sinks.export_models(spark, {"logistic": model.model}, str(tmp_path))
    meta = spark.read.json(f"{tmp_path}/config").first()
    assert meta.horizons == [1, 3, 5] and len(meta.modalities) == 5
    lines = sinks.report_lines("T", spark.createDataFrame([(0, "a", 0.5)], "position int, name string, value double"))
    sinks.write_report(lines, f"{tmp_path}/report")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()] == ["# T", "", "## Metrics", "- a: 0.5000"]
