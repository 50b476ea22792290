"""Partial likelihood, boosted hazards, the mixed model and several-regressor ridge against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan.operators.cox import CoxBoost, CoxRegression, baseline_hazard, partial_log_likelihood, survival_on_grid
from longspan.operators.mixed import MixedModel
from longspan.operators.trajectory import ParticipantRidge, ParticipantRidgeMany


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(12)
    n = 160
    x = rng.normal(size=(n, 2))
    t = np.ceil(rng.exponential(500 * np.exp(-0.7 * x[:, 0]))).clip(1, 900)
    t[:30] = 100  # ties
    e = (rng.random(n) < 0.7).astype(int)
    rows = [(f"p{i}", int(t[i]), int(e[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    rows += [("no time", None, 1, 0.0, 0.0), ("no event", 5, None, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "participant_id string, event_time_days int, event int, a double, b double").cache()
    return frame, x, t, e


def plain_log_likelihood(f, t, e):
    return sum(f[i] - math.log(np.exp(f[t >= t[i]]).sum()) for i in np.flatnonzero(e))


def plain_cox(x, t, e, penalty, steps=40):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        r = np.exp(x @ beta)
        g, h = -penalty * beta, penalty * np.eye(len(beta))
        for i in np.flatnonzero(e):
            at = t >= t[i]
            w = r[at] / r[at].sum()
            mean = w @ x[at]
            g += x[i] - mean
            h += (x[at] * w[:, None]).T @ x[at] - np.outer(mean, mean)
        beta += np.linalg.solve(h, g)
    return beta


@pytest.mark.parametrize("penalty", [0.0, 3.0])
def test_cox_equals_newton_on_pairs(cohort, penalty):
    frame, x, t, e = cohort
    model = CoxRegression(["a", "b"], penalty=penalty, standardise=False).fit(frame)
    beta = plain_cox(x, t, e, penalty)
    assert [model.coefficients[c] for c in "ab"] == pytest.approx(beta.tolist(), abs=1e-7)
    assert model.log_likelihood == pytest.approx(plain_log_likelihood(x @ beta, t, e) - penalty / 2 * beta @ beta)


def test_breslow_curve(cohort):
    frame, x, t, e = cohort
    model = CoxRegression(["a", "b"], standardise=False).fit(frame)
    beta = np.array([model.coefficients[c] for c in "ab"])
    r = np.exp(x @ beta)
    jumps = {}
    for i in np.flatnonzero(e):
        jumps[t[i]] = jumps.get(t[i], 0.0) + 1 / r[t >= t[i]].sum()
    grid = [0.5, 100.0, 333.3, 5000.0]
    got = {(q.participant_id, q.time): q.survival for q in model.survival_function(frame.where("event_time_days is not null and event is not null"), grid).collect()}
    for i in range(len(t)):
        for g in grid:
            assert got[f"p{i}", g] == pytest.approx(math.exp(-sum(v for k, v in jumps.items() if k <= g) * r[i]))


def test_baseline_without_events(spark):
    rows = spark.createDataFrame([(5.0, 0.0, 0.1), (7.0, 0.0, 0.2)], "__t double, __e double, log_risk double").withColumn("k", F.lit("k"))
    base = baseline_hazard(rows)
    assert [r.cumulative_hazard for r in base.collect()] == [0.0, 0.0]
    assert {r.survival for r in survival_on_grid(rows, base, [6.0], ["k"]).collect()} == {1.0}


def test_standardised_and_missing_features(spark, cohort):
    frame, _, _, _ = cohort
    gaps = frame.withColumn("a", F.when(F.xxhash64("participant_id") % 5 != 0, F.col("a") * 100))
    model = CoxRegression(["a", "b"]).fit(gaps)
    assert model.coefficients["a"] > 0.3
    assert model.risk_scores(gaps).where("risk is null or isnan(risk)").count() == 0


def test_boosting_raises_the_likelihood(cohort):
    frame, x, t, e = cohort
    short = CoxBoost(["a", "b"], n_estimators=2, max_depth=2).fit(frame)
    long = CoxBoost(["a", "b"], n_estimators=8, max_depth=2, subsample=0.9).fit(frame)
    ranked = [0.0] * 2
    for i, model in enumerate((short, long)):
        ranked[i] = partial_log_likelihood(model.predict(frame)).first().log_likelihood
    assert plain_log_likelihood(np.zeros(len(t)), t, e) < ranked[0] < ranked[1]
    # The first tree's leaves are means of the martingale residuals at score 0.
    first = CoxBoost(["a"], n_estimators=1, learning_rate=1.0, max_depth=1).fit(frame)
    steps = {k: (e[t == k].sum()) / (t >= k).sum() for k in set(t.tolist())}
    residual = e - np.array([sum(v for k, v in steps.items() if k <= u) for u in t])
    scores = {r.participant_id: r.risk for r in first.risk_scores(frame).collect()}
    mine = np.array([scores[f"p{i}"] for i in range(len(t))])
    for value in set(mine.tolist()):
        assert value == pytest.approx(residual[mine == value].mean())


# ---- mixed model


def plain_em(groups, beta, spread, variance, steps):
    """groups: list of (X, Z, y)."""
    n = sum(len(y) for _, _, y in groups)
    seen = []
    for _ in range(steps):
        value, second, xx, xr, noise, kept = 0.0, np.zeros((2, 2)), 0, 0, 0.0, []
        for x, z, y in groups:
            cov = z @ spread @ z.T + variance * np.eye(len(y))
            r = y - x @ beta
            value += -0.5 * (len(y) * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + r @ np.linalg.solve(cov, r))
            v = np.linalg.inv(z.T @ z / variance + np.linalg.inv(spread))
            b = v @ z.T @ r / variance
            second += np.outer(b, b) + v
            xx, xr = xx + x.T @ x, xr + x.T @ (y - z @ b)
            kept.append((x, z, y, b, v))
        seen.append(value)
        last = (beta, spread, variance)
        beta = np.linalg.solve(xx, xr)
        noise = sum(((y - x @ beta - z @ b) ** 2).sum() + np.trace(z @ v @ z.T) for x, z, y, b, v in kept)
        spread, variance = second / len(groups) + 1e-12 * np.eye(2), noise / n
    return seen, last


def test_mixed_model_equals_plain_em(spark):
    rng = np.random.default_rng(21)
    groups, rows = [], []
    for g in range(25):
        m = int(rng.integers(1, 7))
        t, f = np.sort(rng.random(m) * 5), rng.normal(size=m)
        b = rng.multivariate_normal([0, 0], [[4.0, -0.6], [-0.6, 0.5]])
        y = 20 - 1.5 * t + 0.8 * f + b[0] + b[1] * t + rng.normal(size=m) * 0.7
        groups.append((np.column_stack([np.ones(m), t, f]), np.column_stack([np.ones(m), t]), y))
        rows += [(f"g{g}", float(a), float(c), float(d)) for a, c, d in zip(t, f, y)]
    frame = spark.createDataFrame(rows + [("g0", 1.0, 1.0, None), (None, 1.0, 1.0, 5.0)], "participant_id string, horizon_years double, f double, future_score double")
    model = MixedModel(["horizon_years", "f"], max_iterations=12).fit(frame)
    x, y = np.vstack([g[0] for g in groups]), np.concatenate([g[2] for g in groups])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    variance = ((y - x @ beta) ** 2).mean()
    seen, (b, d, s) = plain_em(groups, beta, np.diag([variance / 2, variance / 2 / (x[:, 1] ** 2).mean()]), variance, 12)
    assert model.log_likelihoods == pytest.approx(seen)
    assert all(v >= u - 1e-9 for u, v in zip(model.log_likelihoods, model.log_likelihoods[1:]))
    assert model.coefficients == pytest.approx(b.tolist()) and model.variance == pytest.approx(s) and model.spread.ravel().tolist() == pytest.approx(d.ravel().tolist())
    effects = {r.participant_id: (r.intercept_effect, r.slope_effect) for r in model.person_effects(frame.select("participant_id").distinct()).collect()}
    for i, (x_, z, y_) in enumerate(groups):
        v = np.linalg.inv(z.T @ z / s + np.linalg.inv(d))
        assert effects[f"g{i}"] == pytest.approx(tuple(v @ z.T @ (y_ - x_ @ b) / s))
    assert effects[None] == (0.0, 0.0)
    asked = spark.createDataFrame([("g1", 2.0, 0.5), ("new", 2.0, 0.5)], "participant_id string, horizon_years double, f double")
    got = {r.participant_id: r.predicted_future_score for r in model.predict(asked).collect()}
    fixed = b @ [1.0, 2.0, 0.5]
    assert got["new"] == pytest.approx(fixed) and got["g1"] == pytest.approx(fixed + effects["g1"][0] + 2.0 * effects["g1"][1])


def test_ridge_on_several_regressors(spark):
    rng = np.random.default_rng(5)
    rows = [(f"p{i % 6}", *map(float, rng.normal(size=3)), float(rng.normal())) for i in range(50)] + [("single", 1.0, None, 2.0, 3.0)]
    frame = spark.createDataFrame(rows, "participant_id string, a double, b double, c double, future_score double")
    model = ParticipantRidgeMany(["a", "b", "c"], alpha=0.7)
    found = {r.participant_id: (r.coefficients, r.intercept) for r in model.fit(frame).collect()}

    def plain(part):
        x = np.array([[v or 0.0 for v in r[1:4]] for r in part])
        y = np.array([r[4] for r in part])
        z = x - x.mean(0)
        w = np.linalg.solve(z.T @ z + 0.7 * np.eye(3), z.T @ (y - y.mean()))
        return w.tolist(), y.mean() - x.mean(0) @ w

    for g in {r[0] for r in rows}:
        w, b = plain([r for r in rows if r[0] == g])
        assert found[g][0] == pytest.approx(w, abs=1e-12) and found[g][1] == pytest.approx(b)
    asked = spark.createDataFrame([("p1", 1.0, 2.0, 3.0), ("new", 1.0, None, 3.0)], "participant_id string, a double, b double, c double")
    got = {r.participant_id: r.predicted_future_score for r in model.predict(asked, model.fit(frame), model.fit_pooled(frame)).collect()}
    w, b = plain(rows)
    assert got["new"] == pytest.approx(b + w[0] + 3 * w[2])
    one = ParticipantRidge("a").fit(frame).orderBy("participant_id").collect()
    many = ParticipantRidgeMany(["a"]).fit(frame).orderBy("participant_id").collect()
    assert [r.slope for r in one] == pytest.approx([r.coefficients[0] for r in many])
