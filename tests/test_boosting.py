"""Jointly grown boosted trees against plain loops, and the full sizes of the queries that use them."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from driver_queries import study_flow, survival as survival_queries
from longspan.operators import boosting, cox, survival
from longspan.operators.cox import CoxBoost
from longspan.sources import contracts


@pytest.fixture(scope="module")
def people(spark):
    """60 participants with few feature values, many equal times, gaps, a repeated row and one without any feature."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        a, b = float(rng.integers(0, 9)), float(rng.integers(0, 5))
        time = float(rng.choice([200.0, 500.0, 500.0, 900.0, 1300.0, 1900.0]))
        event = int(rng.random() < 0.25 + 0.08 * a)
        rows.append((f"p{i}", None if i % 11 == 3 else a, None if i % 13 == 5 else b, time, event))
    rows += [rows[7], ("bare", None, None, 900.0, 1), (None, 3.0, 2.0, 500.0, 0)]
    return spark.createDataFrame(rows, "participant_id string, a double, b double, event_time_days double, event int").repartition(4).cache()


def test_trees_are_those_of_the_library(people):
    model = survival.HazardEnsemble(["a", "b"], "boosted", 1, n_estimators=3, max_depth=2, resample=False, together=True).fit(people)
    usable = people.where("a is not null or b is not null")
    rows = survival.person_period(usable).selectExpr(
        f"coalesce(a, {model.imputer.medians['__h_a']}) a", f"coalesce(b, {model.imputer.medians['__h_b']}) b", "interval_year y", "double(interval_event) e"
    )
    ready = VectorAssembler(inputCols=["a", "b", "y"], outputCol="v").transform(rows)
    library = GBTClassifier(featuresCol="v", labelCol="e", maxIter=3, maxDepth=2, stepSize=0.08).fit(ready)
    got = ready.select(model.scorer.column([ready.a, ready.b, ready.y], boosting.logistic_probability)[0].alias("mine"), "v")
    both = library.transform(got).select("mine", vector_to_array("probability")[1].alias("theirs")).collect()
    assert [r.mine for r in both] == pytest.approx([r.theirs for r in both], abs=1e-6)
    assert len({round(r.mine, 9) for r in both}) > 4


def test_groups_and_replicates_fitted_together_are_those_fitted_alone(people):
    settings = {"n_bootstrap": 2, "n_estimators": 3, "max_depth": 2, "together": True}
    fresh = lambda: [survival.HazardEnsemble(f, "boosted", seed=s, **settings) for f, s in ((["a"], 42), (["b"], 79))]
    alone = [e.fit(people) for e in fresh()]
    together = survival.fit_together(fresh(), people)
    asked = people.where("participant_id is not null").dropDuplicates(["participant_id"])
    for one, other in zip(alone, together):
        want, got = ({(r.participant_id, r.replicate, r.horizon): r.risk for r in e.predict_distribution(asked).collect()} for e in (one, other))
        assert want.keys() == got.keys() and len(want) == 61 * 2 * 3
        assert [got[k] for k in want] == pytest.approx(list(want.values()), abs=1e-6)


def test_a_group_without_rows_is_refused(people):
    with pytest.raises(ValueError, match="No participants"):
        survival.HazardEnsemble(["a"], "boosted", 1, n_estimators=1, together=True).fit(people.where("a is null"))


def test_few_values_keep_their_midpoints_and_many_get_exact_quantiles(spark):
    rows = spark.range(1001).selectExpr("double(id % 3) few", "double(id) many", "cast(null as double) none")
    few, many, none = boosting.cut_points(rows, ["few", "many", "none"])
    assert few.tolist() == [0.5, 1.5]
    assert many.tolist() == pytest.approx([1000 * i / 32 for i in range(1, 32)])
    assert none.tolist() == []


def plain_residuals(t, e, score):
    r = np.exp(score)
    steps = [(e[t == u].sum() / r[t >= u].sum(), u) for u in sorted(set(t.tolist()))]
    return e - r * np.array([sum(h for h, u in steps if u <= v) for v in t])


@pytest.mark.parametrize("sizes", [[60], [7, 13, 20, 20], [1] * 60])
def test_risk_sets_across_blocks(sizes):
    rng = np.random.default_rng(3)
    t = np.sort(rng.choice([1.0, 2.0, 2.0, 2.0, 3.0, 4.0], 60))
    e, score = (rng.random(60) < 0.5).astype(float), rng.normal(size=60).astype(np.float32)
    blocks, at = [], 0
    for number, n in enumerate(sizes):
        part = t[at : at + n]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        place = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        blocks.append({"id": (number, 0), "t": part, "y": e[at : at + n], "score": score[None, at : at + n], "starts": starts, "place": place})
        at += n

    class State:
        def map(self, kernel):
            found = [kernel(b) for b in reversed(blocks)]
            return type("Found", (), {"collect": lambda _: found})()

    target = cox._residuals(State(), 0)
    got = np.concatenate([target(b)[0] for b in blocks])
    assert got == pytest.approx(plain_residuals(t, e, score.astype(float)))


def test_cox_boosting_on_repeats_and_gaps(people):
    model = CoxBoost(["a", "b"], n_estimators=4, max_depth=2, subsample=0.8).fit(people)
    again = CoxBoost(["a", "b"], n_estimators=4, max_depth=2, subsample=0.8).fit(people.repartition(7))
    asked = people.where("participant_id is not null").dropDuplicates(["participant_id"])
    first, second = ({r.participant_id: r.risk for r in m.risk_scores(asked).collect()} for m in (model, again))
    assert len(first) == 61 and len(set(first.values())) > 3
    assert [second[k] for k in first] == pytest.approx(list(first.values()), abs=1e-6)


def test_blocks_are_made_anew_without_another_result(people, monkeypatch):
    fit = lambda: CoxBoost(["a", "b"], n_estimators=5, max_depth=2).fit(people).scorer
    chained = fit()
    monkeypatch.setattr(boosting, "REBASE_EVERY", 2)
    anew = fit()
    x = np.array([[a, b] for a in range(9) for b in range(5)], dtype=float)
    assert anew.scores(x) == pytest.approx(chained.scores(x), abs=1e-6)


class Asked(Exception):
    pass


def asked(monkeypatch, where, name, call):
    """The settings with which a query fits its model."""
    seen = {}

    def fit(self, *args, **kwargs):
        seen["model"] = self
        raise Asked

    monkeypatch.setattr(where, name, fit)
    with pytest.raises(Asked):
        call()
    return seen["model"]


@pytest.fixture
def no_tables(monkeypatch):
    monkeypatch.setattr(survival_queries, "_split", lambda *_: (None, None))
    monkeypatch.setattr(survival_queries.sv, "check_survival_input", lambda *_: None)


def test_boosted_survival_risk_has_its_full_size(monkeypatch, no_tables):
    model = asked(monkeypatch, survival.HazardEnsemble, "fit", lambda: survival_queries._boosted_survival(None, None))
    assert (model.n_estimators, model.learning_rate, model.max_depth, model.subsample) == (100, 0.1, 3, 1.0)


def test_hazard_boosted_has_its_full_size(monkeypatch, no_tables):
    model = asked(monkeypatch, survival.HazardEnsemble, "fit", lambda: survival_queries._hazard_boosted(None, None))
    assert (model.n_bootstrap, model.n_estimators, model.learning_rate, model.max_depth) == (12, 150, 0.08, 4)


def test_cox_boosted_risk_has_its_full_size(monkeypatch, no_tables):
    model = asked(monkeypatch, CoxBoost, "fit", lambda: survival_queries._cox_boosted(None, None))
    assert (model.n_estimators, model.learning_rate, model.max_depth, model.subsample) == (300, 0.05, 4, 0.8)


def test_the_study_has_its_full_size(monkeypatch):
    for name in ("visits", "baseline", "trajectories", "features", "cut_lineage", "split_draw"):
        monkeypatch.setattr(study_flow, name, lambda *_, **__: None)
    study = asked(monkeypatch, study_flow.Study, "fit", lambda: study_flow._fitted(None, None))
    assert (study.kind, study.n_bootstrap, study.forest_trees, study.params) == ("boosted", 12, 200, {})
    assert study.groups == contracts.MODEL_GROUPS
