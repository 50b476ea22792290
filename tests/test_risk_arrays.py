"""Array risks against the long form, row by row, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan.operators import fusion, risk_arrays
from longspan.operators.survival import cumulative_risk

SCHEMA = "participant_id string, groups array<struct<modality string, hazards array<array<double>>>>"
GROUPS = ("Cognition + clinical", "MRI", "Blood")


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(5)
    rows = [
        (f"p{i}", [(g, (rng.random((4, 5)) * 1.2 - 0.1).tolist()) for g in GROUPS if rng.random() < 0.7])
        for i in range(40)
    ]
    return spark.createDataFrame([*rows, ("none", [])], SCHEMA).cache()


def long_form(people):
    rows = people.select("participant_id", F.explode("groups").alias("g")).select("participant_id", "g.*")
    rows = rows.select("participant_id", "modality", F.posexplode("hazards").alias("replicate", "h"))
    rows = rows.select("participant_id", "modality", "replicate", F.posexplode("h").alias("year", "hazard"))
    rows = rows.withColumn("interval_year", (F.col("year") + 1).cast("double"))
    return cumulative_risk(rows, ("participant_id", "modality", "replicate"))


def keyed(df, keys, values):
    return {tuple(r[k] for k in keys): pytest.approx([r[v] for v in values], abs=1e-12) for r in df.collect()}


def test_equals_the_long_form(people):
    for disabled in ((), ("MRI",), GROUPS[:2]):
        fused = fusion.risk_distribution(long_form(people), disabled)
        risks = [f"risk_{h}y" for h in (1, 3, 5)]
        got = {(r.participant_id,): [r[c] for c in risks] for r in risk_arrays.with_batch_risk(people, disabled).collect()}
        want = keyed(fusion.batch_risk(fused), ["participant_id"], risks)
        assert len(got) == 41 and {k: v for k, v in got.items() if k in want} == want
        assert all(got[k] == [None] * 3 for k in got.keys() - want.keys())
        keys = ["participant_id", "replicate", "horizon"]
        assert {tuple(r[k] for k in keys): [r.risk] for r in risk_arrays.distribution_rows(people, disabled).collect()} == keyed(fused, keys, ["risk"])
    fused, keys, values = fusion.risk_distribution(long_form(people)), ["participant_id", "horizon"], ["risk", "lower", "upper"]
    got = {tuple(r[k] for k in keys): [r[v] for v in values] for r in risk_arrays.interval_rows(people).collect()}
    assert got == keyed(fusion.risk_intervals(fused), keys, values)


def test_no_shuffle_and_no_window(people):
    plan = risk_arrays.with_batch_risk(people)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_edges(spark):
    rows = spark.createDataFrame(
        [
            ("null hazard", [("MRI", [[0.5, None, 0.5, 0.5, 0.5]])]),
            ("short", [("MRI", [[0.5, 0.5, 0.5]])]),
            ("unknown group", [("other", [[0.5] * 5])]),
            ("no replicate", [("MRI", [])]),
            ("null groups", None),
        ],
        SCHEMA,
    )
    got = {r.participant_id: (r.risk_1y, r.risk_3y, r.risk_5y) for r in risk_arrays.with_batch_risk(rows).collect()}
    assert got["null hazard"] == pytest.approx((0.5, 0.75, 0.9375))
    assert got["short"][:2] == pytest.approx((0.5, 0.875)) and got["short"][2] is None
    for name in ("unknown group", "no replicate", "null groups"):
        assert got[name] == (None, None, None)
    assert risk_arrays.with_batch_risk(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        risk_arrays.fused_risks(F.col("groups"), weights={"MRI": -1.0})
