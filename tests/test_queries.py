"""Registered queries against their oracles at the smallest scale."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from driver_queries.catalog import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()
QUICK = (
    "progression_outcomes", "visit_file_visits", "two_file_visits", "non_monotonic_visits", "split_overlaps",
    "kaplan_meier_by_cohort", "concordance_index", "binary_metrics", "delong_components", "interpolated_series",
    "nearest_vectors", "quantile_bins_tied", "reliability", "late_fusion", "training_pairs", "batch_risk",
    "fused_distribution", "risk_intervals", "what_if_risk", "ablation", "cumulative_risk", "metrics_by_role",
    "contract_typed_visits", "contract_typed_measurements", "nearest_participants", "participant_warnings", "bootstrap_weights",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if value is None or isinstance(value, (int, str)):
        return value
    return repr(float(value)) if type(value).__name__ == "Decimal" else str(value)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", QUICK)
def test_against_oracle(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in place) for r in cursor.fetchall()), key=repr)
    assert got and got == want


def test_study_tables_all_run(spark):
    rows = QUERIES["study_forecast_tables"](spark, FOLDER).groupBy("table_name").count().collect()
    assert {r.table_name for r in rows} >= {
        "risks", "trajectory", "drivers", "twins", "twin_trajectories", "warnings", "survival_curve", "validation_predictions",
        "validation_summary", "validation_calibration", "validation_subgroups", "validation_ablation", "validation_missingness",
    }


def test_delong_p_value(spark):
    z = QUERIES["delong_components"](spark, FOLDER).first().z
    assert QUERIES["delong_p_value"](spark, FOLDER).first().p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-6)
