"""Plans and helpers that must not grow faster than the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driver_queries import views
from longspan.functions.columns import seeded_draw, seeded_draws
from longspan.operators import checks, neighbors, ordered


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    people = [(i, f"n{i}", i % 25, 100.0 * i, ("AUTOMOBILE", "HOUSEHOLD", "MACHINERY")[i % 3]) for i in range(30)]
    people.append(people[4])  # one key twice
    orders = [
        (10 * i + j, i, "FOP"[(i + j) % 3], f"199{j}-01-{1 + i % 28:02d} 00:00:00") for i in range(30) for j in range(3)
    ]
    # One order key in two persons' hands, the first visit of one of them only.
    orders.append((71, 3, "F", "1999-05-05 00:00:00"))
    lines = [(o[0], 7 * o[0] + n, o[0] % 5, n, 1.0 + (o[0] + n) % 50, 1000.0 + o[0], 0.01 * n, 0.02) for o in orders for n in range(1, 8)]
    spark.createDataFrame(people, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, d string").select(
        "*", F.to_timestamp("d").alias("o_orderdate")
    ).drop("d").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(
        lines,
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double",
    ).write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def test_cells_unfold_after_the_choice_of_first_visits(spark, folder):
    first = views.first_visits(spark, folder)
    every = views.features(spark, folder, cohorts=False)
    want = every.join(first, "visit_id", "left_semi").select(*every.columns).collect()
    chosen = views.features(spark, folder, cohorts=False, at=first)
    assert sorted(map(str, chosen.collect())) == sorted(map(str, want)) and len(want) < every.count()
    plan = views.baseline(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    # Above the unfolding there is no join of cells with visits any more, only joins below and of wide rows.
    above = plan[: plan.index("Generate")]
    assert "LeftSemi" not in above and "LeftSemi" in plan


def _above_tables(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" not in line]


def test_columns_and_features_that_nobody_reads_do_not_move(spark, folder):
    every = views.features(spark, folder, cohorts=False)
    plan = "".join(_above_tables(every.select("participant_id", "visit_id")))
    assert "l_orderkey" in plan and "l_quantity" not in plan and "l_extendedprice" not in plan
    names = ("cognitive_score", "hba1c_percent")
    chosen = views.features(spark, folder, cohorts=False, names=names)
    assert sorted(map(str, chosen.collect())) == sorted(map(str, every.where(F.col("feature_name").isin(*names)).collect()))
    scores = views.trajectory_series(views.visits(spark, folder), every)
    got = views.trajectories(spark, folder, views.visits(spark, folder))
    assert sorted(map(str, got.collect())) == sorted(map(str, scores.collect()))
    assert "l_extendedprice" not in "".join(_above_tables(got))


def test_safety_counts_features_before_they_meet_their_visits(spark):
    roles = spark.createDataFrame([("a", "ADNI", "global_train"), ("b", "TLSA", "india_validation")], "participant_id string, cohort string, role string")
    features = spark.createDataFrame([("a", "v1")] * 3 + [("a", "v2"), ("b", None), (None, "v1"), ("b", "v3")], "participant_id string, visit_id string")
    visits = spark.createDataFrame([("v1", 5), ("v1", 7), ("v2", 0), ("v3", 9)], "visit_id string, baseline_days int")
    anchors = spark.createDataFrame([("a", 1), ("b", 10)], "participant_id string, anchor_days int")
    found = checks.split_safety(roles, features, visits, anchors)
    assert {r.check: r.violations for r in found.collect()}["no_future_features"] == 6
    assert {r.check: r.violations for r in checks.split_safety(roles, features, visits).collect()}["no_future_features"] == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [participant_id" in plan


def test_scores_of_repeated_keys_equal_the_window_form(spark, folder):
    people = views.baseline_with_role(spark, folder)
    keys = ["participant_id", "modality", "replicate", "horizon"]
    want = views.cumulative_risk(views.hazards(people), ("participant_id", "modality", "replicate")).collect()
    got = views.scores(people).collect()
    assert sorted((*[r[k] for k in keys], round(r.risk, 9)) for r in got) == sorted((*[r[k] for k in keys], round(r.risk, 9)) for r in want)
    assert max(sum(r.participant_id == "4" for r in got), 0) > max(sum(r.participant_id == "7" for r in got), 0)


def test_draws_in_tasks_equal_the_column_form(spark):
    keys = [0, 1, 17, 2**31 - 1, 2**40 + 5, -3]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select(*[seeded_draw("k", s).alias(str(s)) for s in (0, 7, 114)]).collect()
    assert seeded_draws(np.array(keys)[:, None], np.array([0, 7, 114])).tolist() == [list(r) for r in rows]


def test_quantiles_read_their_input_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).select((F.col("id") % 37).cast("double").alias("v")).mapInArrow(count, "v double")
    found = ordered.exact_quantiles(rows, "v", [0.25, 0.5]).collect()
    assert reads.value == 1000
    assert sorted(r["quantile"] for r in found) == pytest.approx(np.quantile(np.arange(1000) % 37, [0.25, 0.5]).tolist())


@pytest.mark.parametrize("width", [1, 3, 20])
def test_neighbours_with_ties_copies_and_many_cells(spark, monkeypatch, width):
    monkeypatch.setattr(neighbors, "CELL_ROWS", 8)
    rng = np.random.default_rng(width)
    x = rng.integers(0, 6, size=(240, width)) / 4.0  # many equal vectors and equal distances
    ids = [f"v{i}" for i in range(240)]
    rows = spark.createDataFrame(list(zip(ids, x.tolist())), "id string, vector array<double>")
    odd = spark.createDataFrame([("nan", [float("nan")] * width), ("null", None)], "id string, vector array<double>")
    rows = rows.unionByName(odd)
    q = rows.select(F.col("id").alias("qid"), "vector", F.col("id").alias("exclude"))
    got = neighbors.knn_join(q, rows.withColumnRenamed("id", "rid"), 5).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = [
        (ids[i], r, place + 1)
        for i in range(240)
        for place, (_, r) in enumerate(sorted((round(d[i, j], 9), ids[j]) for j in range(240) if j != i)[:5])
    ]
    assert sorted((r.qid, r.rid, r["rank"]) for r in got) == sorted(want)


def test_a_query_of_few_dimensions_meets_a_small_share_of_the_reference(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "CELL_ROWS", 16)
    points = np.random.default_rng(1).random((2048, 2))
    kept = spark.createDataFrame([(f"v{i}", p.tolist()) for i, p in enumerate(points)], "rid string, vector array<double>")
    tree = neighbors._tree(kept, 2048, 2, 5)
    leaf = tree.leaf(points)
    cells = [(c, int((leaf == c).sum()), points[leaf == c].min(0), points[leaf == c].max(0)) for c in np.unique(leaf)]
    sent = kept.select(F.size(neighbors._tree_candidates(tree, cells, 6)("vector")).alias("n"))
    # 128 cells: a handful hold the neighbours, where the pivots sent each query to a share that did not fall.
    assert len(cells) == 128 and sent.agg(F.avg("n")).first()[0] < 8


def test_steps_of_the_mixed_model_read_few_partitions(spark, monkeypatch):
    from longspan.operators import mixed

    parts, whole = [], mixed.partial_sums

    def watched(rows, kernel, size):
        parts.append(rows.rdd.getNumPartitions())
        return whole(rows, kernel, size)

    monkeypatch.setattr(mixed, "partial_sums", watched)
    rng = np.random.default_rng(3)
    rows = [(f"p{i % 40}", float(t), float(20 + i % 7 + t + rng.normal())) for i in range(40) for t in range(4)]
    frame = spark.createDataFrame(rows, "participant_id string, horizon_years double, future_score double").repartition(32)
    monkeypatch.setattr(mixed, "MAX_ITERATIONS", 3)
    model = mixed.MixedModel(["horizon_years"], max_iterations=3).fit(frame)
    assert len(parts) == 3 and max(parts) <= spark.sparkContext.defaultParallelism
    assert model.effects.count() == 40


def test_lines_of_other_visits_go_where_they_are_read(spark, folder):
    from longspan.operators.common_model import may_match

    rows = spark.range(20000).select(F.col("id").alias("key")).union(spark.sql("SELECT CAST(NULL AS LONG)"))
    wanted = spark.range(0, 20000, 100).select(F.col("id").alias("visit")).union(spark.sql("SELECT 100L"))
    kept = may_match(rows, "key", wanted, "visit")
    # No wanted row goes, rows are not repeated, and few others stay.
    assert kept.join(wanted.distinct(), F.col("key") == F.col("visit")).count() == 200 and kept.count() < 210
    plan = views.baseline(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__marks") >= 2
