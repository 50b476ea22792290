"""Contracts, checks, outcomes and cohort readers on small frames."""

import datetime

import pytest
from pyspark.sql import functions as F

from longspan.functions.columns import seeded_draw
from longspan.operators import checks, common_model, modality, outcomes, splits
from longspan.operators.ordered import exact_quantiles, position_within, running
from longspan.sources import contracts, sinks, tables


def test_required_columns():
    given = {"participants": ["participant_id"], "visits": ["visit_id", "participant_id", "cohort", "visit_index", "age_at_visit"], "nothing": []}
    assert contracts.schema_gaps(given) == {"participants": ["cohort"], "nothing": ["*"]}
    with pytest.raises(ValueError, match=r"participants \(cohort\); nothing"):
        contracts.check_tables(given)
    schema = contracts.contract_schemas()["visits"]
    assert [f.name for f in schema if f.metadata["key"]] == ["visit_id"]
    assert schema["visit_index"].dataType.simpleString() == "int"
    assert not schema["visit_id"].nullable and schema["visit_date"].nullable


def test_primary_key(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    assert {r.key_value: r.n_rows for r in contracts.primary_key_violations(df, "k").collect()} == {"a": 2, None: 1}
    with pytest.raises(ValueError):
        contracts.require_primary_key(df, "k")


def test_baseline_offsets(spark):
    rows = [
        ("A", "2020-01-01"), ("A", "2020-01-11"), ("B", "2021-05-01"), ("B", "2021-05-03"), ("C", "2022-01-01"),
        ("D", "2020-01-11"), ("D", "2020-01-01"), ("D", "2020-01-05"),
    ]
    df = spark.createDataFrame(rows, "participant_id string, visit_date string")
    got = {(r.participant_id, str(r.visit_date)): r.baseline_days for r in checks.add_baseline_offsets(df).collect()}
    assert [got[("A", "2020-01-01")], got[("A", "2020-01-11")], got[("B", "2021-05-03")], got[("C", "2022-01-01")]] == [0, 10, 2, 0]
    assert [got[("D", d)] for d in ("2020-01-11", "2020-01-01", "2020-01-05")] == [10, 0, 4]


@pytest.mark.parametrize("span", [None, "floor(sequence / 2)"])
def test_monotonic(spark, span):
    df = spark.createDataFrame([(1, 1, 0), (1, 3, 1), (1, 2, 2), (2, 1, 0), (2, 2, 1)], "participant_id int, visit_index int, sequence int")
    bad = checks.order_violations(df, "visit_index", "sequence", span=F.expr(span) if span else None).collect()
    assert [(r.participant_id, r.visit_index, r.previous_value) for r in bad] == [(1, 2, 3)]
    with pytest.raises(ValueError, match="participant 1"):
        checks.require_monotonic_visits(df)


def test_leakage_and_overlap(spark):
    df = spark.createDataFrame([(100, 101), (100, 99)], "anchor_days int, feature_days int")
    with pytest.raises(ValueError, match="1 feature rows"):
        checks.require_no_future_features(df)
    assert checks.without_future_features(df).count() == 1
    a = spark.createDataFrame([("p1",), ("p2",)], "participant_id string")
    b = spark.createDataFrame([("p2",), ("p3",)], "participant_id string")
    with pytest.raises(ValueError, match="split 2: p2"):
        checks.require_disjoint_participants(a, b.where("participant_id = 'p3'"), b)


def test_subject_split(spark):
    df = spark.createDataFrame([(f"p{i}",) for i in (1, 2, 3, 4)] * 2, "participant_id string")
    train, test = splits.subject_split(df, test_size=0.25, seed=7)
    left = {r[0] for r in train.collect()}
    right = {r[0] for r in test.collect()}
    assert len(right) == 1 and not left & right and left | right == {"p1", "p2", "p3", "p4"}


def test_roles_have_exact_sizes_and_ignore_partitioning(spark):
    df = spark.range(200).select(
        F.col("id").cast("string").alias("participant_id"),
        F.when(F.col("id") < 120, "ADNI").when(F.col("id") < 160, "TLSA").otherwise("SANSCOG").alias("cohort"),
    )
    one = {tuple(r) for r in splits.assign_roles(df).collect()}
    two = {tuple(r) for r in splits.assign_roles(df.repartition(7)).collect()}
    assert one == two
    count = lambda role: sum(r[2] == role for r in one)
    assert (count("public_validation"), count("india_validation"), count("external_validation")) == (24, 12, 40)


def test_pivot(spark):
    rows = [
        ("1", "P1", "V1", "MRI", "vol", 1.0), ("2", "P1", "V1", "MRI", "thk", 2.0), ("3", "P2", "V1", "MRI", "vol", 3.0),
        ("4", "P1", "V1", "PET", "suvr", 4.0), ("5", "P1", "V1", "MRI", "vol", 9.0),
    ]
    df = spark.createDataFrame(rows, "feature_row_id string, participant_id string, visit_id string, modality string, feature_name string, value double")
    wide = modality.pivot_modality(df, "MRI")
    assert wide.columns == ["participant_id", "visit_id", "thk", "vol"]
    assert {r.participant_id: (r.thk, r.vol) for r in wide.collect()} == {"P1": (2.0, 1.0), "P2": (None, 3.0)}
    assert modality.pivot_modality(df, "none").count() == 0


def test_flags_treat_null_as_zero(spark):
    wide = spark.createDataFrame([("a", None, 5.0), ("b", 5.8, None)], "participant_id string, hba1c_percent double, hs_crp_mg_l double")
    got = {r.participant_id: r for r in modality.derive_blood(wide).collect()}
    assert got["a"].prediabetic_flag == 0.0 and got["a"].high_inflammation == 1.0
    assert got["b"].metabolic_risk_count == 1.0 and got["b"].log_crp is None


def test_outcomes(spark):
    rows = [
        ("A", 0, 0, "cognitively_unimpaired"), ("A", 1, 400, "mci"), ("A", 2, 900, "dementia"),
        ("B", 0, 0, "mci"), ("B", 1, 300, "mci"),
        ("C", 0, 0, "unknown"), ("C", 1, 10, "dementia"),
        ("D", 0, 0, "mci"),
    ]
    df = spark.createDataFrame(rows, "participant_id string, visit_index int, baseline_days int, diagnosis string")
    df = df.withColumn("visit_id", F.concat_ws("-", "participant_id", "visit_index"))
    got = {(r.participant_id, r.horizon_days): (r.event, r.event_time_days, r.censoring_reason) for r in outcomes.progression_outcomes(df).collect()}
    assert got[("A", 365)] == (0, 400, "study_end") and got[("A", 1096)] == (1, 400, "")
    assert got[("B", 1826)] == (0, 300, "study_end")
    assert got[("C", 365)] == (0, 10, "study_end")
    assert got[("D", 365)] == (0, 1, "study_end")
    anchors = {r.anchor_visit_id for r in outcomes.progression_outcomes(df, anchor="first_visit").collect()}
    assert anchors == {"A-0", "B-0", "C-0", "D-0"}


def test_report_text(spark):
    text = sinks.report_markdown("Test Report", {"accuracy": 0.95123, "loss": 0.1}, ["one", "two"], spark)
    assert text == "# Test Report\n\n## Metrics\n- accuracy: 0.9512\n- loss: 0.1000\n\n## Notes\n- one\n- two\n"
    assert sinks.report_markdown("Empty Report", {}, [], spark) == "# Empty Report\n\n## Metrics\n"


def test_running_matches_plain_window(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 501).alias("x"), F.col("id").alias("v"))
    got = running(df, "x", {"s": F.col("v")}, by=["g"], ranges=5)
    plain = df.selectExpr("*", "sum(v) over (partition by g order by x) as s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    down = running(df, "x", {"s": F.col("v")}, by=["g"], ranges=5, descending=True, exclusive=True)
    plain = df.selectExpr("*", "coalesce(sum(v) over (partition by g order by x desc rows between unbounded preceding and 1 preceding), 0) as s")
    assert sorted(map(tuple, down.collect())) == sorted(map(tuple, plain.collect()))


def test_position_and_quantiles(spark):
    df = spark.range(301).select((F.col("id") % 2).alias("g"), (F.col("id") * 11 % 97).alias("x"), F.col("id").alias("t"))
    got = position_within(df, ["g"], "x", "t", ranges=6)
    plain = df.selectExpr("*", "row_number() over (partition by g order by x, t) - 1 as position")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    q = {(r.g, r.probability): r["quantile"] for r in exact_quantiles(df, "x", [0.0, 0.1, 0.5, 1.0], by=["g"]).collect()}
    exact = df.groupBy("g").agg(F.percentile("x", F.array(*[F.lit(p) for p in (0.0, 0.1, 0.5, 1.0)])).alias("q")).collect()
    for r in exact:
        assert [q[(r.g, p)] for p in (0.0, 0.1, 0.5, 1.0)] == pytest.approx(r.q)


def test_manifest_and_units(spark):
    manifest = common_model.harmonisation_manifest(spark)
    assert manifest.count() == 7 * 17
    row = manifest.where("cohort = 'UK Biobank' and canonical_feature = 'hba1c_percent'").first()
    assert row.source_variable == "uk_biobank_hba1c" and row.conversion.startswith("IFCC")
    df = spark.createDataFrame([("UK Biobank", "hba1c_percent", 40.0), ("ADNI", "rnfl_um", 90.0), ("OASIS", "rnfl_um", 0.09)], "cohort string, feature_name string, source_value double")
    got = {r.cohort: r.value for r in common_model.to_canonical_units(df).collect()}
    assert got["UK Biobank"] == pytest.approx(40 / 10.929 + 2.15) and got["ADNI"] == 90.0 and got["OASIS"] == pytest.approx(90.0)


def test_native_files(spark, tmp_path):
    adni = tmp_path / "adni"
    adni.mkdir()
    (adni / "ADNIMERGE.csv").write_text(
        "RID,PTGENDER,EXAMDATE,AGE,PTEDUCAT,VISCODE,DX,CDRSB,MMSE,APOE4\n"
        "12,Male,2005-09-08,74.3,16,bl,CN,0,29,1\n"
        "12,Male,2006-09-10,74.3,16,m12,MCI,1.8,27,1\n"
        "12345,X,bad,,,zz,,,,\n"
    )
    got = tables.read_cohort(spark, "adni", str(adni))
    people = {r.participant_id: r for r in got.participants.collect()}
    assert set(people) == {"ADNI-0012", "ADNI-12345"}
    assert people["ADNI-0012"].birth_year == 1930 and people["ADNI-12345"].sex == "Unknown"
    assert people["ADNI-12345"].birth_year is None and people["ADNI-12345"].education_years == 0.0
    visits = {r.visit_id: r for r in got.visits.collect()}
    assert visits["ADNI-0012-V2"].baseline_days == 367 and visits["ADNI-0012-V2"].cdr_global == pytest.approx(0.1)
    assert visits["ADNI-12345-V0"].diagnosis == "unknown" and visits["ADNI-12345-V0"].baseline_days == 0
    assert got.modality_features.count() == 4
    event = {r.horizon_days: r.event for r in got.outcomes.where("participant_id = 'ADNI-0012'").collect()}
    assert event == {365: 0, 1096: 1, 1826: 1}
    with pytest.raises(FileNotFoundError, match="aibl_clinical.csv"):
        tables.read_cohort(spark, "aibl", str(adni))

    oasis = tmp_path / "oasis"
    oasis.mkdir()
    (oasis / "OASIS3_demographics.csv").write_text("Subject,M/F,EDUC\nS1,F,12\n")
    (oasis / "OASIS3_clinical.csv").write_text("Subject,Age,dx1,CDR,MMSE\nS1,70.5,AD Dementia,0.5,20\nS1,68.5,Cognitively normal,0,29\nS2,60,,,\n")
    aibl = tmp_path / "aibl"
    aibl.mkdir()
    (aibl / "aibl_clinical.csv").write_text("RID,PTGENDER,VISCODE,DXCURREN,MMSCORE\n1,1,bl,1,30\n1,1,M18,2,\n")
    nacc = tmp_path / "nacc"
    nacc.mkdir()
    (nacc / "investigator_nacc.csv").write_text("NACCID,VISITNUM,VISITYR,VISITMO,VISITDAY,NACCUDSD,NACCAPOE\nN1,1,2010,2,30,1,3\nN1,2,2011,2,3,3,9\n")
    both = tables.read_cohorts(spark, {"oasis": str(oasis), "aibl": str(aibl), "nacc": str(nacc)})
    visits = {r.visit_id: r for r in both.visits.collect()}
    assert visits["OASIS-S1-V0"].diagnosis == "cognitively_unimpaired" and visits["OASIS-S1-V1"].baseline_days == 730
    assert visits["OASIS-S2-V0"].diagnosis == "unknown"
    assert visits["AIBL-1-V1"].baseline_days == 540 and visits["AIBL-1-V1"].age_at_visit == 70.0
    assert visits["NACC-N1-V1"].visit_date is None and visits["NACC-N1-V2"].baseline_days == 0
    sexes = {r.participant_id: r.sex for r in both.participants.collect()}
    assert sexes == {"OASIS-S1": "Female", "OASIS-S2": "Unknown", "AIBL-1": "Male", "NACC-N1": "Unknown"}

    out = tmp_path / "common"
    tables.write_common_model(got, str(out), "csv")
    back = tables.read_common_model(spark, str(out), cohort="tlsa")
    assert back.participants.select("cohort").distinct().collect()[0][0] == "tlsa"
    dates = {r.visit_id: r.visit_date for r in back.visits.collect()}
    assert dates["ADNI-0012-V0"] == datetime.date(2005, 9, 8)


def test_keys_beyond_31_bits(spark):
    big = 2**31 - 1
    rows = [("p", 10, big + 5, "mci"), ("p", 10, 3, "cognitively_unimpaired"), ("p", 400, 2**40, "dementia")]
    visits = spark.createDataFrame(rows, "participant_id string, baseline_days int, visit_index long, diagnosis string")
    visits = visits.withColumn("visit_id", F.col("visit_index").cast("string"))
    got = outcomes.conversion_summary(visits).first()
    assert (got.base_diagnosis, got.first_visit_id, got.conversion_days) == ("cognitively_unimpaired", "3", 10)
    keys = spark.createDataFrame([(7,), (7 + big,), (7 + 5 * big,)], "k long")
    assert keys.select(seeded_draw("k", 3)).distinct().count() == 3


def test_common_model_from_any_tables(spark):
    text = lambda *columns: spark.createDataFrame([tuple("NaN" if c == "value" else "7" for c in columns)], list(columns))
    raw = {name: text(*[f.name for f in schema if f.metadata["required"]], "more") for name, schema in contracts.contract_schemas().items()}
    found = tables.common_model(raw, cohort="x")
    assert found.visits.first().visit_index == 7 and found.visits.first().more == "7"
    row = found.modality_features.first()
    assert row.value is None and row.cohort == "x"
    with pytest.raises(ValueError, match="visits"):
        tables.common_model({**raw, "visits": raw["visits"].drop("visit_index")})


def test_rows_without_a_group_stay(spark):
    from longspan.operators.common_model import days_since_first
    from longspan.operators.ordered import position_within, running

    rows = spark.createDataFrame([(None, "2020-01-05", 1), (None, "2020-01-01", 2), ("a", "2020-02-01", 3)], "participant_id string, day string, n int")
    dated = rows.withColumn("day", F.col("day").cast("date"))
    got = {r.n: r.baseline_days for r in days_since_first(dated, "day").collect()}
    assert got == {1: 4, 2: 0, 3: 0}
    places = {r.n: r.position for r in position_within(dated, ["participant_id"], "n", "n", ranges=2).collect()}
    assert places == {1: 0, 2: 1, 3: 0}
    sums = {r.n: r.total for r in running(dated, "n", {"total": F.col("n")}, by=["participant_id"], ranges=2).collect()}
    assert sums == {1: 1, 2: 3, 3: 3}
