"""Checks, scaling, splits and modality feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.registry import query
from driver_queries.views import (
    baseline,
    baseline_with_role,
    draw_sql,
    features,
    roles,
    table,
    train,
    visits,
    with_ctes,
)
from longspan.operators import checks, modality, scaling, splits
from longspan.operators.checks import TRAIN_ROLES, VALIDATION_ROLES
from longspan.session import cut_lineage
from longspan.sources import contracts

NUMERIC = ("age", "education_years", "cognitive_score", "hippocampal_volume_mm3", "hba1c_percent", "rnfl_um")


@query(
    "baseline_offsets",
    "H1",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS visit_date,
    date_diff('day', min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey), CAST(o_orderdate AS DATE)) AS baseline_days FROM orders""",
)
def _offsets(spark, folder):
    o = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("visit_date")
    )
    return checks.add_baseline_offsets(o, participant="o_custkey").drop("o_custkey")


@query(
    "non_monotonic_visits",
    "H2",
    """SELECT o_custkey, o_orderkey, days, previous_value FROM (
    SELECT o_custkey, o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days,
      lag(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous_value
    FROM orders) AS v WHERE previous_value > days""",
)
def _non_monotonic(spark, folder):
    o = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("days")
    )
    return checks.order_violations(o, "days", "o_orderkey", participant="o_custkey", span=F.floor(F.col("o_orderkey") / 2048))


@query(
    "future_feature_rows",
    "H3",
    """SELECT o_orderstatus, count(*) AS leaking, min(date_diff('day', o_orderdate, l_shipdate)) AS first_late,
    max(date_diff('day', o_orderdate, l_shipdate)) AS last_late
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY GROUP BY o_orderstatus""",
)
def _future(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("o"))
    l = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("s"))
    timed = l.join(o, l.l_orderkey == o.o_orderkey).select(
        "o_orderstatus", F.lit(60).alias("anchor_days"), F.date_diff("s", "o").alias("feature_days")
    )
    return checks.future_feature_violations(timed).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("leaking"), F.min("feature_days").alias("first_late"), F.max("feature_days").alias("last_late")
    )


@query(
    "split_overlaps",
    "H4",
    """SELECT 1 AS split, o_custkey AS participant_id FROM orders GROUP BY o_custkey
    HAVING max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) = 1
    UNION ALL SELECT 2, o_custkey FROM orders GROUP BY o_custkey
    HAVING max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = 1""",
)
def _overlaps(spark, folder):
    o = table(spark, folder, "orders").withColumnRenamed("o_custkey", "participant_id")
    by = {s: o.where(F.col("o_orderstatus") == s) for s in "FOP"}
    return checks.split_overlaps(by["F"], by["O"], by["P"])


def _numeric_rows(spark, folder):
    """Train and validation rows of the numeric columns; the wide table is written once for both."""
    rows = cut_lineage(baseline_with_role(spark, folder).select("participant_id", "role", *NUMERIC))
    return rows.where(F.col("role").isin(*TRAIN_ROLES)), rows.where(F.col("role").isin(*VALIDATION_ROLES))


@query(
    "standardized_validation",
    "H5, H11",
    with_ctes(
        "SELECT v.participant_id, "
        + ", ".join(
            f"(v.{c} - (SELECT avg({c}) FROM train)) / (SELECT CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END FROM train) AS {c}"
            for c in NUMERIC
        )
        + " FROM validation v",
        "train", "validation",
    ),
    " ".join(NUMERIC),
)
def _standardized(spark, folder):
    fit_rows, held = _numeric_rows(spark, folder)
    return scaling.Standardizer(NUMERIC).fit(fit_rows).transform(held).select("participant_id", *NUMERIC)


COMBAT = ("wmh_burden_ml", "hba1c_percent")


def _combat_ctes() -> dict[str, str]:
    ctes = {
        "med": "SELECT " + ", ".join(f"quantile_cont({f}, 0.5) AS {f}" for f in COMBAT) + " FROM train",
        "d": "SELECT t.participant_id, t.cohort, t.age - 70.0 AS x, "
        + ", ".join(f"coalesce(t.{f}, med.{f}) AS {f}" for f in COMBAT)
        + " FROM train t, med",
        "fit": "SELECT "
        + ", ".join(f"regr_slope({f}, x) AS b_{f}, regr_intercept({f}, x) AS c_{f}" for f in COMBAT)
        + " FROM d",
        "batches": "SELECT d.cohort, "
        + ", ".join(
            f"avg(d.{f} - b_{f} * x - c_{f}) AS m_{f}, stddev_samp(d.{f} - b_{f} * x - c_{f}) AS s_{f}" for f in COMBAT
        )
        + " FROM d, fit GROUP BY d.cohort",
        "grand": "SELECT " + ", ".join(f"avg({f}) AS gm_{f}, stddev_samp({f}) AS gs_{f}" for f in COMBAT) + " FROM train",
        "pooled": "SELECT " + ", ".join(f"stddev_samp(d.{f} - b_{f} * x - c_{f}) AS p_{f}" for f in COMBAT) + " FROM d, fit",
    }
    return ctes


def _combat_rows(spark, folder):
    """The corrected columns and their covariate, written once for the fit's passes and the transform."""
    age = (F.col("age") - 70.0).alias("age")
    return cut_lineage(baseline_with_role(spark, folder).select("participant_id", "cohort", "role", age, *COMBAT))


@query(
    "batch_corrected",
    "H6, H7",
    with_ctes(
        "SELECT v.participant_id, v.cohort, "
        + ", ".join(f"(v.{f} - coalesce(m_{f}, 0)) / coalesce(s_{f}, 1) * gs_{f} + gm_{f} AS {f}" for f in COMBAT)
        + " FROM staffed v CROSS JOIN grand LEFT JOIN batches ON v.cohort = batches.cohort",
        "train", extra=_combat_ctes(),
    ),
    " ".join(COMBAT),
)
def _combat(spark, folder):
    rows = _combat_rows(spark, folder)
    fitted = scaling.BatchCorrector("cohort", COMBAT, ("age",)).fit(rows.where(F.col("role").isin(*TRAIN_ROLES)))
    return fitted.transform(rows).select("participant_id", "cohort", *COMBAT)


@query(
    "batch_corrected_residual",
    "H6, H7",
    with_ctes(
        "SELECT v.participant_id, v.cohort, "
        + ", ".join(
            f"b_{f} * (v.age - 70.0) + c_{f} + (v.{f} - (b_{f} * (v.age - 70.0) + c_{f}) - coalesce(m_{f}, 0)) / coalesce(s_{f}, 1) * p_{f} AS {f}"
            for f in COMBAT
        )
        + " FROM staffed v CROSS JOIN fit CROSS JOIN pooled LEFT JOIN batches ON v.cohort = batches.cohort",
        "train", extra=_combat_ctes(),
    ),
    " ".join(COMBAT),
)
def _combat_residual(spark, folder):
    rows = _combat_rows(spark, folder)
    fitted = scaling.BatchCorrector("cohort", COMBAT, ("age",), mode="residual").fit(rows.where(F.col("role").isin(*TRAIN_ROLES)))
    return fitted.transform(rows).select("participant_id", "cohort", *COMBAT)


@query(
    "batch_diagnostics",
    "H8",
    with_ctes(
        "\nUNION ALL ".join(
            f"SELECT cohort AS batch, '{f}' AS feature, avg({f}) AS mean, stddev_samp({f}) AS std, avg(CASE WHEN {f} IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate FROM baseline GROUP BY cohort"
            for f in contracts.FEATURES
        ),
        "baseline",
    ),
    "mean std missing_rate",
)
def _diagnostics(spark, folder):
    return scaling.batch_diagnostics(baseline(spark, folder), "cohort", list(contracts.FEATURES))


@query(
    "subject_split",
    "H9",
    f"""SELECT o_orderkey, CASE WHEN place <= greatest(1, round_even(n * 0.2, 0)) THEN 'test' ELSE 'train' END AS side
    FROM orders JOIN (SELECT participant_id, row_number() OVER (ORDER BY {draw_sql('participant_id', '42')}, CAST(participant_id AS VARCHAR)) AS place,
      count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey AS participant_id FROM orders) AS p) AS r ON o_custkey = r.participant_id""",
)
def _subject_split(spark, folder):
    from longspan.functions.columns import seeded_draw

    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("participant_id"))
    left, right = splits.subject_split(o, draw=seeded_draw(F.col("participant_id").cast("long"), 42))
    sides = left.select("o_orderkey", F.lit("train").alias("side")).unionByName(right.select("o_orderkey", F.lit("test").alias("side")))
    return sides


@query("role_assignment", "H10", with_ctes("SELECT participant_id, cohort, role FROM roles", "roles"))
def _roles(spark, folder):
    return roles(spark, folder)


@query(
    "split_safety",
    "H11, H12",
    with_ctes(
        """SELECT 'participants_disjoint' AS "check", count(*) - count(DISTINCT participant_id) AS violations FROM roles
        UNION ALL SELECT 'held_out_cohort_not_in_train', count(*) FROM roles WHERE cohort = 'SANSCOG' AND role IN ('global_train', 'tlsa_adaptation')
        UNION ALL SELECT 'no_future_features', count(*) FROM features f JOIN visits v ON f.visit_id = v.visit_id WHERE v.baseline_days > 0""",
        "roles", "features", "visits",
    ),
)
def _split_safety(spark, folder):
    r = roles(spark, folder)
    anchors = r.select("participant_id", F.lit(0).alias("anchor_days"))
    return checks.split_safety(r, features(spark, folder, cohorts=False), visits(spark, folder), anchors)


@query(
    "median_imputed",
    "H13",
    with_ctes(
        "SELECT v.participant_id, "
        + ", ".join(f"coalesce(v.{c}, (SELECT quantile_cont({c}, 0.5) FROM train)) AS {c}" for c in NUMERIC)
        + " FROM validation v",
        "train", "validation",
    ),
    " ".join(NUMERIC),
)
def _imputed(spark, folder):
    fit_rows, held = _numeric_rows(spark, folder)
    return scaling.MedianImputer(NUMERIC).fit(fit_rows).transform(held).select("participant_id", *NUMERIC)


# --- modality features ---------------------------------------------------------


def _names(m: str) -> list[str]:
    return sorted(f for f, (mod, _, _) in contracts.FEATURES.items() if mod == m)


def _wide_sql(m: str) -> str:
    cols = ", ".join(f"arg_min(value, sequence) FILTER (WHERE feature_name = '{f}') AS {f}" for f in _names(m))
    return f"SELECT participant_id, visit_id, {cols} FROM features WHERE modality = '{m}' GROUP BY participant_id, visit_id"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0 ELSE 0.0 END"


def _z(column: str) -> str:
    return f"-(({column} - (SELECT avg({column}) FROM w)) / (SELECT CASE WHEN stddev_samp({column}) > 0 THEN stddev_samp({column}) ELSE 1 END FROM w))"


def _modality_query(name: str, items: str, m: str, derived: dict[str, str]):
    body = "SELECT *, " + ", ".join(f"{sql} AS {c}" for c, sql in derived.items()) + " FROM w"
    sql = with_ctes(body, "features", extra={"w": _wide_sql(m)})

    @query(name, items, sql, " ".join([*_names(m), *derived]))
    def _run(spark, folder):
        return modality.build_modality(features(spark, folder, cohorts=False), m, _names(m), order="sequence")

    return _run


_modality_query(
    "cognition_features", "F1, F3", "cognition",
    {
        "domain_composite_z": "CASE WHEN executive_score IS NULL AND memory_score IS NULL THEN NULL ELSE (coalesce(executive_score, 0) + coalesce(memory_score, 0)) / ((executive_score IS NOT NULL)::INT + (memory_score IS NOT NULL)::INT) END",
        "cognitive_impairment_flag": _flag("cognitive_score < 24"),
        "mild_impairment_flag": _flag("cognitive_score >= 24 AND cognitive_score < 27"),
    },
)
_modality_query(
    "mri_features", "F1, F4, F5", "mri",
    {
        "hippo_atrophy_z": _z("hippocampal_volume_mm3"),
        "vent_hippo_ratio": "CASE WHEN hippocampal_volume_mm3 IS NOT NULL THEN ventricular_volume_mm3 / greatest(hippocampal_volume_mm3, 100) END",
        "cortical_thinning_z": _z("cortical_thickness_mean_mm"),
        "wmh_severe": _flag("wmh_burden_ml > 6"),
    },
)
_modality_query(
    "blood_features", "F1, F6", "biochem",
    {
        "prediabetic_flag": _flag("hba1c_percent >= 5.7"),
        "high_cholesterol_flag": _flag("total_cholesterol_mg_dl > 240"),
        "metabolic_risk_count": f"{_flag('hba1c_percent > 5.7')} + {_flag('fasting_glucose_mg_dl > 100')} + {_flag('total_cholesterol_mg_dl > 240')}",
        "log_crp": "ln(1 + hs_crp_mg_l)",
        "high_inflammation": _flag("hs_crp_mg_l > 3"),
    },
)
_modality_query(
    "retina_features", "F1, F7", "oct",
    {
        "rnfl_thin": _flag("rnfl_um < 85"),
        "rnfl_severe_thin": _flag("rnfl_um < 75"),
        "low_vessel_density": _flag("vessel_density_percent < 44"),
        "enlarged_faz": _flag("gfaz_area_mm2 > 0.35"),
        "retinal_risk_count": f"{_flag('rnfl_um < 85')} + {_flag('vessel_density_percent < 44')} + {_flag('gfaz_area_mm2 > 0.35')}",
    },
)
_modality_query(
    "genomics_features", "F1, F8", "genomics",
    {
        "apoe_e4_carrier": _flag("apoe_e4_count > 0"),
        "apoe_e4_homozygous": _flag("apoe_e4_count = 2"),
        "ad_prs_proxy": "apoe_e4_count * 0.47",
        "indian_ancestry_flag": _flag("ancestry_pc1 > 0.5"),
        "non_european_ancestry": _flag("abs(ancestry_pc1) > 0.3"),
    },
)


@query(
    "missingness_indicators",
    "F2",
    with_ctes(
        "SELECT participant_id, "
        + ", ".join(f"{f}, CASE WHEN {f} IS NULL THEN 1 ELSE 0 END AS {f}__missing" for f in contracts.FEATURES)
        + " FROM baseline",
        "baseline",
    ),
    " ".join(contracts.FEATURES),
)
def _missing(spark, folder):
    frame = baseline(spark, folder).select("participant_id", *contracts.FEATURES)
    return modality.add_missingness_indicators(frame, ["participant_id"])


@query(
    "training_ranges",
    "F10",
    with_ctes(
        "\nUNION ALL ".join(
            f"SELECT '{f}' AS feature, quantile_cont(CAST({f} AS DOUBLE), 0.01) AS low, quantile_cont(CAST({f} AS DOUBLE), 0.99) AS high FROM train"
            for f in contracts.MODEL_FEATURES
        ),
        "train",
    ),
    "low high",
)
def _ranges(spark, folder):
    found = modality.training_ranges(train(spark, folder))
    return spark.createDataFrame([(f, lo, hi) for f, (lo, hi) in found.items()], "feature string, low double, high double")


@query(
    "missingness_by_cohort",
    "F9, F11",
    with_ctes(
        "\nUNION ALL ".join(
            f"SELECT cohort, '{g}' AS modality, 1.0 - avg(CASE WHEN coalesce({', '.join('CAST(' + f + ' AS DOUBLE)' for f in fs)}) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS missing_rate FROM baseline GROUP BY cohort"
            for g, fs in contracts.MODEL_GROUPS.items()
        ),
        "baseline",
    ),
    "missing_rate",
)
def _missing_by_cohort(spark, folder):
    return modality.missingness_by_cohort(baseline(spark, folder))
