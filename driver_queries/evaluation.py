"""Discrimination, calibration, comparison and uncertainty queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.modelling import CENTROID, FEATURES, TARGET, _split
from driver_queries.newton_sql import newton_ctes
from driver_queries.registry import query
from driver_queries.views import (
    draw_sql,
    metrics_sql,
    predictions,
    scored,
    validation,
    with_ctes,
    with_groups,
)
from longspan.functions.columns import POISSON_ONE_CDF
from longspan.operators import calibration, comparison, discrimination, fusion, risk, risk_arrays, uncertainty
from longspan.operators.isotonic import IsotonicMap
from longspan.operators.survival import HazardEnsemble
from longspan.session import cut_lineage

METRICS = "auroc auprc brier"


@query(
    "binary_metrics",
    "E1-E4",
    with_ctes("SELECT * FROM ms", "scored", extra=metrics_sql("scored", "y", "a")),
    "n event_rate " + METRICS,
)
def _metrics(spark, folder):
    return discrimination.binary_metrics(scored(spark, folder), "y", "a")


@query(
    "binary_metrics_by_source",
    "E1-E4",
    with_ctes("SELECT * FROM ms", "scored", extra=metrics_sql("scored", "toxic", "b", "source, lang")),
    "n event_rate " + METRICS,
)
def _metrics_by(spark, folder):
    return discrimination.binary_metrics(scored(spark, folder), "toxic", "b", ["source", "lang"])


@query(
    "metrics_by_role",
    "E5",
    with_ctes(
        """SELECT CASE p.role WHEN 'public_validation' THEN 'Held-out public cohorts' WHEN 'india_validation' THEN 'TLSA adaptation check'
        ELSE 'SANSCOG external validation' END AS validation_set, p.participants, p.event_rate, auroc, auprc, brier
        FROM (SELECT role, count(*) AS participants, avg(event_by_3y) AS event_rate FROM predictions GROUP BY role) AS p LEFT JOIN ms ON ms.role = p.role""",
        "predictions", extra=metrics_sql("predictions", "event_by_3y", "risk_3y", "role"),
    ),
    "event_rate " + METRICS,
)
def _by_role(spark, folder):
    return discrimination.metrics_by_role(cut_lineage(predictions(spark, folder)))


SUBGROUP_SQL = {
    "india": "SELECT * FROM predictions WHERE role IN ('india_validation', 'external_validation')",
    "long": """SELECT 'Sex' AS dimension, sex AS grp, event_by_3y, risk_3y FROM india
        UNION ALL SELECT 'Age', CASE WHEN age > 0 AND age <= 64 THEN '≤64' WHEN age > 64 AND age <= 72 THEN '65–72' WHEN age > 72 AND age <= 120 THEN '73+' END, event_by_3y, risk_3y FROM india
        UNION ALL SELECT 'Education', CASE WHEN education_years <= 10 THEN '≤10 years' ELSE '>10 years' END, event_by_3y, risk_3y FROM india
        UNION ALL SELECT 'Setting', urban_rural, event_by_3y, risk_3y FROM india""",
}


@query(
    "subgroup_metrics",
    "E6",
    with_ctes(
        """SELECT s.dimension, s.grp AS "group", s.participants, s.event_rate, auroc, auprc, brier
        FROM (SELECT dimension, grp, count(*) AS participants, avg(event_by_3y) AS event_rate FROM long WHERE grp IS NOT NULL GROUP BY 1, 2) AS s
        LEFT JOIN ms ON ms.dimension = s.dimension AND ms.grp = s.grp""",
        "predictions", extra={**SUBGROUP_SQL, **metrics_sql("long", "event_by_3y", "risk_3y", "dimension, grp")},
    ),
    "event_rate " + METRICS,
)
def _subgroups(spark, folder):
    return discrimination.subgroup_metrics(cut_lineage(predictions(spark, folder)))


ABLATION_SQL = {
    "sc": """SELECT * FROM (VALUES ('Full multimodal', ''), ('Without MRI', 'MRI'), ('Without blood', 'Blood'), ('Without OCT/OCTA', 'OCT/OCTA'),
        ('Without genomics', 'Genomics'), ('Cognition + clinical only', 'MRI,Blood,OCT/OCTA,Genomics')) AS v(scenario, disabled)""",
    "fz": """SELECT scenario, participant_id, replicate, sum(risk * CAST(weight AS DOUBLE)) / sum(CAST(weight AS DOUBLE)) AS risk FROM scores JOIN weights USING (modality), sc
        WHERE horizon = 3 AND NOT list_contains(string_split(disabled, ','), modality) GROUP BY 1, 2, 3""",
    "bz": "SELECT scenario, participant_id, median(risk) AS risk_3y FROM fz GROUP BY 1, 2",
    "jz": "SELECT bz.*, v.event_by_3y FROM bz JOIN validation v ON v.participant_id = bz.participant_id",
}


@query(
    "ablation",
    "E7",
    with_ctes(
        "SELECT ms.*, auprc - (SELECT auprc FROM ms WHERE scenario = 'Full multimodal') AS auprc_delta FROM ms",
        "scores", "weights", extra={**ABLATION_SQL, **metrics_sql("jz", "event_by_3y", "risk_3y", "scenario")},
    ),
    "n event_rate auprc_delta " + METRICS,
)
def _ablation(spark, folder):
    return risk_arrays.ablation(cut_lineage(with_groups(validation(spark, folder)).select("participant_id", "event_by_3y", "groups")))


def _bins_sql(source: str, y: str, s: str, q: int) -> tuple[str, dict[str, str]]:
    ctes = {
        "vals": f"SELECT CAST({y} AS DOUBLE) AS y, {s} AS s FROM {source} WHERE {y} IS NOT NULL AND {s} IS NOT NULL",
        "edges": "SELECT DISTINCT unnest(quantile_cont(s, [" + ", ".join(f"{i}/{q}::DOUBLE" for i in range(q + 1)) + "])) AS e FROM vals",
        "inner_edges": "SELECT e FROM edges WHERE e > (SELECT min(e) FROM edges) AND e < (SELECT max(e) FROM edges)",
    }
    body = """SELECT bin, avg(s) AS mean_predicted, avg(y) AS observed_rate, count(*) AS n FROM (
        SELECT y, s, (SELECT count(*) FROM inner_edges WHERE e < s) AS bin FROM vals) AS b GROUP BY bin"""
    return body, ctes


_body, _ctes = _bins_sql("scored", "y", "a", 10)


@query("quantile_bins", "E8", with_ctes(_body, "scored", extra=_ctes), "mean_predicted observed_rate")
def _bins(spark, folder):
    return calibration.quantile_bins(scored(spark, folder), "y", "a", 10)


_body6, _ctes6 = _bins_sql("scored", "toxic", "b", 6)


@query("quantile_bins_tied", "E8", with_ctes(_body6, "scored", extra=_ctes6), "mean_predicted observed_rate")
def _bins_tied(spark, folder):
    return calibration.quantile_bins(scored(spark, folder), "toxic", "b", 6)


@query(
    "reliability",
    "E9",
    with_ctes(
        """SELECT (i * (1.0::DOUBLE / 10) + CASE WHEN i = 9 THEN 1.0 ELSE (i + 1) * (1.0::DOUBLE / 10) END) / 2.0 AS bin_midpoint, o AS observed_rate, p AS predicted_rate,
        coalesce(c, 0) AS count, (SELECT sum(abs(o - p) * c) / sum(c) FROM bn) AS ece, (SELECT max(abs(o - p)) FROM bn) AS mce
        FROM (SELECT unnest(range(10)) AS i) AS r LEFT JOIN bn ON bn.bin = r.i""",
        "scored",
        extra={
            "ed": "SELECT unnest(range(1, 10)) * (1.0::DOUBLE / 10) AS e",
            "bn": """SELECT bin, avg(y) AS o, avg(a) AS p, count(*) AS c FROM (SELECT y, a, (SELECT count(*) FROM ed WHERE e <= a) AS bin FROM scored) AS x GROUP BY bin""",
        },
    ),
    "bin_midpoint observed_rate predicted_rate ece mce",
)
def _reliability(spark, folder):
    return calibration.reliability(scored(spark, folder), "y", "a", 10)


@query(
    "calibration_slope_linear",
    "E10",
    with_ctes(
        """SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM (SELECT y, ln(c / (1 - c)) AS x FROM (
        SELECT y, least(greatest(a, 1e-15), 1 - 1e-15) AS c FROM scored) AS k) AS l""",
        "scored",
    ),
    "slope intercept",
)
def _slope_linear(spark, folder):
    return calibration.calibration_slope(scored(spark, folder), "y", "a", "linear")


SLOPE_CTES = {
    "nt_rows": """SELECT y, 1.0 AS w, ln(c / (1 - c)) AS x FROM (SELECT y, least(greatest(a, 1e-15), 1 - 1e-15) AS c FROM scored
        WHERE y IS NOT NULL AND a IS NOT NULL) AS k""",
    **newton_ctes("nt_rows", ["x"], 0.0, 12),
}


@query("calibration_slope", "E10", with_ctes("SELECT b1 AS slope, b0 AS intercept FROM nt_b", "scored", extra=SLOPE_CTES), "slope intercept")
def _slope(spark, folder):
    return calibration.calibration_slope(scored(spark, folder), "y", "a")


DELONG_CTES = {
    "p": "SELECT a, b FROM scored WHERE y = 1",
    "n": "SELECT a, b FROM scored WHERE y = 0",
    "sz": "SELECT (SELECT count(*) FROM p) AS m, (SELECT count(*) FROM n) AS k",
    "vp": """SELECT (SELECT sum(CASE WHEN n.a < p.a THEN 1.0 WHEN n.a = p.a THEN 0.5 ELSE 0.0 END) FROM n) / k AS va,
        (SELECT sum(CASE WHEN n.b < p.b THEN 1.0 WHEN n.b = p.b THEN 0.5 ELSE 0.0 END) FROM n) / k AS vb FROM p, sz""",
    "vn": """SELECT (SELECT sum(CASE WHEN p.a > n.a THEN 1.0 WHEN p.a = n.a THEN 0.5 ELSE 0.0 END) FROM p) / m AS va,
        (SELECT sum(CASE WHEN p.b > n.b THEN 1.0 WHEN p.b = n.b THEN 0.5 ELSE 0.0 END) FROM p) / m AS vb FROM n, sz""",
    "res": """SELECT (SELECT avg(va) FROM vp) AS auc_a, (SELECT avg(vb) FROM vp) AS auc_b,
        (SELECT var_samp(va - vb) FROM vp) / m + (SELECT var_samp(va - vb) FROM vn) / k AS variance, m, k AS n FROM sz""",
}


@query(
    "delong_components",
    "E11",
    with_ctes(
        "SELECT auc_a, auc_b, variance, (auc_a - auc_b) / sqrt(variance) AS z, m, n FROM res", "scored", extra=DELONG_CTES
    ),
    "auc_a auc_b variance z",
)
def _delong(spark, folder):
    return comparison.delong_components(scored(spark, folder), "y", "a", "b").drop("p_value")


# The tail by Simpson's rule over 12 units in steps of 1/500.
def _tail_sql(z: str) -> str:
    return f"""(SELECT 2 * sum(CASE WHEN i IN (0, 6000) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END * exp(-(abs({z}) + i * 0.002::DOUBLE) * (abs({z}) + i * 0.002::DOUBLE) / 2))
        * (0.002::DOUBLE / 3) / sqrt(2 * pi()) FROM (SELECT unnest(range(6001)) AS i) AS g)"""


@query(
    "delong_p_value",
    "E12",
    with_ctes(f"SELECT coalesce({_tail_sql('((auc_a - auc_b) / sqrt(variance))')}, 1.0) AS p_value FROM res", "scored", extra=DELONG_CTES),
    "p_value",
)
def _delong_p(spark, folder):
    return comparison.delong_components(scored(spark, folder), "y", "a", "b").select("p_value")


BY_SOURCE_CTES = {
    "held": "SELECT source, y, a, b, row_number() OVER () AS i FROM scored WHERE source IS NOT NULL",
    "placed": """SELECT h.source, h.y, h.i, avg(CASE WHEN o.a = h.a THEN 0.5 WHEN (o.a < h.a) = (h.y = 1) THEN 1.0 ELSE 0.0 END) AS va,
        avg(CASE WHEN o.b = h.b THEN 0.5 WHEN (o.b < h.b) = (h.y = 1) THEN 1.0 ELSE 0.0 END) AS vb
        FROM held h JOIN held o ON o.source = h.source AND o.y = 1 - h.y GROUP BY h.source, h.y, h.i""",
    "sized": "SELECT source, count(*) FILTER (WHERE y = 1) AS m, count(*) FILTER (WHERE y = 0) AS n FROM held GROUP BY source",
    "grouped": """SELECT source, avg(va) FILTER (WHERE y = 1) AS auc_a, avg(vb) FILTER (WHERE y = 1) AS auc_b,
        coalesce(var_samp(va - vb) FILTER (WHERE y = 1), 0.0) AS sp, coalesce(var_samp(va - vb) FILTER (WHERE y = 0), 0.0) AS sn FROM placed GROUP BY source""",
    "zs": "SELECT source, m, n, auc_a, auc_b, CASE WHEN round(sp / m + sn / n, 12) > 0 THEN (auc_a - auc_b) / sqrt(sp / m + sn / n) END AS z FROM sized LEFT JOIN grouped USING (source)",
}


@query(
    "delong_by_source",
    "E11, E12",
    with_ctes(
        f"SELECT source, m, n, auc_a, auc_b, z, CASE WHEN m > 0 AND n > 0 THEN coalesce({_tail_sql('z')}, 1.0) END AS p_value FROM zs",
        "scored", extra=BY_SOURCE_CTES,
    ),
    "auc_a auc_b z p_value",
)
def _delong_by(spark, folder):
    rows = comparison.delong_components(scored(spark, folder), "y", "a", "b", ["source"])
    both = (F.col("m") > 0) & (F.col("n") > 0)
    return rows.select("source", "m", "n", *[F.when(both, F.col(c)).alias(c) for c in ("auc_a", "auc_b", "z")], "p_value")


ISOTONIC_CTES = {
    "pts": "SELECT a AS x, sum(y)::DOUBLE AS s, count(*) AS w, row_number() OVER (ORDER BY a) AS i FROM scored WHERE y IS NOT NULL AND a IS NOT NULL GROUP BY a",
    "upto": "SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw FROM pts",
    "runs": "SELECT f.i AS j, t.i AS k, (t.cs - f.cs + f.s) / (t.cw - f.cw + f.w) AS mean FROM upto f JOIN upto t ON t.i >= f.i",
    "least_mean": "SELECT j, k, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS low FROM runs",
    "fitted": "SELECT k AS i, max(low) AS calibrated FROM least_mean GROUP BY k",
}


@query(
    "isotonic_calibration",
    "R4",
    with_ctes("SELECT x AS score, w AS n, s / w AS observed, calibrated FROM pts JOIN fitted USING (i)", "scored", extra=ISOTONIC_CTES),
    "score observed calibrated",
)
def _isotonic(spark, folder):
    rows = cut_lineage(scored(spark, folder).select("y", "a"))
    points = rows.where("y IS NOT NULL AND a IS NOT NULL").groupBy(F.col("a").alias("score")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("observed"))
    return IsotonicMap().fit(rows, "y", "a").transform(points, "score")


# Published sizes: 1000 draws to compare two models, 200 for an interval.
COMPARED, INTERVAL = 1000, 200
_poisson = " + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in POISSON_ONE_CDF)


def _boot_ctes(draws: int) -> dict[str, str]:
    return {
        "drawn": f"""SELECT y, a, b, replicate, {_poisson} AS w FROM (SELECT y, a, b, replicate, {draw_sql('doc_id', '42 + replicate')} AS u
            FROM scored, (SELECT unnest(range({draws})) AS replicate)) AS d
            UNION ALL SELECT y, a, b, -1, 1 FROM scored""",
        "stacked": "SELECT replicate, 'a' AS model, y, a AS s, w FROM drawn WHERE w > 0 UNION ALL SELECT replicate, 'b', y, b, w FROM drawn WHERE w > 0",
        **metrics_sql("stacked", "y", "s", "replicate, model", weight="w", min_n=1),
        # The metric views name their score column s as well; only keys and sums leave them.
        "df": """SELECT replicate, max(auroc) FILTER (WHERE model = 'a') - max(auroc) FILTER (WHERE model = 'b') AS d,
            max(auprc) FILTER (WHERE model = 'a') AS pa FROM ms GROUP BY replicate""",
        "base": "SELECT d AS delta, pa AS point FROM df WHERE replicate = -1",
        "bt": "SELECT * FROM df WHERE replicate >= 0",
    }


@query(
    "bootstrap_comparison",
    "E13, V6",
    with_ctes(
        """SELECT delta, least(2 * CASE WHEN delta > 0 THEN avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END) ELSE avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0.0 END) END, 1.0) AS p_value,
        quantile_cont(d, 0.025) AS ci_lower, quantile_cont(d, 0.975) AS ci_upper FROM bt, base GROUP BY delta""",
        "scored", extra=_boot_ctes(COMPARED),
    ),
    "delta p_value ci_lower ci_upper",
)
def _bootstrap(spark, folder):
    return comparison.bootstrap_comparison(scored(spark, folder), "y", "a", "b", "auroc", COMPARED, 42, F.col("doc_id"))


@query(
    "bootstrap_interval",
    "E14",
    with_ctes(
        "SELECT point, quantile_cont(pa, 0.025) AS lower, quantile_cont(pa, 0.975) AS upper FROM bt, base GROUP BY point",
        "scored", extra=_boot_ctes(INTERVAL),
    ),
    "point lower upper",
)
def _interval(spark, folder):
    return comparison.bootstrap_interval(scored(spark, folder), "y", "a", "auprc", INTERVAL, 42, key=F.col("doc_id"))


REPORT_CTES = {
    "two": "SELECT source AS cohort, 'length' AS model, y, a AS v FROM scored UNION ALL SELECT source, 'remainder', y, b FROM scored",
    **metrics_sql("two", "y", "v", "cohort, model"),
}


def _reports(spark, folder):
    rows = scored(spark, folder)
    two = rows.select(F.col("source").alias("cohort"), F.lit(0).alias("position"), F.lit("length").alias("model_name"), "y", F.col("a").alias("v")).unionByName(
        rows.select(F.col("source").alias("cohort"), F.lit(1).alias("position"), F.lit("remainder").alias("model_name"), "y", F.col("b").alias("v"))
    )
    wide = discrimination.binary_metrics(two, "y", "v", ["position", "model_name", "cohort"])
    return wide.unpivot(["position", "model_name", "cohort"], ["auroc", "auprc", "brier"], "metric", "value").where("value IS NOT NULL")


@query(
    "model_comparison_table",
    "E15",
    with_ctes("SELECT model AS model_name, cohort, auroc, auprc, brier FROM ms WHERE auroc IS NOT NULL", "scored", extra=REPORT_CTES),
    METRICS,
)
def _compare(spark, folder):
    return comparison.compare_models(_reports(spark, folder), METRICS.split())


@query(
    "best_model_by_cohort",
    "E16",
    with_ctes(
        """SELECT cohort, model AS model_name, auroc AS value FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY auroc DESC, model) AS rn
        FROM ms WHERE auroc IS NOT NULL) AS r WHERE rn = 1""",
        "scored", extra=REPORT_CTES,
    ),
    "value",
)
def _best(spark, folder):
    return comparison.best_model(_reports(spark, folder), "auroc")


@query("model_kind_comparison", "E17, V3, V4, R13, R14")
def _kinds(spark, folder):
    fit_rows, held = _split(spark, folder)
    groups = {"Cognition + clinical": ("age", "education_years", "cognitive_score"), "Blood": ("hba1c_percent", "hs_crp_mg_l")}
    reports = []
    for label, kind in (("Baseline (Logistic)", "logistic"), ("Upgraded (GBM)", "boosted")):
        parts = []
        for group, columns in groups.items():
            model = HazardEnsemble(columns, kind, n_bootstrap=2, n_estimators=3, max_depth=2).fit(fit_rows)
            there = held.where(F.coalesce(*[F.col(c) for c in columns[-2:]]).isNotNull())
            parts.append(model.predict_distribution(there).withColumn("modality", F.lit(group)))
        fused = fusion.batch_risk(fusion.risk_distribution(parts[0].unionByName(parts[1])))
        joined = fused.join(held.select("participant_id", "event_by_3y"), "participant_id")
        metrics = discrimination.binary_metrics(joined, "event_by_3y", "risk_3y")
        reports.append(metrics.select(F.lit(label).alias("model"), *discrimination.METRICS))
    return reports[0].unionByName(reports[1])


# --- uncertainty ---------------------------------------------------------------

HIGHER_CTES = {
    **CENTROID,
    "rs": "SELECT participant_id, role, event_by_3y, risk, abs(event_by_3y - risk) AS r FROM cr",
    "cal": "SELECT r, row_number() OVER (ORDER BY r) - 1 AS place, count(*) OVER () AS n FROM rs WHERE role = 'public_validation'",
    "wd": "SELECT max(r) AS w FROM cal WHERE place = ceil(round(least(ceil((n + 1) * CAST(0.9 AS DOUBLE)) / n, 1.0) * (n - 1), 9))",
}


def _risk_rows(spark, folder):
    fit_rows, held = _split(spark, folder)
    scored_rows = risk.CentroidRisk(FEATURES).fit(fit_rows, TARGET).predict_risk(held)
    return scored_rows.select("participant_id", "role", TARGET, "risk")


def _intervals(spark, folder):
    rows = _risk_rows(spark, folder)
    calibration_rows = rows.where(F.col("role") == "public_validation").select(F.abs(F.col(TARGET) - F.col("risk")).alias("residual"))
    return uncertainty.conformal_interval(rows, calibration_rows, "risk")


@query(
    "conformal_intervals",
    "X1, X2",
    with_ctes(
        "SELECT participant_id, risk, risk - w AS lower, risk + w AS upper FROM rs, wd", "train", "validation", extra=HIGHER_CTES
    ),
    "risk lower upper",
)
def _conformal(spark, folder):
    return _intervals(spark, folder).select("participant_id", "risk", "lower", "upper")


@query(
    "conformal_coverage",
    "X2",
    with_ctes(
        "SELECT avg(CASE WHEN event_by_3y >= risk - w AND event_by_3y <= risk + w THEN 1.0 ELSE 0.0 END) AS coverage FROM rs, wd WHERE role <> 'public_validation'",
        "train", "validation", extra=HIGHER_CTES,
    ),
    "coverage",
)
def _coverage(spark, folder):
    rows = _intervals(spark, folder).where(F.col("role") != "public_validation")
    return uncertainty.coverage(rows, TARGET)


@query(
    "ood_score",
    "X3",
    with_ctes(
        """SELECT participant_id, sqrt((d * x * x - 2 * b * x * y + a * y * y) / (a * d - b * b)) AS ood_score FROM (
        SELECT v.participant_id, v.age - mx AS x, v.education_years - my AS y, a, b, d FROM validation v,
          (SELECT avg(age) AS mx, avg(education_years) AS my, var_samp(age) AS a, covar_samp(age, education_years) AS b, var_samp(education_years) AS d FROM train) AS t) AS k""",
        "train", "validation",
    ),
    "ood_score",
)
def _ood(spark, folder):
    fit_rows, held = _split(spark, folder)
    return uncertainty.ood_score(held, fit_rows, ["age", "education_years"]).select("participant_id", "ood_score")
