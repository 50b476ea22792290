"""Time-to-event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.newton_sql import newton_ctes
from driver_queries.registry import query
from driver_queries.views import draw_sql, hazards, metrics_sql, participants, survival, validation, with_ctes
from driver_queries.modelling import FEATURES, _split
from longspan.functions.columns import POISSON_ONE_CDF, clip
from longspan.operators import survival as sv
from longspan.operators import survival_metrics as sm
from longspan.operators.cox import CoxBoost, CoxRegression
from longspan.operators.resampling import replicate_totals
from longspan.operators.risk import CentroidRisk
from longspan.session import cut_lineage

EVAL_TIMES = (365.0, 730.0, 1096.0, 1826.0)
TIMES_SQL = "(SELECT unnest([365.0::DOUBLE, 730.0, 1096.0, 1826.0]) AS eval_time) AS g"

# A risk score with ties: age in whole years plus education.
RISK_SQL = """SELECT s.*, round((p.age - 50.0) / 2.0) / 20.0 - p.education_years / 100.0 AS risk,
    least(greatest((p.age - 50.0) / 40.0 * 0.2 + 0.02, 0.0), 1.0) AS yearly
    FROM survival s JOIN participants p ON s.participant_id = p.participant_id"""


def _risk_rows(spark, folder):
    people = participants(spark, folder).select(
        "participant_id",
        (F.round((F.col("age") - 50.0) / 2.0) / 20.0 - F.col("education_years") / 100.0).alias("risk"),
        clip((F.col("age") - 50.0) / 40.0 * 0.2 + 0.02, 0.0, 1.0).alias("yearly"),
    )
    return survival(spark, folder).join(people, "participant_id")


def _km_ctes(source: str, by: str = "", reverse: bool = False, prefix: str = "km") -> dict[str, str]:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    factor = (
        "CASE WHEN at_risk - events > 0 THEN 1.0 - CAST(censored AS DOUBLE) / (at_risk - events) ELSE 1.0 END"
        if reverse
        else "1.0 - CAST(events AS DOUBLE) / at_risk"
    )
    return {
        f"{prefix}_c": f"SELECT {keys}event_time_days AS time, count(*) AS n, sum(event) AS events, sum(1 - event) AS censored FROM {source} GROUP BY {keys}event_time_days",
        f"{prefix}_r": f"SELECT *, sum(n) OVER ({part} ORDER BY time DESC) AS at_risk FROM {prefix}_c",
        prefix: f"SELECT *, product({factor}) OVER ({part} ORDER BY time) AS survival FROM {prefix}_r",
    }


@query(
    "kaplan_meier",
    "V1",
    with_ctes(
        "SELECT time, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events, CAST(censored AS BIGINT) AS censored, survival FROM km",
        "survival", extra=_km_ctes("survival"),
    ),
    "survival",
)
def _km(spark, folder):
    return sv.kaplan_meier(survival(spark, folder))


@query(
    "kaplan_meier_by_cohort",
    "V1",
    with_ctes(
        "SELECT cohort, time, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events, CAST(censored AS BIGINT) AS censored, survival FROM km",
        "survival", extra=_km_ctes("survival", "cohort"),
    ),
    "survival",
)
def _km_by(spark, folder):
    return sv.kaplan_meier(survival(spark, folder), by=["cohort"])


@query(
    "censoring_distribution",
    "V15, V17",
    with_ctes("SELECT time, survival FROM km", "survival", extra=_km_ctes("survival", reverse=True)),
    "survival",
)
def _censoring(spark, folder):
    return sv.kaplan_meier(survival(spark, folder), reverse=True).select("time", "survival")


@query("event_times", "V11", with_ctes("SELECT DISTINCT event_time_days AS time FROM survival WHERE event = 1", "survival"))
def _event_times(spark, folder):
    return sv.event_times(survival(spark, folder))


PERSON_PERIOD_SQL = """SELECT participant_id, cohort, event, event_time_days, CAST(year AS DOUBLE) AS interval_year,
    CASE WHEN event = 1 AND event_time_days <= year * 365.25 THEN 1 ELSE 0 END AS interval_event
    FROM survival, (SELECT unnest(range(1, 6)) AS year) WHERE event_time_days > (year - 1) * 365.25"""


@query("person_period", "V2", with_ctes(PERSON_PERIOD_SQL, "survival"), "interval_year")
def _person_period(spark, folder):
    return sv.person_period(survival(spark, folder).drop("participant_key"))


@query(
    "cumulative_risk",
    "V5",
    with_ctes("SELECT participant_id, modality, replicate, horizon, risk FROM scores", "scores"),
    "risk",
)
def _cumulative(spark, folder):
    return sv.cumulative_risk(hazards(validation(spark, folder)), ("participant_id", "modality", "replicate"))


CURVE_GRID = (100.0, 365.25, 800.0, 1461.0, 2500.0)


@query(
    "survival_curve",
    "V10",
    with_ctes(
        """SELECT participant_id, modality, replicate, time, coalesce(product(1 - least(greatest(hazard, 0.001), 0.95))
          FILTER (WHERE interval_year * 365.25 <= time), 1.0) AS survival
        FROM hazards, (SELECT unnest([100.0::DOUBLE, 365.25, 800.0, 1461.0, 2500.0]) AS time) GROUP BY participant_id, modality, replicate, time""",
        "hazards",
    ),
    "survival time",
)
def _curve(spark, folder):
    keys = ("participant_id", "modality", "replicate")
    yearly = sv.cumulative_risk(hazards(validation(spark, folder)), keys, keep_survival=True)
    return sv.survival_at(yearly, CURVE_GRID, keys)


@query(
    "power_survival",
    "V9, V10",
    with_ctes(
        "SELECT participant_id, time, least(greatest(pow(1 - yearly, time / 365.25), 0), 1) AS survival FROM rr, (SELECT unnest([365.25::DOUBLE, 1095.75, 1826.25]) AS time)",
        "survival", extra={"rr": RISK_SQL},
    ),
    "survival time",
)
def _power(spark, folder):
    return sv.power_survival(_risk_rows(spark, folder), [365.25, 1095.75, 1826.25], risk="yearly")


@query(
    "early_event_label",
    "V9",
    with_ctes(
        """SELECT cohort, sum(CASE WHEN event = 1 AND event_time_days <= (SELECT quantile_cont(event_time_days, 0.5) FROM survival) THEN 1 ELSE 0 END) AS early, count(*) AS n
        FROM survival GROUP BY cohort""",
        "survival",
    ),
)
def _early(spark, folder):
    rows = sv.early_event_label(survival(spark, folder))
    return rows.groupBy("cohort").agg(F.sum("early_event").alias("early"), F.count(F.lit(1)).alias("n"))


_poisson = " + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in POISSON_ONE_CDF)


WEIGHT_DRAWS = 1000


@query(
    "bootstrap_weights",
    "V6",
    with_ctes(
        f"""SELECT replicate, count(*) AS participants, sum(weight) AS weight, sum(weight * event) AS weighted_events FROM (
        SELECT event, replicate, {_poisson} AS weight FROM (SELECT event, replicate, {draw_sql('participant_key', '42 + replicate')} AS u
        FROM survival, (SELECT unnest(range({WEIGHT_DRAWS})) AS replicate)) AS d) AS w WHERE weight > 0 GROUP BY replicate""",
        "survival",
    ),
)
def _weights(spark, folder):
    totals = replicate_totals(survival(spark, folder), ["event"], WEIGHT_DRAWS)
    rows = [(b, *(int(v) for v in row)) for b, row in enumerate(totals)]
    return spark.createDataFrame(rows, "replicate int, participants long, weight long, weighted_events long")


# --- models --------------------------------------------------------------------


_HZ = [*FEATURES, "interval_year"]
HAZARD_CTES = {
    "hz_pp": f"""SELECT participant_key, {', '.join(FEATURES)}, CAST(year AS DOUBLE) AS interval_year,
        CASE WHEN event = 1 AND event_time_days <= year * 365.25 THEN 1 ELSE 0 END AS y
        FROM train, (SELECT unnest(range(1, 6)) AS year) WHERE event_time_days > (year - 1) * 365.25 AND coalesce({', '.join(FEATURES)}) IS NOT NULL""",
    "hz_med": "SELECT " + ", ".join(f"quantile_cont({f}, 0.5) AS md_{f}" for f in _HZ) + " FROM hz_pp",
    "hz_filled": "SELECT participant_key, y, " + ", ".join(f"coalesce({f}, md_{f}) AS {f}" for f in _HZ) + " FROM hz_pp, hz_med",
    "hz_st": "SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in _HZ) + " FROM hz_filled",
    "hz_drawn": f"""SELECT replicate, y, {_poisson} AS d, {', '.join(f'({f} - m_{f}) / s_{f} AS {f}' for f in _HZ)}
        FROM (SELECT *, {draw_sql('participant_key', '42 + replicate')} AS u FROM hz_filled, (SELECT unnest(range(12)) AS replicate)) AS e, hz_st""",
    "hz_rows": f"""SELECT replicate, y, d * CASE WHEN y = 1 THEN n / (2.0 * pos) ELSE n / (2.0 * (n - pos)) END AS w, {', '.join(_HZ)}
        FROM hz_drawn JOIN (SELECT replicate, sum(d) AS n, sum(d * y) AS pos FROM hz_drawn GROUP BY replicate) AS t USING (replicate) WHERE d > 0""",
    **newton_ctes("hz_rows", _HZ, 1.0, 9, "replicate"),
    "hz_hazard": f"""SELECT participant_id, replicate, g.year, least(greatest(1 / (1 + exp(-(b0 + {' + '.join(f'b{i + 1} * (coalesce({f}, md_{f}) - m_{f}) / s_{f}' for i, f in enumerate(FEATURES))}
        + b{len(_HZ)} * (g.year - m_interval_year) / s_interval_year))), 0.001), 0.95) AS hazard FROM validation, hz_med, hz_st, nt_b, (SELECT unnest(range(1, 6)) AS year) AS g""",
}


@query(
    "hazard_logistic",
    "V3, V5",
    with_ctes(
        """SELECT participant_id, CAST(replicate AS INTEGER) AS replicate, h AS horizon, least(greatest(1 - product(1 - hazard) FILTER (WHERE year <= h), 0), 1) AS risk
        FROM hz_hazard, (SELECT unnest([1, 3, 5]) AS h) GROUP BY participant_id, replicate, h""",
        "train", "validation", extra=HAZARD_CTES,
    ),
    "risk",
)
def _hazard_logistic(spark, folder):
    fit_rows, held = _split(spark, folder)
    return sv.HazardEnsemble(FEATURES, "logistic", draw_key="participant_key").fit(fit_rows).predict_distribution(held)


@query("hazard_boosted", "V4, V5")
def _hazard_boosted(spark, folder):
    fit_rows, held = _split(spark, folder)
    model = sv.HazardEnsemble(FEATURES, "boosted", together=True)
    return model.fit(fit_rows).predict_distribution(held)


@query("hazard_forest_curve", "V7, V10")
def _hazard_forest(spark, folder):
    fit_rows, held = _split(spark, folder)
    return sv.survival_forest(FEATURES).fit(fit_rows).survival_function(held)


@query("boosted_survival_risk", "V8")
def _boosted_survival(spark, folder):
    fit_rows, held = _split(spark, folder)
    sv.check_survival_input(fit_rows, FEATURES)
    return sv.boosted_survival(FEATURES).fit(fit_rows).risk_scores(held)


COX_STEPS = 7
COX_X = "(p.age - 70.0) / 10.0"
COX_CTES = {
    "cx_rows": f"SELECT s.participant_id, s.event_time_days AS t, s.event AS e, {COX_X} AS x FROM survival s JOIN participants p ON s.participant_id = p.participant_id",
    "cx_b0": "SELECT 0.0::DOUBLE AS b",
}
for _k in range(1, COX_STEPS + 1):
    COX_CTES[f"cx_t{_k}"] = f"""SELECT t, any_value(b) AS b, sum(e) AS d, sum(e * x) AS dx, sum(exp(b * x)) AS r, sum(x * exp(b * x)) AS rx, sum(x * x * exp(b * x)) AS rxx
        FROM cx_rows, cx_b{_k - 1} GROUP BY t"""
    COX_CTES[f"cx_r{_k}"] = f"""SELECT b, d, dx, sum(r) OVER w AS s, sum(rx) OVER w AS sx, sum(rxx) OVER w AS sxx FROM cx_t{_k} WINDOW w AS (ORDER BY t DESC)"""
    COX_CTES[f"cx_b{_k}"] = f"SELECT any_value(b) + sum(dx - d * sx / s) / sum(d * (sxx / s - (sx / s) * (sx / s))) AS b FROM cx_r{_k}"
COX_CTES |= {
    "cx_base": f"""SELECT t, d, sum(CASE WHEN d > 0 THEN d / s ELSE 0.0 END) OVER (ORDER BY t) AS h FROM (
        SELECT t, d, sum(r) OVER (ORDER BY t DESC) AS s FROM (SELECT t, sum(e) AS d, sum(exp(b * x)) AS r FROM cx_rows, cx_b{COX_STEPS} GROUP BY t) AS c) AS k""",
    "cx_grid": """SELECT g AS time, coalesce(max(h) FILTER (WHERE t <= g), 0.0) AS h FROM cx_base, (SELECT unnest([200.0::DOUBLE, 365.25, 1095.75, 1826.25]) AS g) GROUP BY g""",
}


def _cox(spark, folder):
    """All participants with one covariate, and the fitted model."""
    people = participants(spark, folder).select("participant_id", ((F.col("age") - 70.0) / 10.0).alias("decades"))
    rows = cut_lineage(survival(spark, folder).join(people, "participant_id"))
    return rows, CoxRegression(["decades"], standardise=False).fit(rows)


@query(
    "cox_slope",
    "V8",
    with_ctes(
        f"""SELECT any_value(b) AS slope, sum(dx * b - d * ln(s)) AS log_likelihood FROM (SELECT b, d, dx, sum(r) OVER (ORDER BY t DESC) AS s
        FROM (SELECT t, any_value(b) AS b, sum(e) AS d, sum(e * x) AS dx, sum(exp(b * x)) AS r FROM cx_rows, cx_b{COX_STEPS} GROUP BY t) AS c) AS k WHERE d > 0""",
        "survival", extra=COX_CTES,
    ),
    "slope log_likelihood",
)
def _cox_slope(spark, folder):
    _, model = _cox(spark, folder)
    return spark.createDataFrame([(model.coefficients["decades"], model.log_likelihood)], "slope double, log_likelihood double")


@query(
    "cox_baseline_hazard",
    "V8, V11",
    with_ctes("SELECT t::DOUBLE AS time, d::BIGINT AS events, h AS cumulative_hazard FROM cx_base WHERE d > 0", "survival", extra=COX_CTES),
    "time cumulative_hazard",
)
def _cox_baseline(spark, folder):
    _, model = _cox(spark, folder)
    return model.baseline.where("events > 0").select("time", F.col("events").cast("long").alias("events"), "cumulative_hazard")


@query(
    "cox_survival_curve",
    "V8, V10",
    with_ctes(
        f"SELECT participant_id, time, exp(-h * exp(b * x)) AS survival FROM cx_rows, cx_b{COX_STEPS}, cx_grid", "survival", extra=COX_CTES
    ),
    "time survival",
)
def _cox_curve(spark, folder):
    rows, model = _cox(spark, folder)
    return model.survival_function(rows, [200.0, 365.25, 1095.75, 1826.25])


@query("cox_regression_risk", "V8, V10")
def _cox_regression(spark, folder):
    fit_rows, held = _split(spark, folder)
    return CoxRegression(FEATURES).fit(fit_rows).risk_scores(held)


# Published size of the boosted Cox model.
COX_BOOST = {"n_estimators": 300, "learning_rate": 0.05, "max_depth": 4, "subsample": 0.8}


@query("cox_boosted_risk", "V8")
def _cox_boosted(spark, folder):
    fit_rows, held = _split(spark, folder)
    sv.check_survival_input(fit_rows, FEATURES)
    return CoxBoost(FEATURES, **COX_BOOST).fit(fit_rows).risk_scores(held)


@query("parametric_survival_risk", "V8")
def _parametric(spark, folder):
    fit_rows, held = _split(spark, folder)
    return sv.ParametricSurvival(FEATURES).fit(fit_rows).risk_scores(held)


@query("early_event_hazard_curve", "V9")
def _early_hazard(spark, folder):
    fit_rows, held = _split(spark, folder)
    return sv.EarlyEventHazard(FEATURES).fit(fit_rows).survival_function(held)


@query("permutation_importance", "V13")
def _permutation(spark, folder):
    fit_rows, held = _split(spark, folder)
    columns = ("age", "education_years")
    model = CentroidRisk(columns).fit(fit_rows, "event_by_3y")
    rows = held.select("participant_id", "event", "event_time_days", *columns)
    return sv.permutation_importance(rows, columns, model.predict_risk, n_repeats=3)


# --- evaluation ------------------------------------------------------------------

CINDEX_SQL = """SELECT {keys}CASE WHEN count(*) FILTER (WHERE a.event_time_days < b.event_time_days) > 0 THEN
    sum(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END) / count(*) ELSE 0.5 END AS c_index,
    sum(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END) AS concordant, CAST(count(*) AS DOUBLE) AS permissible
    FROM rr a JOIN rr b ON a.event = 1 AND a.event_time_days < b.event_time_days {cond}"""


@query(
    "concordance_index",
    "V12",
    with_ctes(CINDEX_SQL.format(keys="", cond=""), "survival", extra={"rr": RISK_SQL}),
    "c_index concordant permissible",
)
def _cindex(spark, folder):
    return sm.concordance_index(_risk_rows(spark, folder))


@query(
    "concordance_by_cohort",
    "V12",
    with_ctes(
        CINDEX_SQL.format(keys="a.cohort, ", cond="AND a.cohort = b.cohort GROUP BY a.cohort"), "survival", extra={"rr": RISK_SQL}
    ),
    "c_index concordant permissible",
)
def _cindex_by(spark, folder):
    return sm.concordance_index(_risk_rows(spark, folder), by=["cohort"])


AT_TIMES = f"""SELECT rr.*, eval_time, CASE WHEN event = 1 AND event_time_days <= eval_time THEN 1 ELSE 0 END AS is_case
    FROM rr, {TIMES_SQL} WHERE event_time_days > eval_time OR event = 1"""


@query(
    "time_dependent_auc",
    "V14",
    with_ctes(
        "SELECT eval_time, auroc, n FROM ms",
        "survival", extra={"rr": RISK_SQL, "timed": AT_TIMES, **metrics_sql("timed", "is_case", "risk", "eval_time", min_n=2)},
    ),
    "auroc n",
)
def _td_auc(spark, folder):
    return sm.time_dependent_auc(_risk_rows(spark, folder), EVAL_TIMES)


@query(
    "mean_time_dependent_auc",
    "V14",
    with_ctes(
        "SELECT avg(auroc) AS mean_auc FROM ms",
        "survival", extra={"rr": RISK_SQL, "timed": AT_TIMES, **metrics_sql("timed", "is_case", "risk", "eval_time", min_n=2)},
    ),
    "mean_auc",
)
def _mean_auc(spark, folder):
    return sm.mean_auc(sm.time_dependent_auc(_risk_rows(spark, folder), EVAL_TIMES))


IPCW_CTES = {
    "rr": RISK_SQL,
    **_km_ctes("survival", reverse=True, prefix="g"),
    "weighted": f"""SELECT eval_time, risk, CASE WHEN event = 1 AND event_time_days <= eval_time THEN 1.0 / g.survival ELSE 0.0 END AS w,
        CASE WHEN event_time_days > eval_time THEN 1.0 ELSE 0.0 END AS ctl
        FROM rr JOIN g ON rr.event_time_days = g.time, (SELECT unnest([365.0::DOUBLE, 730.0, 1096.0, 1826.0]) AS eval_time) AS t
        WHERE (event = 1 AND event_time_days <= eval_time) OR event_time_days > eval_time""",
    "points": "SELECT eval_time, risk, sum(w) AS w, sum(ctl) AS ctl FROM weighted GROUP BY eval_time, risk",
    "ranked_points": "SELECT *, sum(ctl) OVER (PARTITION BY eval_time ORDER BY risk) AS upto FROM points",
    "aucs": "SELECT eval_time, sum(w * (upto - ctl / 2.0)) / (sum(w) * sum(ctl)) AS auc FROM ranked_points GROUP BY eval_time",
}


@query("ipcw_auc", "V15", with_ctes("SELECT * FROM aucs", "survival", extra=IPCW_CTES), "auc")
def _ipcw_auc(spark, folder):
    return sm.ipcw_auc(_risk_rows(spark, folder), EVAL_TIMES)


@query(
    "ipcw_mean_auc",
    "V15",
    with_ctes(
        "SELECT sum(auc * (prev - s)) / (1.0 - min(s)) AS mean_auc FROM (SELECT a.eval_time, auc, s, lag(s, 1, 1.0::DOUBLE) OVER (ORDER BY a.eval_time) AS prev FROM aucs a JOIN surv_at v ON a.eval_time = v.eval_time) AS x",
        "survival",
        extra={
            **IPCW_CTES, **_km_ctes("survival"),
            "surv_at": f"SELECT eval_time, coalesce(min(survival) FILTER (WHERE time <= eval_time), 1.0) AS s FROM km, {TIMES_SQL} GROUP BY eval_time",
        },
    ),
    "mean_auc",
)
def _ipcw_mean(spark, folder):
    return sm.ipcw_mean_auc(_risk_rows(spark, folder), EVAL_TIMES)


def _long_curve(spark, folder):
    rows = _risk_rows(spark, folder)
    curve = sv.power_survival(rows, EVAL_TIMES, risk="yearly").withColumnRenamed("time", "eval_time")
    return rows, curve.join(rows.select("participant_id", "event", "event_time_days"), "participant_id")


CURVE_SQL = f"SELECT rr.*, eval_time, pow(1 - yearly, eval_time / 365.25) AS s FROM rr, {TIMES_SQL}"
TRAPEZOID_SQL = """SELECT sum(step) / (1826.0 - 365.0) AS integrated_brier FROM (SELECT (eval_time - lag(eval_time) OVER (ORDER BY eval_time))
    * (brier + lag(brier) OVER (ORDER BY eval_time)) / 2.0 AS step FROM bs) AS x"""


@query(
    "integrated_brier",
    "V16",
    with_ctes(
        TRAPEZOID_SQL, "survival",
        extra={
            "rr": RISK_SQL, "cv": CURVE_SQL,
            "bs": """SELECT eval_time, avg(pow(c - (1 - s), 2)) AS brier FROM (SELECT eval_time, s, CASE WHEN event = 1 AND event_time_days <= eval_time THEN 1.0 ELSE 0.0 END AS c
                FROM cv WHERE event_time_days > eval_time OR event = 1) AS x GROUP BY eval_time HAVING min(c) < max(c)""",
        },
    ),
    "integrated_brier",
)
def _brier(spark, folder):
    _, curve = _long_curve(spark, folder)
    return sm.integrated_brier(curve, EVAL_TIMES)


@query(
    "ipcw_integrated_brier",
    "V17",
    with_ctes(
        TRAPEZOID_SQL, "survival",
        extra={
            "rr": RISK_SQL, "cv": CURVE_SQL, **_km_ctes("survival", reverse=True, prefix="g"),
            "ge": f"SELECT eval_time, coalesce(min(survival) FILTER (WHERE time <= eval_time), 1.0) AS g_eval FROM g, {TIMES_SQL} GROUP BY eval_time",
            "bs": """SELECT cv.eval_time, avg(CASE WHEN event = 1 AND event_time_days <= cv.eval_time THEN s * s / g.survival
                WHEN event_time_days > cv.eval_time THEN (1 - s) * (1 - s) / g_eval ELSE 0.0 END) AS brier
                FROM cv JOIN g ON cv.event_time_days = g.time JOIN ge ON cv.eval_time = ge.eval_time GROUP BY cv.eval_time""",
        },
    ),
    "integrated_brier",
)
def _ipcw_brier(spark, folder):
    rows, curve = _long_curve(spark, folder)
    return sm.ipcw_integrated_brier(curve, rows, EVAL_TIMES)
