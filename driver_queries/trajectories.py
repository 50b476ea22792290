"""Longitudinal regression, interpolation and forecast-band queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.registry import query
from driver_queries.views import baseline_with_role, series, table, trajectories, with_ctes
from longspan.operators import trajectory as tr
from longspan.operators.checks import TRAIN_ROLES
from longspan.operators.mixed import MixedModel
from longspan.session import cut_lineage

PAIR_FEATURES = ("age", "education_years")


def _pairs(spark, folder):
    """(train pairs, validation pairs outside the held-out cohort)."""
    people = cut_lineage(baseline_with_role(spark, folder).select("participant_id", "role", "cognitive_score", *PAIR_FEATURES))
    t = trajectories(spark, folder)
    fit = tr.training_pairs(t, people.where(F.col("role").isin(*TRAIN_ROLES)), [*PAIR_FEATURES, "cognitive_score"])
    held = tr.training_pairs(
        t, people.where(F.col("role").isin("public_validation", "india_validation")), [*PAIR_FEATURES, "cognitive_score"]
    )
    return fit, held


PAIRS_SQL = """SELECT t.participant_id, t.year AS horizon_years, t.cognitive_score AS future_score, b.age, b.education_years,
    b.cognitive_score, b.role FROM trajectories t JOIN staffed b ON t.participant_id = b.participant_id WHERE t.year > 0"""


@query(
    "training_pairs",
    "T2",
    with_ctes(
        "SELECT * EXCLUDE (role) FROM pairs WHERE role IN ('global_train', 'tlsa_adaptation')",
        "trajectories", "staffed", extra={"pairs": PAIRS_SQL},
    ),
    "horizon_years future_score age education_years cognitive_score",
)
def _training_pairs(spark, folder):
    return _pairs(spark, folder)[0]


# One-feature ridge in closed form: z has mean 0 and mean square 1, so slope = sum(z y) / (n + 1).
RIDGE_CTES = {
    "pairs": PAIRS_SQL,
    "fitp": "SELECT * FROM pairs WHERE role IN ('global_train', 'tlsa_adaptation')",
    "st": "SELECT avg(horizon_years) AS m, stddev_pop(horizon_years) AS s, avg(future_score) AS my, count(*) AS n FROM fitp",
    "co": "SELECT m, s, my, sum((horizon_years - m) / s * future_score) / (max(n) + 1.0) AS b FROM fitp, st GROUP BY m, s, my",
    "pr": "SELECT p.*, my + b * (horizon_years - m) / s AS prediction FROM pairs p, co",
}


@query(
    "ridge_trajectory",
    "T1",
    with_ctes(
        "SELECT participant_id, horizon_years, prediction FROM pr WHERE role IN ('public_validation', 'india_validation')",
        "trajectories", "staffed", extra=RIDGE_CTES,
    ),
    "horizon_years prediction",
)
def _ridge(spark, folder):
    fit, held = _pairs(spark, folder)
    model = tr.RidgeTrajectory(["horizon_years"]).fit(fit)
    return model.predict(held, "prediction").select("participant_id", "horizon_years", "prediction")


@query("ridge_trajectory_full", "T1")
def _ridge_full(spark, folder):
    fit, held = _pairs(spark, folder)
    model = tr.RidgeTrajectory([*PAIR_FEATURES, "cognitive_score", "horizon_years"]).fit(fit)
    return model.predict(held, "prediction").select("participant_id", "horizon_years", "prediction")


@query(
    "residual_band",
    "T3",
    with_ctes(
        "SELECT greatest(0.75, quantile_cont(abs(future_score - prediction), 0.8)) AS band FROM pr WHERE role IN ('public_validation', 'india_validation')",
        "trajectories", "staffed", extra=RIDGE_CTES,
    ),
    "band",
)
def _band(spark, folder):
    fit, held = _pairs(spark, folder)
    return tr.residual_band(held, tr.RidgeTrajectory(["horizon_years"]).fit(fit))


OWN_SQL = {
    "own": """SELECT participant_id, regr_sxy(cognitive_score, year) / (regr_sxx(cognitive_score, year) + 1.0) AS slope,
        avg(cognitive_score) AS my, avg(year) AS mx FROM trajectories GROUP BY participant_id""",
    "pool": """SELECT regr_sxy(cognitive_score, year) / (regr_sxx(cognitive_score, year) + 1.0) AS slope,
        avg(cognitive_score) AS my, avg(year) AS mx FROM trajectories""",
}


@query(
    "participant_ridge",
    "T4, T5",
    with_ctes(
        """SELECT c.c_custkey AS participant_key, g.year AS horizon_years,
        coalesce(o.my + o.slope * (g.year - o.mx), p.my + p.slope * (g.year - p.mx)) AS prediction
        FROM customer c CROSS JOIN (SELECT unnest([1.0::DOUBLE, 3.0, 5.0]) AS year) AS g CROSS JOIN pool p
        LEFT JOIN own o ON o.participant_id = CAST(c.c_custkey AS VARCHAR)""",
        "trajectories", extra=OWN_SQL,
    ),
    "horizon_years prediction",
)
def _participant_ridge(spark, folder):
    rows = trajectories(spark, folder).select(
        "participant_id", F.col("year").alias("horizon_years"), F.col("cognitive_score").alias("future_score")
    )
    model = tr.ParticipantRidge("horizon_years")
    asked = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("participant_key"),
        F.col("c_custkey").cast("string").alias("participant_id"),
        F.explode(F.array(F.lit(1.0), F.lit(3.0), F.lit(5.0))).alias("horizon_years"),
    )
    done = model.predict(asked, model.fit(rows), model.fit_pooled(rows), "prediction")
    return done.select("participant_key", "horizon_years", "prediction")


_TWO = """SELECT {keys}count(*) * covar_pop(year, visit_index) AS b, count(*) * var_pop(year) + 1.0 AS a, count(*) * var_pop(visit_index) + 1.0 AS d,
    count(*) * covar_pop(year, cognitive_score) AS u, count(*) * covar_pop(visit_index, cognitive_score) AS v, avg(year) AS m0, avg(visit_index) AS m1, avg(cognitive_score) AS my
    FROM trajectories {group}"""
_SOLVED = "SELECT *, (u * d - v * b) / (a * d - b * b) AS w0, (v * a - u * b) / (a * d - b * b) AS w1 FROM ({sums}) AS s"
TWO_SQL = {
    "own2": _SOLVED.format(sums=_TWO.format(keys="participant_id, ", group="GROUP BY participant_id")),
    "pool2": _SOLVED.format(sums=_TWO.format(keys="", group="")),
}


@query(
    "participant_ridge_two",
    "T4, T5",
    with_ctes(
        """SELECT c.c_custkey AS participant_key, g.year AS horizon_years,
        coalesce(o.my + o.w0 * (g.year - o.m0) + o.w1 * (g.i - o.m1), p.my + p.w0 * (g.year - p.m0) + p.w1 * (g.i - p.m1)) AS prediction
        FROM customer c CROSS JOIN (SELECT * FROM (VALUES (1.0::DOUBLE, 2), (3.0, 5), (5.0, 9)) AS v(year, i)) AS g CROSS JOIN pool2 p
        LEFT JOIN own2 o ON o.participant_id = CAST(c.c_custkey AS VARCHAR)""",
        "trajectories", extra=TWO_SQL,
    ),
    "horizon_years prediction",
)
def _participant_ridge_two(spark, folder):
    rows = trajectories(spark, folder).select(
        "participant_id", F.col("year").alias("horizon_years"), "visit_index", F.col("cognitive_score").alias("future_score")
    )
    model = tr.ParticipantRidgeMany(["horizon_years", "visit_index"])
    asked = F.explode(F.array(*[F.struct(F.lit(y).alias("horizon_years"), F.lit(i).alias("visit_index")) for y, i in ((1.0, 2), (3.0, 5), (5.0, 9))]))
    people = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("participant_key"), F.col("c_custkey").cast("string").alias("participant_id"), asked.alias("g")
    ).select("participant_key", "participant_id", "g.*")
    done = model.predict(people, model.fit(rows), model.fit_pooled(rows), "prediction")
    return done.select("participant_key", "horizon_years", "prediction")


@query("mixed_effects", "T6, T7")
def _mixed(spark, folder):
    rows = trajectories(spark, folder).select("participant_id", F.col("year").alias("horizon_years"), F.col("cognitive_score").alias("future_score"))
    model = MixedModel(["horizon_years"], max_iterations=100).fit(rows)
    people = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("participant_id"))
    return model.person_effects(people)


EFFECTS_SQL = {
    "per": """SELECT participant_id, count(*) AS n, regr_sxx(cognitive_score, year) AS sxx, regr_sxy(cognitive_score, year) AS sxy,
        regr_syy(cognitive_score, year) AS syy, avg(year) AS mx, avg(cognitive_score) AS my FROM trajectories GROUP BY participant_id""",
    "ols": """SELECT *, CASE WHEN n >= 3 AND sxx > 0 THEN sxy / sxx END AS b1,
        CASE WHEN n >= 3 AND sxx > 0 THEN my - sxy / sxx * mx END AS b0,
        CASE WHEN n >= 3 AND sxx > 0 THEN greatest(syy - sxy / sxx * sxy, 0) END AS rss FROM per""",
    "pv": "SELECT sum(rss) / sum(CASE WHEN rss IS NOT NULL THEN n - 2 END) AS v FROM ols",
    "smp": """SELECT ols.*, CASE WHEN b1 IS NOT NULL THEN v / sxx END AS s1,
        CASE WHEN b1 IS NOT NULL THEN v * (1.0 / n + mx * mx / sxx) END AS s0 FROM ols, pv""",
    "mom": """SELECT avg(b1) AS m1, avg(b0) AS m0, greatest(0.0, var_samp(b1) - avg(s1)) AS t1, greatest(0.0, var_samp(b0) - avg(s0)) AS t0 FROM smp""",
    "re": """SELECT participant_id, n, coalesce(m0 + coalesce(t0 / (t0 + s0), 0) * (b0 - m0), m0) AS intercept,
        coalesce(m1 + coalesce(t1 / (t1 + s1), 0) * (b1 - m1), m1) AS slope, m0, m1 FROM smp, mom""",
}


def _effects(spark, folder):
    return tr.random_effects(trajectories(spark, folder), time="year", target="cognitive_score")


@query(
    "random_effects",
    "T6",
    with_ctes(
        "SELECT participant_id, n, intercept, slope, intercept - m0 AS intercept_effect, slope - m1 AS slope_effect FROM re",
        "trajectories", extra=EFFECTS_SQL,
    ),
    "intercept slope intercept_effect slope_effect",
)
def _random_effects(spark, folder):
    return _effects(spark, folder)


@query(
    "person_effects",
    "T7",
    with_ctes(
        """SELECT CAST(c_custkey AS VARCHAR) AS participant_id, coalesce(intercept - m0, 0.0) AS intercept_effect, coalesce(slope - m1, 0.0) AS slope_effect
        FROM customer LEFT JOIN re ON re.participant_id = CAST(c_custkey AS VARCHAR)""",
        "trajectories", extra=EFFECTS_SQL,
    ),
    "intercept_effect slope_effect",
)
def _person_effects(spark, folder):
    people = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("participant_id"))
    return tr.person_effects(people, _effects(spark, folder))


CONFORMAL_CTES = {
    **RIDGE_CTES,
    "res": """SELECT abs(future_score - prediction) AS r, row_number() OVER (ORDER BY abs(future_score - prediction)) AS rn,
        count(*) OVER () AS n FROM pr WHERE role IN ('public_validation', 'india_validation')""",
    "place": "SELECT *, least(ceil((n + 1) * CAST(0.9 AS DOUBLE)) / n, 1.0) * (n - 1) AS h FROM res",
    "ends": """SELECT max(r) FILTER (WHERE rn = floor(h) + 1) AS low, max(r) FILTER (WHERE rn = ceil(h) + 1) AS high,
        max(h) - floor(max(h)) AS share FROM place""",
    "q": "SELECT low + (high - low) * share AS w FROM ends",
}


@query(
    "conformal_trajectory",
    "T8, T9",
    with_ctes(
        """SELECT participant_id, horizon_years, prediction, prediction - w AS lower, prediction + w AS upper FROM pr, q
        WHERE role IN ('public_validation', 'india_validation')""",
        "trajectories", "staffed", extra=CONFORMAL_CTES,
    ),
    "horizon_years prediction lower upper",
)
def _conformal(spark, folder):
    fit, held = _pairs(spark, folder)
    predictions = tr.RidgeTrajectory(["horizon_years"]).fit(fit).predict(held, "prediction")
    residuals = predictions.select((F.col("future_score") - F.col("prediction")).alias("residual"))
    width = tr.conformal_width(residuals, alpha=0.1)
    return tr.with_interval(predictions, width).select("participant_id", "horizon_years", "prediction", "lower", "upper")


INTERPOLATE_SQL = {
    "pts": "SELECT participant_id, year, avg(cognitive_score) AS v FROM series GROUP BY participant_id, year",
    "near": """SELECT participant_id, g AS grid, max(year) FILTER (WHERE year <= g) AS t0, arg_max(v, year) FILTER (WHERE year <= g) AS v0,
        min(year) FILTER (WHERE year > g) AS t1, arg_min(v, year) FILTER (WHERE year > g) AS v1
        FROM pts, (SELECT unnest([0.0::DOUBLE, 5.5, 12.25, 20.0, 40.0]) AS g) GROUP BY participant_id, g""",
}
GRID = (0.0, 5.5, 12.25, 20.0, 40.0)


@query(
    "interpolated_series",
    "T11",
    with_ctes(
        """SELECT participant_id, grid AS year, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0
        ELSE v0 + (v1 - v0) * ((grid - t0) / (t1 - t0)) END AS cognitive_score FROM near""",
        "series", extra=INTERPOLATE_SQL,
    ),
    "year cognitive_score",
)
def _interpolated(spark, folder):
    return tr.interpolate(series(spark, folder), GRID)
