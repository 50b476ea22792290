"""Nearest-neighbour queries: vectors, participants, and what follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.registry import query
from driver_queries.trajectories import RIDGE_CTES
from driver_queries.views import baseline_with_role, table, trajectories, with_ctes
from longspan.operators import neighbors as nb
from longspan.operators import trajectory as tr
from longspan.operators.checks import TRAIN_ROLES
from longspan.session import cut_lineage

K = 5


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.col("label").cast("string").alias("stratum"),
    )


VECTOR_PAIRS = """SELECT CAST(q.vec_id AS VARCHAR) AS qid, CAST(r.vec_id AS VARCHAR) AS rid, CAST(r.label AS VARCHAR) AS stratum,
    sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(r.embedding[i] AS DOUBLE)) * (CAST(q.embedding[i] AS DOUBLE) - CAST(r.embedding[i] AS DOUBLE))))) AS distance
    FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id"""


@query(
    "nearest_vectors",
    "N2, N5",
    f"""SELECT qid, rid, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, rid) AS rank
    FROM ({VECTOR_PAIRS}) AS p) AS r WHERE rank <= {K}""",
    "distance",
)
def _nearest(spark, folder):
    v = _vectors(spark, folder)
    queries = v.select(F.col("id").alias("qid"), "vector", F.col("id").alias("exclude"))
    return nb.knn_join(queries, v.select(F.col("id").alias("rid"), "vector"), K).select("qid", "rid", "distance", "rank")


@query(
    "nearest_vectors_balanced",
    "N6",
    f"""SELECT qid, rid, stratum, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, rid) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY qid, stratum ORDER BY distance, rid) AS inner_rank FROM ({VECTOR_PAIRS}) AS p) AS i
      WHERE inner_rank <= 1) AS r WHERE rank <= {K}""",
    "distance",
)
def _balanced(spark, folder):
    v = _vectors(spark, folder)
    queries = v.select(F.col("id").alias("qid"), "vector", F.col("id").alias("exclude"))
    cap = nb.balanced_cap(K, v.select("stratum").distinct().count())
    reference = v.select(F.col("id").alias("rid"), "vector", "stratum")
    return nb.knn_join(queries, reference, K, per_stratum=cap).select("qid", "rid", "stratum", "distance", "rank")


SPACE = ("age", "education_years", "cognitive_score")
WEIGHTS = {"age": 2.0, "cognitive_score": 3.0}


def _space_ctes(metric: str) -> dict[str, str]:
    """Reference (train) and query (validation) points of participants in the fitted space."""
    names = SPACE if metric != "mahalanobis" else SPACE[:2]
    ctes = {
        "med": "SELECT " + ", ".join(f"quantile_cont({f}, 0.5) AS {f}" for f in names) + " FROM train",
        "st": "SELECT "
        + ", ".join(f"avg(coalesce(t.{f}, med.{f})) AS m_{f}, stddev_pop(coalesce(t.{f}, med.{f})) AS s_{f}" for f in names)
        + " FROM train t, med",
        "pts": "SELECT participant_id, role, cohort, urban_rural, s0.cognitive_score AS own_score, "
        + ", ".join(f"(coalesce(s0.{f}, med.{f}) - m_{f}) / s_{f} AS z{i}" for i, f in enumerate(names))
        + " FROM staffed s0, med, st",
    }
    if metric == "mahalanobis":
        ctes["cv"] = """SELECT var_samp(z0) + 1e-4 AS a, covar_samp(z0, z1) AS b, var_samp(z1) + 1e-4 AS d FROM pts
            WHERE role IN ('global_train', 'tlsa_adaptation')"""
        distance = "sqrt(greatest((d * (q.z0 - r.z0) * (q.z0 - r.z0) - 2 * b * (q.z0 - r.z0) * (q.z1 - r.z1) + a * (q.z1 - r.z1) * (q.z1 - r.z1)) / (a * d - b * b), 0))"
        source = "pts q, pts r, cv"
    else:
        w = [WEIGHTS.get(f, 1.0) if metric == "importance_weighted" else 1.0 for f in names]
        mean = sum(w) / len(w) if metric == "importance_weighted" else 1.0
        distance = "sqrt(" + " + ".join(
            f"CAST({v / mean!r} AS DOUBLE) * (q.z{i} - r.z{i}) * (q.z{i} - r.z{i})" for i, v in enumerate(w)
        ) + ")"
        source = "pts q, pts r"
    ctes["near"] = f"""SELECT query_id, participant_id, distance, rank FROM (
        SELECT q.participant_id AS query_id, r.participant_id, {distance} AS distance,
        row_number() OVER (PARTITION BY q.participant_id ORDER BY round({distance}, 9), r.participant_id) AS rank
        FROM {source} WHERE q.role IN ('public_validation', 'india_validation', 'external_validation')
        AND r.role IN ('global_train', 'tlsa_adaptation')) AS n WHERE rank <= {K}"""
    return ctes


def _people(spark, folder):
    return cut_lineage(baseline_with_role(spark, folder))


def _query(people, metric: str):
    fit_rows = people.where(F.col("role").isin(*TRAIN_ROLES))
    names = SPACE if metric != "mahalanobis" else SPACE[:2]
    space = nb.NeighborSpace(names, metric=metric, weights=WEIGHTS).fit(fit_rows)
    return space.query(people.where(~F.col("role").isin(*TRAIN_ROLES)), K)


def _near_query(name: str, items: str, metric: str) -> None:
    @query(
        name,
        items,
        with_ctes("SELECT query_id, participant_id, rank, distance FROM near", "train", "staffed", extra=_space_ctes(metric)),
        "distance",
    )
    def _run(spark, folder):
        return _query(_people(spark, folder), metric).select("query_id", "participant_id", "rank", "distance")


_near_query("nearest_participants", "N1, N2, N5", "euclidean")
_near_query("nearest_participants_mahalanobis", "N3", "mahalanobis")
_near_query("nearest_participants_weighted", "N4", "importance_weighted")

# Ranking by age alone within 1e-9 leaves no equal neighbours to swap, so what follows can be compared row by row.
AGE_CTES = {
    "st": "SELECT avg(age) AS m, stddev_pop(age) AS s FROM train",
    "near": f"""SELECT query_id, participant_id, distance, rank FROM (SELECT q.participant_id AS query_id, r.participant_id,
        abs((q.age - m) / s - (r.age - m) / s) AS distance, row_number() OVER (PARTITION BY q.participant_id
        ORDER BY abs((q.age - m) / s - (r.age - m) / s), r.participant_id) AS rank
        FROM staffed q, staffed r, st WHERE q.role NOT IN ('global_train', 'tlsa_adaptation') AND r.role IN ('global_train', 'tlsa_adaptation')) AS n
        WHERE rank <= {K}""",
}


def _age_twins(people):
    fit_rows = people.where(F.col("role").isin(*TRAIN_ROLES))
    return cut_lineage(nb.NeighborSpace(["age"]).fit(fit_rows).query(people.where(~F.col("role").isin(*TRAIN_ROLES)), K))


@query(
    "twin_summary",
    "N7, N9",
    with_ctes(
        """SELECT n.query_id, n.rank, n.participant_id, s.cohort, s.urban_rural, 100.0 * exp(-n.distance / 4.5) AS similarity,
        s.cognitive_score AS baseline_cognition FROM near n JOIN staffed s ON n.participant_id = s.participant_id""",
        "train", "staffed", extra=AGE_CTES,
    ),
    "similarity baseline_cognition",
)
def _summary(spark, folder):
    people = _people(spark, folder)
    return nb.twin_summary(_age_twins(people), people)


@query(
    "twin_trajectories",
    "N8",
    with_ctes(
        """SELECT n.query_id, t.participant_id, t.year, t.cognitive_score, 100.0 * exp(-n.distance / 4.5) AS similarity
        FROM near n JOIN trajectories t ON n.participant_id = t.participant_id""",
        "train", "staffed", "trajectories", extra=AGE_CTES,
    ),
    "year cognitive_score similarity",
)
def _twin_trajectories(spark, folder):
    rows = nb.twin_series(_age_twins(_people(spark, folder)), trajectories(spark, folder))
    return rows.select("query_id", "participant_id", "year", "cognitive_score", "similarity")


DISPERSION_CTES = {
    "rows": """SELECT n.query_id, t.participant_id, t.year, avg(t.cognitive_score) AS v FROM near n JOIN trajectories t
        ON n.participant_id = t.participant_id GROUP BY 1, 2, 3""",
    "around": """SELECT query_id, participant_id, g AS grid, max(year) FILTER (WHERE year <= g) AS t0, arg_max(v, year) FILTER (WHERE year <= g) AS v0,
        min(year) FILTER (WHERE year > g) AS t1, arg_min(v, year) FILTER (WHERE year > g) AS v1
        FROM rows, (SELECT unnest([1.0::DOUBLE, 2.0, 3.0, 5.0]) AS g) GROUP BY 1, 2, 3""",
    "disp": """SELECT query_id, grid AS year, stddev_pop(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0
        ELSE v0 + (v1 - v0) * ((grid - t0) / (t1 - t0)) END) AS dispersion FROM around GROUP BY 1, 2""",
}


@query(
    "twin_dispersion",
    "T11, T12",
    with_ctes("SELECT * FROM disp", "train", "staffed", "trajectories", extra={**AGE_CTES, **DISPERSION_CTES}),
    "year dispersion",
)
def _dispersion(spark, folder):
    return tr.twin_dispersion(nb.twin_series(_age_twins(_people(spark, folder)), trajectories(spark, folder)))


_RIDGE = {k: v for k, v in RIDGE_CTES.items() if k != "st"}
_RIDGE["co"] = _RIDGE["co"].replace("FROM fitp, st", "FROM fitp, rst")
PROFILE_CTES = {
    **AGE_CTES, **DISPERSION_CTES, "pairs": RIDGE_CTES["pairs"], "fitp": RIDGE_CTES["fitp"], "rst": RIDGE_CTES["st"],
    "co": _RIDGE["co"], "pr": RIDGE_CTES["pr"],
    "band": "SELECT greatest(0.75, quantile_cont(abs(future_score - prediction), 0.8)) AS band FROM pr WHERE role IN ('public_validation', 'india_validation')",
    "pj": """SELECT s.participant_id, g AS year, CASE WHEN g = 0 THEN s.cognitive_score ELSE my + b * (g - m) / s END AS center
        FROM (SELECT participant_id, cognitive_score FROM staffed WHERE role NOT IN ('global_train', 'tlsa_adaptation')) AS s,
        co, (SELECT unnest([0.0::DOUBLE, 1.0, 2.0, 3.0, 5.0]) AS g)""".replace("(g - m) / s END", "(g - co.m) / co.s END"),
    "tj": """SELECT participant_id, pj.year, CASE WHEN center IS NOT NULL THEN least(greatest(center, 0), 30) END AS predicted_score,
        CASE WHEN pj.year = 0 THEN 0.25 ELSE sqrt(band * band + (0.35 * coalesce(dispersion, 0)) * (0.35 * coalesce(dispersion, 0))) END AS w
        FROM pj CROSS JOIN band LEFT JOIN disp ON disp.query_id = pj.participant_id AND disp.year = pj.year""",
}


def _forecast(spark, folder):
    people = _people(spark, folder)
    series = nb.twin_series(_age_twins(people), trajectories(spark, folder))
    fit = tr.training_pairs(trajectories(spark, folder), people.where(F.col("role").isin(*TRAIN_ROLES)), ["age"])
    held = tr.training_pairs(
        trajectories(spark, folder), people.where(F.col("role").isin("public_validation", "india_validation")), ["age"]
    )
    model = tr.RidgeTrajectory(["horizon_years"]).fit(fit)
    asked = people.where(~F.col("role").isin(*TRAIN_ROLES)).select("participant_id", "cognitive_score")
    projected = tr.profile_trajectory(asked, model, tr.twin_dispersion(series), tr.residual_band(held, model))
    return people, series, projected


@query(
    "profile_trajectory",
    "T10",
    with_ctes(
        """SELECT participant_id, year, predicted_score, CASE WHEN predicted_score IS NOT NULL THEN least(greatest(predicted_score - w, 0), 30) END AS lower,
        CASE WHEN predicted_score IS NOT NULL THEN least(greatest(predicted_score + w, 0), 30) END AS upper FROM tj""",
        "train", "staffed", "trajectories", extra=PROFILE_CTES,
    ),
    "year predicted_score lower upper",
)
def _profile(spark, folder):
    return _forecast(spark, folder)[2]


@query(
    "plot_series",
    "N10",
    with_ctes(
        """SELECT n.query_id, t.year, t.cognitive_score, t.participant_id || ' · ' || s.cohort AS series
        FROM near n JOIN trajectories t ON n.participant_id = t.participant_id JOIN staffed s ON s.participant_id = t.participant_id
        UNION ALL SELECT participant_id, year, predicted_score, 'Selected profile · projection' FROM tj""",
        "train", "staffed", "trajectories", extra=PROFILE_CTES,
    ),
    "year cognitive_score",
)
def _plot(spark, folder):
    people, series, projected = _forecast(spark, folder)
    named = series.join(people.select("participant_id", "cohort"), "participant_id")
    return nb.plot_series(named, projected)
