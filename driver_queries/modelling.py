"""Risk classifiers, fusion and attribution queries."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from driver_queries.newton_sql import newton_ctes
from driver_queries.registry import query
from driver_queries.views import baseline_with_role, scores, train, validation, with_ctes, with_groups
from longspan.operators import attribution, fusion, risk, risk_arrays, tree_attribution
from longspan.operators.checks import TRAIN_ROLES
from longspan.operators.scaling import MedianImputer
from longspan.session import cut_lineage

FEATURES = ("age", "education_years", "cognitive_score", "hippocampal_volume_mm3", "hba1c_percent")
TARGET = "event_by_3y"


def _split(spark, folder):
    """Train and validation rows; the wide table is written once because every fit reads it several times."""
    rows = cut_lineage(baseline_with_role(spark, folder))
    return rows.where(F.col("role").isin(*TRAIN_ROLES)), rows.where(~F.col("role").isin(*TRAIN_ROLES))


LOGIT = (
    " + ".join(f"{f} * (p_{f} - n_{f})" for f in FEATURES)
    + " - ("
    + " + ".join(f"(p_{f} + n_{f}) * (p_{f} - n_{f})" for f in FEATURES)
    + ") / 2"
)

# The closed-form classifier in SQL: medians, standardisation, class means.
CENTROID = {
    "med": "SELECT " + ", ".join(f"quantile_cont({f}, 0.5) AS {f}" for f in FEATURES) + " FROM train",
    "filled": f"SELECT t.participant_id, t.{TARGET} AS y, "
    + ", ".join(f"coalesce(t.{f}, med.{f}) AS {f}" for f in FEATURES)
    + " FROM train t, med",
    "st": "SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES) + " FROM filled",
    "cls": "SELECT "
    + ", ".join(
        f"avg(({f} - m_{f}) / s_{f}) FILTER (WHERE y = 1) AS p_{f}, avg(({f} - m_{f}) / s_{f}) FILTER (WHERE y = 0) AS n_{f}"
        for f in FEATURES
    )
    + " FROM filled, st",
    "zs": "SELECT v.participant_id, v.role, v.event_by_3y, "
    + ", ".join(f"(coalesce(v.{f}, med.{f}) - m_{f}) / s_{f} AS {f}" for f in FEATURES)
    + " FROM validation v, med, st",
    "cr": f"SELECT zs.participant_id, zs.role, zs.event_by_3y, 1 / (1 + exp(-({LOGIT}))) AS risk FROM zs, cls",
}


@query(
    "centroid_risk",
    "R2, H13, H5",
    with_ctes("SELECT participant_id, risk FROM cr", "train", "validation", extra=CENTROID),
    "risk",
)
def _centroid(spark, folder):
    fit_rows, held = _split(spark, folder)
    return risk.CentroidRisk(FEATURES).fit(fit_rows, TARGET).predict_risk(held).select("participant_id", "risk")


LOGISTIC = {
    **CENTROID,
    "nt_rows": "SELECT y, CASE WHEN y = 1 THEN n / (2.0 * pos) ELSE n / (2.0 * (n - pos)) END AS w, "
    + ", ".join(f"({f} - m_{f}) / s_{f} AS {f}" for f in FEATURES)
    + " FROM filled, st, (SELECT count(*) AS n, sum(y) AS pos FROM filled) AS k",
    **newton_ctes("nt_rows", FEATURES, 1.0, 8),
}


@query(
    "logistic_risk",
    "R1",
    with_ctes(
        "SELECT participant_id, 1 / (1 + exp(-(b0 + " + " + ".join(f"b{i + 1} * {f}" for i, f in enumerate(FEATURES)) + "))) AS risk FROM zs, nt_b",
        "train", "validation", extra=LOGISTIC,
    ),
    "risk",
)
def _logistic(spark, folder):
    fit_rows, held = _split(spark, folder)
    return risk.LogisticRisk(FEATURES).fit(fit_rows, TARGET).predict_risk(held).select("participant_id", "risk")


@query("boosted_risk", "R3")
def _boosted(spark, folder):
    fit_rows, held = _split(spark, folder)
    model = risk.BoostedRisk(FEATURES, n_estimators=8, learning_rate=0.1, max_depth=3).fit(fit_rows, TARGET)
    return model.predict_risk(held).select("participant_id", "risk")


@query("calibrated_boosted_risk", "R4")
def _calibrated(spark, folder):
    fit_rows, held = _split(spark, folder)
    model = risk.BoostedRisk(FEATURES, n_estimators=4, learning_rate=0.1, max_depth=3, calibrate=True)
    return model.fit(fit_rows, TARGET).predict_risk(held).select("participant_id", "risk")


@query("boosted_importance", "R5, X5")
def _importance(spark, folder):
    fit_rows, _ = _split(spark, folder)
    return risk.BoostedRisk(FEATURES, n_estimators=8, max_depth=3).fit(fit_rows, TARGET).feature_importance(spark)


@query("multi_horizon_risk", "R6")
def _multi_horizon(spark, folder):
    fit_rows, held = _split(spark, folder)
    renamed = fit_rows.select(*FEATURES, *[F.col(f"event_by_{h}y").alias(f"event_{h}") for h in (1, 3, 5)])
    models = risk.fit_multi_horizon(renamed, FEATURES, n_estimators=4, max_depth=2)
    out = held
    for h, model in models.items():
        out = model.predict_risk(out, f"risk_{h}y")
    return out.select("participant_id", *[f"risk_{h}y" for h in models])


# --- fusion ----------------------------------------------------------------------

STRENGTH_COLUMNS = {
    "clinical": ("1.0 - cognitive_score / 30.0", 0.4),
    "mri": ("wmh_burden_ml / 12.5", 0.35),
    "blood": ("hs_crp_mg_l / 6.0", 0.25),
}


@query(
    "late_fusion",
    "R7",
    with_ctes(
        "SELECT participant_id, ("
        + " + ".join(f"coalesce(CAST({w} AS DOUBLE) * ({s}), 0)" for s, w in STRENGTH_COLUMNS.values())
        + ") / nullif("
        + " + ".join(f"CASE WHEN ({s}) IS NOT NULL THEN CAST({w} AS DOUBLE) ELSE 0 END" for s, w in STRENGTH_COLUMNS.values())
        + ", 0) AS fused_score FROM baseline",
        "baseline",
    ),
    "fused_score",
)
def _late_fusion(spark, folder):
    rows = baseline_with_role(spark, folder).select(
        "participant_id",
        (1.0 - F.col("cognitive_score") / 30.0).alias("clinical"),
        (F.col("wmh_burden_ml") / 12.5).alias("mri"),
        (F.col("hs_crp_mg_l") / 6.0).alias("blood"),
    )
    fused = fusion.fuse_scores(rows, {c: w for c, (_, w) in STRENGTH_COLUMNS.items()})
    return fused.select("participant_id", "fused_score")


@query(
    "fused_distribution",
    "R13, F9",
    with_ctes(
        """SELECT participant_id, replicate, horizon, sum(risk * CAST(weight AS DOUBLE)) / sum(CAST(weight AS DOUBLE)) AS risk
        FROM scores JOIN weights USING (modality) WHERE modality <> 'MRI' GROUP BY participant_id, replicate, horizon""",
        "scores", "weights",
    ),
    "risk",
)
def _fused(spark, folder):
    return risk_arrays.distribution_rows(with_groups(validation(spark, folder)), disabled=["MRI"])


@query("batch_risk", "R14", with_ctes("SELECT * FROM batch", "batch"), "risk_1y risk_3y risk_5y")
def _batch(spark, folder):
    people = with_groups(validation(spark, folder)).where(F.size("groups") > 0).select("participant_id", "groups")
    return risk_arrays.with_batch_risk(people)


@query(
    "risk_intervals",
    "R15",
    with_ctes(
        """SELECT participant_id, horizon, quantile_cont(risk, 0.5) AS risk, least(quantile_cont(risk, 0.1), quantile_cont(risk, 0.5)) AS lower,
        greatest(quantile_cont(risk, 0.9), quantile_cont(risk, 0.5)) AS upper FROM fused GROUP BY participant_id, horizon""",
        "fused",
    ),
    "risk lower upper",
)
def _intervals(spark, folder):
    return risk_arrays.interval_rows(with_groups(validation(spark, folder)))


@query(
    "modality_reference_risk",
    "R12",
    with_ctes(
        "SELECT modality, quantile_cont(risk, 0.5) AS reference_risk FROM scores WHERE horizon = 3 GROUP BY modality",
        "scores", people="train",
    ),
    "reference_risk",
)
def _reference(spark, folder):
    return fusion.reference_risks(scores(train(spark, folder)))


@query(
    "modality_drivers",
    "R11, R12",
    with_ctes(
        """SELECT participant_id, modality, effect AS relative_effect, modality_risk, modality_risk IS NOT NULL AS available,
        CASE WHEN effect >= 0 THEN 'Raises estimate' ELSE 'Lowers estimate' END AS direction,
        row_number() OVER (PARTITION BY participant_id ORDER BY abs(effect) DESC, modality) AS driver_rank FROM (
          SELECT s.participant_id, w.modality, m.modality_risk,
            coalesce(CAST(w.weight AS DOUBLE) * (m.modality_risk - r.reference_risk), 0.0) AS effect
          FROM staffed s CROSS JOIN weights w LEFT JOIN med m ON m.participant_id = s.participant_id AND m.modality = w.modality
          LEFT JOIN ref r ON r.modality = w.modality) AS e""",
        "scores", "weights", "staffed", people="staffed",
        extra={
            "med": "SELECT participant_id, modality, median(risk) AS modality_risk FROM scores WHERE horizon = 3 GROUP BY 1, 2",
            "ref": """SELECT modality, quantile_cont(risk, 0.5) AS reference_risk FROM scores JOIN staffed USING (participant_id)
                WHERE horizon = 3 AND role IN ('global_train', 'tlsa_adaptation') GROUP BY modality""",
        },
    ),
    "relative_effect modality_risk",
)
def _drivers(spark, folder):
    people = cut_lineage(baseline_with_role(spark, folder))
    all_scores = scores(people)
    train_ids = people.where(F.col("role").isin(*TRAIN_ROLES)).select("participant_id")
    reference = fusion.reference_risks(all_scores.join(train_ids, "participant_id", "left_semi"))
    return fusion.modality_drivers(people, all_scores, reference)


@query("stacked_fusion", "R8-R10")
def _stacked(spark, folder):
    fit_rows, held = _split(spark, folder)
    groups = {"clinical": ("age", "education_years", "cognitive_score"), "scan": ("hippocampal_volume_mm3", "wmh_burden_ml")}

    def oof(columns, name):
        return fusion.out_of_fold_scores(
            fit_rows, lambda rows: risk.CentroidRisk(columns).fit(rows, TARGET), n_folds=3, out=name
        ).select("participant_id", name)

    stacked = fit_rows.select("participant_id", TARGET)
    for name, columns in groups.items():
        stacked = stacked.join(oof(columns, name), "participant_id")
    meta = fusion.StackedFusion(list(groups)).fit(stacked, TARGET)
    scored = held
    for name, columns in groups.items():
        scored = risk.CentroidRisk(columns).fit(fit_rows, TARGET).predict_risk(scored, name)
    return meta.predict(scored.select("participant_id", *groups)).select("participant_id", "fused_score")


# --- attribution ---------------------------------------------------------------

DIRECTIONS = ", ".join(f"{f} * (p_{f} - n_{f}) AS {f}" for f in FEATURES)
GROUPS = {
    "clinical": ("age", "education_years", "cognitive_score"),
    "MRI": ("hippocampal_volume_mm3",),
    "Blood": ("hba1c_percent",),
    "Genomics": ("apoe_e4_count",),
}


def _attributions(spark, folder):
    fit_rows, held = _split(spark, folder)
    model = risk.CentroidRisk(FEATURES).fit(fit_rows, TARGET)
    return attribution.linear_attribution(model.standardized(held), model.direction)


ATTRIBUTION = {**CENTROID, "attr": f"SELECT participant_id, {DIRECTIONS} FROM zs, cls"}


@query(
    "linear_attribution",
    "X4",
    with_ctes("SELECT * FROM attr", "train", "validation", extra=ATTRIBUTION),
    " ".join(FEATURES),
)
def _linear(spark, folder):
    return _attributions(spark, folder)


@query(
    "attribution_by_modality",
    "X6",
    with_ctes(
        "SELECT participant_id, "
        + ", ".join(
            "(" + (" + ".join(f"abs({f})" for f in fs if f in FEATURES) or "0.0") + f") AS {g}" for g, fs in GROUPS.items()
        )
        + " FROM attr",
        "train", "validation", extra=ATTRIBUTION,
    ),
    "clinical MRI Blood Genomics",
)
def _by_modality(spark, folder):
    return attribution.by_modality(_attributions(spark, folder), GROUPS)


@query("forest_attribution", "X4")
def _forest_attribution(spark, folder):
    """Attributions to the probability of a forest of 200 trees, with its output beside their sum."""
    fit_rows, held = _split(spark, folder)
    imputer = MedianImputer(FEATURES).fit(fit_rows)
    points = risk.assemble(imputer.transform(held), FEATURES)
    learner = RandomForestClassifier(
        featuresCol=risk.VECTOR, labelCol=TARGET, numTrees=200, maxDepth=5, minInstancesPerNode=10, seed=42
    )
    labelled = risk.assemble(imputer.transform(fit_rows), FEATURES).withColumn(TARGET, F.col(TARGET).cast("double"))
    model = learner.fit(labelled.where(F.col(TARGET).isNotNull()))
    output = model.transform(points).select("participant_id", risk.positive_probability().alias("risk"))
    return tree_attribution.tree_attribution(points, model, FEATURES).join(output, "participant_id")


@query("boosted_attribution", "X4")
def _boosted_attribution(spark, folder):
    fit_rows, held = _split(spark, folder)
    model = risk.BoostedRisk(FEATURES, n_estimators=8, learning_rate=0.1, max_depth=3).fit(fit_rows, TARGET)
    return tree_attribution.boosted_attribution(model, held)


_CELLS = ", ".join(f"{{'place': {i}, 'feature': '{f}', 'value': {f}}}" for i, f in enumerate(FEATURES))


@query(
    "top_drivers",
    "X7",
    with_ctes(
        "SELECT participant_id, "
        + ", ".join(
            f"max(feature) FILTER (WHERE rn = {i}) AS feature_{i}, max(value) FILTER (WHERE rn = {i}) AS value_{i}" for i in range(1, 8)
        )
        + f""" FROM (SELECT participant_id, c.feature, c.value, row_number() OVER (PARTITION BY participant_id ORDER BY abs(c.value) DESC, c.place) AS rn
        FROM (SELECT participant_id, unnest([{_CELLS}]) AS c FROM attr) AS u) AS r GROUP BY participant_id""",
        "train", "validation", extra=ATTRIBUTION,
    ),
    " ".join(f"value_{i}" for i in range(1, 8)),
)
def _top_drivers(spark, folder):
    return attribution.top_drivers(_attributions(spark, folder), FEATURES, k=7)


@query(
    "global_importance",
    "X5",
    with_ctes(
        "\nUNION ALL ".join(f"SELECT '{f}' AS feature, avg(abs({f})) AS importance FROM attr" for f in FEATURES),
        "train", "validation", extra=ATTRIBUTION,
    ),
    "importance",
)
def _global(spark, folder):
    return attribution.mean_absolute(_attributions(spark, folder), FEATURES)


@query(
    "occlusion_attribution",
    "X4",
    with_ctes(
        "SELECT zs.participant_id, "
        + ", ".join(
            f"1 / (1 + exp(-({LOGIT}))) - 1 / (1 + exp(-({LOGIT} - {f} * (p_{f} - n_{f}) + ((md_{f} - m_{f}) / s_{f}) * (p_{f} - n_{f})))) AS {f}"
            for f in FEATURES
        )
        + " FROM (SELECT * FROM zs) AS zs, cls, (SELECT "
        + ", ".join(f"{f} AS md_{f}" for f in FEATURES)
        + " FROM med) AS med, st",
        "train", "validation", extra=CENTROID,
    ),
    " ".join(FEATURES),
)
def _occlusion(spark, folder):
    fit_rows, held = _split(spark, folder)
    model = risk.CentroidRisk(FEATURES).fit(fit_rows, TARGET)
    return attribution.occlusion_attribution(
        held.select("participant_id", *FEATURES), model.imputer.medians, model.predict_risk
    )
