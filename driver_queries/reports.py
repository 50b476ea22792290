"""Quality checks, warnings, what-if, audit and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.registry import query
from driver_queries.views import (
    baseline_with_role,
    features,
    metrics_sql,
    participants,
    roles,
    scored,
    validation,
    visits,
    with_ctes,
    with_groups,
)
from longspan.operators import audit, fusion, risk_arrays
from longspan.operators.checks import TRAIN_ROLES
from longspan.operators.common_model import harmonisation_manifest
from longspan.operators.discrimination import binary_metrics
from longspan.operators.modality import training_ranges
from longspan.session import cut_lineage
from longspan.sources import contracts, sinks

CHECKS_SQL = """SELECT "check", CASE WHEN n = 0 THEN 'Passed' ELSE 'Failed' END AS status, evidence FROM (
    SELECT 'Participant split isolation' AS "check", (SELECT count(*) - count(DISTINCT participant_id) FROM roles) AS n, 'Training and validation share no participant.' AS evidence
    UNION ALL SELECT 'Future-visit leakage guard', (SELECT count(*) FROM features f JOIN visits v ON f.visit_id = v.visit_id WHERE v.baseline_days > 0),
      'No feature is dated after the visit it predicts from.'
    UNION ALL SELECT 'Train-only preprocessing', (SELECT count(*) FROM train WHERE role NOT IN ('global_train', 'tlsa_adaptation')),
      'Every fitted transform saw rows of the training roles alone.'
    UNION ALL SELECT 'Canonical unit validation', (SELECT count(*) FROM features WHERE feature_name = 'rnfl_um' AND unit <> 'um'), 'Each feature carries the one unit that the manifest names.'
    UNION ALL SELECT 'Visit chronology', (SELECT count(*) FROM (SELECT baseline_days - lag(baseline_days) OVER (PARTITION BY participant_id ORDER BY visit_index) AS d FROM visits) AS x WHERE d < 0),
      'No visit is dated before its predecessor.'
    UNION ALL SELECT 'SANSCOG holdout', (SELECT count(*) FROM roles WHERE cohort = 'SANSCOG' AND role IN ('global_train', 'tlsa_adaptation')),
      'The held-out rural cohort has no training row.') AS c"""


def _checks(spark, folder):
    f, v, r = features(spark, folder, cohorts=False), visits(spark, folder), roles(spark, folder)
    timed = f.join(v.select("visit_id", F.col("baseline_days").alias("feature_days")), "visit_id").select(
        "feature_days", F.lit(0).alias("anchor_days")
    )
    train_ids = r.where(F.col("role").isin(*TRAIN_ROLES))
    return audit.quality_checks(r, train_ids, f, v, harmonisation_manifest(spark), timed)


@query("quality_checks", "E18-E20", with_ctes(CHECKS_SQL, "train", "roles", "features", "visits"))
def _quality(spark, folder):
    return _checks(spark, folder)


@query(
    "audit_counts",
    "X12",
    with_ctes(
        """SELECT (SELECT count(*) FROM customer) AS participants, (SELECT count(*) FROM orders) AS visits, CAST(7 * 17 AS BIGINT) AS mapped_fields,
        CAST(sum(CASE WHEN status = 'Passed' THEN 1 ELSE 0 END) AS BIGINT) AS checks_passed, count(*) AS checks_total FROM qc""",
        "train", "roles", "features", "visits", extra={"qc": CHECKS_SQL},
    ),
)
def _audit(spark, folder):
    return audit.audit_counts(
        participants(spark, folder), visits(spark, folder), harmonisation_manifest(spark), _checks(spark, folder)
    )


_MISSING = "list_filter([" + ", ".join(
    f"CASE WHEN coalesce({', '.join(fs)}) IS NULL THEN '{g}' END" for g, fs in contracts.MODEL_GROUPS.items() if g != contracts.CLINICAL_GROUP
) + "], lambda x: x IS NOT NULL)"
_OUTSIDE = "list_filter([" + ", ".join(
    f"CASE WHEN v.{f} < lo_{f} OR v.{f} > hi_{f} THEN '{f.replace('_', ' ')}' END" for f in contracts.MODEL_FEATURES
) + "], lambda x: x IS NOT NULL)"
_AVAILABLE = "list_filter([CASE WHEN cognitive_score IS NOT NULL THEN 'Cognition + clinical' END, " + ", ".join(
    f"CASE WHEN coalesce({', '.join(fs)}) IS NOT NULL THEN '{g}' END" for g, fs in contracts.MODEL_GROUPS.items() if g != contracts.CLINICAL_GROUP
) + "], lambda x: x IS NOT NULL)"


def _bound(values: str, share: float) -> str:
    place = f"round({share}::DOUBLE * (len({values}) - 1), 9)"
    low, high = f"{values}[floor({place})::INT + 1]", f"{values}[ceil({place})::INT + 1]"
    return f"({low} + ({high} - {low}) * ({place} - floor({place})))"


@query(
    "participant_warnings",
    "X8, X9, F10",
    with_ctes(
        """SELECT participant_id, array_to_string(av, '|') AS available_modalities, array_to_string(list_filter([
        CASE WHEN len(mi) > 0 THEN 'No data from: ' || array_to_string(mi, ', ') || '. The other groups share their fusion weight.' END,
        CASE WHEN len(ou) > 0 THEN 'Beyond the values seen in training: ' || array_to_string(ou, ', ') || '. The forecast extrapolates here.' END,
        CASE WHEN 4 - len(mi) < 2 THEN 'At most one group besides the clinical one is present, so the clinical scores decide the forecast.' END,
        CASE WHEN urban_rural = 'rural' THEN 'Rural participants appear in no training row; only the held-out cohort validates this forecast.' END
        ], lambda x: x IS NOT NULL), '|') AS warnings FROM wr""",
        "train", "validation",
        extra={
            # low + (high - low) * share: between two equal values the bound is that value, to the last bit.
            "sorted_values": "SELECT " + ", ".join(
                f"list_sort(list(CAST({f} AS DOUBLE)) FILTER (WHERE {f} IS NOT NULL)) AS {f}" for f in contracts.MODEL_FEATURES
            ) + " FROM train",
            "rg": "SELECT " + ", ".join(
                f"{_bound(f, 0.01)} AS lo_{f}, {_bound(f, 0.99)} AS hi_{f}" for f in contracts.MODEL_FEATURES
            ) + " FROM sorted_values",
            "wr": f"SELECT v.participant_id, v.urban_rural, {_AVAILABLE} AS av, {_MISSING} AS mi, {_OUTSIDE} AS ou FROM validation v, rg",
        },
    ),
)
def _warnings(spark, folder):
    rows = cut_lineage(baseline_with_role(spark, folder))
    ranges = training_ranges(rows.where(F.col("role").isin(*TRAIN_ROLES)))
    found = audit.participant_warnings(rows.where(~F.col("role").isin(*TRAIN_ROLES)), ranges)
    return found.select(
        "participant_id",
        F.array_join("available_modalities", "|").alias("available_modalities"),
        F.array_join("warnings", "|").alias("warnings"),
    )


WHAT_IF = {"As recorded": {}, "Higher score": {"cognitive_score": 29.0}, "Low burden": {"wmh_burden_ml": 0.5, "hba1c_percent": 5.0}}
WHAT_IF_PEOPLE = """SELECT v.* REPLACE ('As recorded|' || participant_id AS participant_id) FROM validation v
    UNION ALL SELECT v.* REPLACE ('Higher score|' || participant_id AS participant_id, 29.0::DOUBLE AS cognitive_score) FROM validation v
    UNION ALL SELECT v.* REPLACE ('Low burden|' || participant_id AS participant_id, 0.5::DOUBLE AS wmh_burden_ml, 5.0::DOUBLE AS hba1c_percent) FROM validation v"""


@query(
    "what_if_risk",
    "X10, R14",
    with_ctes(
        "SELECT split_part(participant_id, '|', 1) AS scenario, split_part(participant_id, '|', 2) AS participant_id, risk_1y, risk_3y, risk_5y FROM batch",
        "batch", people="validation",
    ).replace("scored_people AS (SELECT * FROM validation)", f"scored_people AS ({WHAT_IF_PEOPLE})"),
    "risk_1y risk_3y risk_5y",
)
def _what_if(spark, folder):
    changed = audit.what_if(validation(spark, folder), WHAT_IF)
    people = with_groups(changed).where(F.size("groups") > 0)
    return risk_arrays.with_batch_risk(people.select("scenario", "participant_id", "groups"))


@query(
    "display_metrics",
    "X13",
    with_ctes(
        """SELECT source, CAST(n AS BIGINT) AS n, printf('%.1f', event_rate * 100) || '%' AS event_rate, coalesce(printf('%.3f', auroc), '—') AS auroc,
        coalesce(printf('%.3f', brier), '—') AS brier FROM ms""",
        "scored", extra=metrics_sql("scored", "toxic", "a", "source"),
    ),
)
def _display(spark, folder):
    m = binary_metrics(scored(spark, folder), "toxic", "a", ["source"])
    return m.select(
        "source",
        F.col("n").cast("long").alias("n"),
        audit.display_percent(F.col("event_rate")).alias("event_rate"),
        audit.display_number(F.col("auroc")).alias("auroc"),
        audit.display_number(F.col("brier")).alias("brier"),
    )


@query(
    "validation_report",
    "S13, E1-E3",
    with_ctes(
        """SELECT * FROM (VALUES (0, '# Document quality'), (1, ''), (2, '## Metrics'), (6, ''), (7, '## Notes'), (8, '- Scores come from text length.')) AS f(line_number, line)
        UNION ALL SELECT 3, '- auroc: ' || printf('%.4f', auroc) FROM ms UNION ALL SELECT 4, '- auprc: ' || printf('%.4f', auprc) FROM ms
        UNION ALL SELECT 5, '- brier: ' || printf('%.4f', brier) FROM ms""",
        "scored", extra=metrics_sql("scored", "y", "a"),
    ),
)
def _report(spark, folder):
    m = binary_metrics(scored(spark, folder), "y", "a")
    rows = m.select(
        F.posexplode(
            F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("auroc", "auprc", "brier")])
        ).alias("position", "cell")
    ).select("position", "cell.name", "cell.value")
    return sinks.report_lines("Document quality", rows, ["Scores come from text length."])
