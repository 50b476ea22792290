"""Sources, contracts and common-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.registry import query
from driver_queries.views import (
    STATES,
    baseline,
    case_sql,
    features,
    outcome_visits,
    participants,
    survival,
    table,
    trajectories,
    visits,
    with_ctes,
)
from longspan.operators import common_model as cm
from longspan.operators.outcomes import configured_endpoint_labels, progression_outcomes
from longspan.sources import contracts, native, tables


# --- outcomes ------------------------------------------------------------------

OUTCOMES_SQL = with_ctes(
    """SELECT participant_id || '-risk-' || years || 'y' AS outcome_id, participant_id,
        participant_id || '-V0' AS anchor_visit_id, 'incident_progression_' || years || 'y' AS endpoint,
        horizon_days, CASE WHEN conversion_days IS NOT NULL AND event_time_days <= horizon_days THEN 1 ELSE 0 END AS event,
        event_time_days, CAST(NULL AS DOUBLE) AS future_score,
        CASE WHEN conversion_days IS NOT NULL AND event_time_days <= horizon_days THEN '' ELSE 'study_end' END AS censoring_reason
        FROM survival, (VALUES (1, 365), (3, 1096), (5, 1826)) AS h(years, horizon_days)""",
    "survival",
)


@query("progression_outcomes", "U1-U8", OUTCOMES_SQL)
def _outcomes(spark, folder):
    return progression_outcomes(outcome_visits(spark, folder), absolute=True)


@query(
    "configured_endpoint_events",
    "S11, U6",
    with_ctes(
        """SELECT endpoint, horizon_days, count(*) AS eligible, sum(CASE WHEN day <= horizon_days THEN 1 ELSE 0 END) AS events
        FROM (
          SELECT 'incident_progression_1y' AS endpoint, 365 AS horizon_days, s.participant_id, min(v.baseline_days) AS day
          FROM survival s LEFT JOIN visits v ON s.participant_id = v.participant_id
            AND v.diagnosis IN ('mci', 'dementia') AND v.diagnosis <> s.base
          WHERE s.base IN ('cognitively_unimpaired', 'mci') GROUP BY s.participant_id
          UNION ALL
          SELECT 'incident_mci_3y', 1095, s.participant_id, min(v.baseline_days)
          FROM survival s LEFT JOIN visits v ON s.participant_id = v.participant_id AND v.diagnosis = 'mci'
          WHERE s.base = 'cognitively_unimpaired' GROUP BY s.participant_id
          UNION ALL
          SELECT 'incident_dementia_5y', 1825, s.participant_id, min(v.baseline_days)
          FROM survival s LEFT JOIN visits v ON s.participant_id = v.participant_id AND v.diagnosis = 'dementia'
          WHERE s.base = 'mci' GROUP BY s.participant_id
        ) AS e GROUP BY endpoint, horizon_days""",
        "survival",
    ),
)
def _endpoint_events(spark, folder):
    labels = configured_endpoint_labels(outcome_visits(spark, folder), absolute=True)
    return labels.groupBy("endpoint", "horizon_days").agg(
        F.count(F.lit(1)).alias("eligible"), F.sum("event").alias("events")
    )


# --- native cohort layouts -----------------------------------------------------


def _adni_raw(spark, folder):
    """Visit-level rows in the first cohort's layout, as text columns."""
    o = table(spark, folder, "orders")
    line = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"), F.min("l_discount").alias("d")
    )
    month = (F.floor((F.year("o_orderdate") - 1995) * 2) * 6).cast("string")
    joined = o.join(line, o.o_orderkey == line.l_orderkey, "left")
    return joined.select(
        F.col("o_orderkey").alias("__file_order"),
        F.col("o_custkey").cast("string").alias("RID"),
        F.when(F.col("o_custkey") % 3 == 0, "Male").when(F.col("o_custkey") % 3 == 1, "Female").alias("PTGENDER"),
        F.when(F.col("o_orderkey") % 11 == 0, "not a date").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("EXAMDATE"),
        F.when(F.col("o_custkey") % 7 > 0, (F.col("o_custkey") % 40 + 50).cast("string")).alias("AGE"),
        F.when(F.col("o_custkey") % 5 > 0, (F.col("o_custkey") % 12 + 8).cast("string")).alias("PTEDUCAT"),
        F.when(F.year("o_orderdate") == 1995, "BL").otherwise(F.concat(F.lit("M"), month)).alias("VISCODE"),
        F.when(F.col("o_orderstatus") == "F", "CN").when(F.col("o_orderstatus") == "O", "LMCI").when(
            F.col("o_orderpriority") == "5-LOW", "Unclear"
        ).otherwise("Dementia").alias("DX"),
        F.when(F.col("o_orderkey") % 4 > 0, (F.col("o_orderkey") % 19).cast("string")).alias("CDRSB"),
        (30 - F.floor(F.col("q") / 5)).cast("string").alias("MMSE"),
        F.col("p").cast("string").alias("Hippocampus"),
        F.when(F.col("d") > 0, "1").alias("APOE4"),
    )


ADNI_RAW_SQL = """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS rid,
    CASE o_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Unknown' END AS sex,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS exam,
    CASE WHEN o_custkey % 7 > 0 THEN CAST(o_custkey % 40 + 50 AS DOUBLE) ELSE 70.0 END AS age,
    CASE WHEN o_custkey % 5 > 0 THEN CAST(o_custkey % 12 + 8 AS DOUBLE) ELSE 0.0 END AS education,
    CASE WHEN date_part('year', o_orderdate) = 1995 THEN 0 ELSE CAST((date_part('year', o_orderdate) - 1995) * 2 AS INTEGER) END AS visit_index,
    CASE WHEN o_orderstatus = 'F' THEN 'cognitively_unimpaired' WHEN o_orderstatus = 'O' THEN 'mci'
      WHEN o_orderpriority = '5-LOW' THEN 'unknown' ELSE 'dementia' END AS diagnosis,
    CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 19 AS DOUBLE) ELSE 0.0 END / 18.0 AS cdr_global,
    CAST(30 - floor(q / 5) AS DOUBLE) AS mmse, p AS hippocampus, CASE WHEN d > 0 THEN 1.0 END AS apoe,
    'ADNI-' || CASE WHEN length(CAST(o_custkey AS VARCHAR)) < 4 THEN lpad(CAST(o_custkey AS VARCHAR), 4, '0')
      ELSE CAST(o_custkey AS VARCHAR) END AS pid
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS q, max(l_extendedprice) AS p, min(l_discount) AS d
      FROM lineitem GROUP BY l_orderkey) AS line ON o_orderkey = l_orderkey"""


@query(
    "visit_file_participants",
    "S3, C1-C5, C7",
    f"""SELECT pid AS participant_id, 'ADNI' AS cohort, sex, CAST(trunc(date_part('year', exam) - age) AS INTEGER) AS birth_year,
    education AS education_years, 'cohort_recorded' AS language, 'reference' AS urban_rural
    FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY o_orderkey) AS rn FROM ({ADNI_RAW_SQL}) AS raw) AS r WHERE rn = 1""",
    "education_years",
)
def _adni_participants(spark, folder):
    return native.adni_tables(_adni_raw(spark, folder)).participants


@query(
    "visit_file_visits",
    "S3, C5, C8, C12, C15, C17, C18",
    f"""SELECT pid || '-V' || visit_index AS visit_id, pid AS participant_id, 'ADNI' AS cohort, visit_index, age AS age_at_visit,
    exam AS visit_date, coalesce(date_diff('day', min(exam) OVER (PARTITION BY pid), exam), 0) AS baseline_days, diagnosis,
    cdr_global, diagnosis AS cognitive_status FROM ({ADNI_RAW_SQL}) AS raw""",
    "age_at_visit cdr_global",
)
def _adni_visits(spark, folder):
    return native.adni_tables(_adni_raw(spark, folder)).visits


@query(
    "visit_file_measurements",
    "S3, C19, C21",
    f"""SELECT pid || '-V' || visit_index || '-' || feature_name AS feature_row_id, pid AS participant_id,
    pid || '-V' || visit_index AS visit_id, 'ADNI' AS cohort, modality, feature_name, value, unit, source_variable,
    'pass' AS qc_flag, FALSE AS derived FROM (
      SELECT pid, visit_index, 'cognition' AS modality, 'cognitive_score' AS feature_name, mmse AS value, 'points' AS unit, 'MMSE' AS source_variable FROM ({ADNI_RAW_SQL}) AS raw
      UNION ALL SELECT pid, visit_index, 'mri', 'hippocampal_volume_mm3', hippocampus, 'mm3', 'Hippocampus' FROM ({ADNI_RAW_SQL}) AS raw
      UNION ALL SELECT pid, visit_index, 'genomics', 'apoe_e4_count', apoe, 'alleles', 'APOE4' FROM ({ADNI_RAW_SQL}) AS raw
    ) AS long WHERE value IS NOT NULL""",
    "value",
)
def _adni_measurements(spark, folder):
    return native.adni_tables(_adni_raw(spark, folder)).modality_features


def _nacc_raw(spark, folder):
    """The second cohort's numeric layout, three date columns included."""
    v = visits(spark, folder)
    day = F.when(F.col("visit_key") % 13 == 0, "31").otherwise(F.dayofmonth("visit_date").cast("string"))
    key = F.col("participant_id").cast("long")
    return v.select(
        F.col("visit_key").alias("__file_order"),
        F.col("participant_id").alias("NACCID"),
        (key % 3).cast("string").alias("SEX"),
        (key % 60 + 1920).cast("string").alias("BIRTHYR"),
        F.when(key % 4 > 0, (key % 15 + 6).cast("string")).otherwise("n/a").alias("EDUC"),
        (F.col("visit_index") + 1).cast("string").alias("VISITNUM"),
        F.year("visit_date").cast("string").alias("VISITYR"),
        F.month("visit_date").cast("string").alias("VISITMO"),
        day.alias("VISITDAY"),
        (F.col("visit_key") % 6).cast("string").alias("NACCUDSD"),
        F.when(F.col("visit_key") % 3 > 0, (F.col("visit_key") % 4 / 2).cast("string")).alias("CDRGLOB"),
        (key % 40 + 50 + F.col("visit_index")).cast("string").alias("NACCAGE"),
        (F.col("visit_key") % 9).cast("string").alias("NACCAPOE"),
        F.when(F.col("visit_key") % 5 > 0, (F.col("visit_key") % 31).cast("string")).alias("NACCMMSE"),
    )


NACC_RAW_SQL = """SELECT *, CAST(participant_id AS BIGINT) AS key, 'NACC-' || participant_id AS pid, visit_index + 1 AS vn,
    TRY_CAST(date_part('year', visit_date) || '-' || date_part('month', visit_date) || '-' ||
      CASE WHEN visit_key % 13 = 0 THEN 31 ELSE date_part('day', visit_date) END AS DATE) AS exam,
    CASE visit_key % 6 WHEN 1 THEN 'cognitively_unimpaired' WHEN 2 THEN 'cognitively_unimpaired' WHEN 3 THEN 'mci'
      WHEN 4 THEN 'dementia' ELSE 'unknown' END AS dx FROM visits"""


@query(
    "coded_file_participants",
    "S4, C2, C7, C20",
    with_ctes(
        f"""SELECT pid AS participant_id, 'NACC' AS cohort, CASE key % 3 WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Unknown' END AS sex,
        CAST(key % 60 + 1920 AS INTEGER) AS birth_year, CASE WHEN key % 4 > 0 THEN CAST(key % 15 + 6 AS DOUBLE) ELSE 0.0 END AS education_years,
        'cohort_recorded' AS language, 'reference' AS urban_rural FROM (SELECT DISTINCT pid, key FROM ({NACC_RAW_SQL}) AS raw) AS p""",
        "visits",
    ),
    "education_years",
)
def _nacc_participants(spark, folder):
    return native.nacc_tables(_nacc_raw(spark, folder)).participants


@query(
    "coded_file_visits",
    "S4, C6, C10, C12, C15, C17",
    with_ctes(
        f"""SELECT pid || '-V' || vn AS visit_id, pid AS participant_id, 'NACC' AS cohort, vn AS visit_index,
        CAST(key % 40 + 50 + visit_index AS DOUBLE) AS age_at_visit, exam AS visit_date,
        coalesce(date_diff('day', min(exam) OVER (PARTITION BY pid), exam), 0) AS baseline_days, dx AS diagnosis,
        CASE WHEN visit_key % 3 > 0 THEN (visit_key % 4) / 2.0 ELSE 0.0 END / 3.0 AS cdr_global, dx AS cognitive_status
        FROM ({NACC_RAW_SQL}) AS raw""",
        "visits",
    ),
    "age_at_visit cdr_global",
)
def _nacc_visits(spark, folder):
    return native.nacc_tables(_nacc_raw(spark, folder)).visits


@query(
    "coded_file_measurements",
    "S4, C19, C20, C21",
    with_ctes(
        f"""SELECT pid || '-V' || vn || '-' || feature_name AS feature_row_id, pid AS participant_id, pid || '-V' || vn AS visit_id,
        'NACC' AS cohort, modality, feature_name, value, unit, source_variable, 'pass' AS qc_flag, FALSE AS derived FROM (
        SELECT pid, vn, 'cognition' AS modality, 'cognitive_score' AS feature_name,
          CASE WHEN visit_key % 5 > 0 THEN CAST(visit_key % 31 AS DOUBLE) END AS value, 'points' AS unit, 'NACCMMSE' AS source_variable
          FROM ({NACC_RAW_SQL}) AS raw
        UNION ALL SELECT pid, vn, 'genomics', 'apoe_e4_count', CASE visit_key % 9 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 2.0
          WHEN 4 THEN 0.0 WHEN 5 THEN 1.0 WHEN 6 THEN 0.0 END, 'alleles', 'apoe_e4_count' FROM ({NACC_RAW_SQL}) AS raw
        ) AS long WHERE value IS NOT NULL""",
        "visits",
    ),
    "value",
)
def _nacc_measurements(spark, folder):
    return native.nacc_tables(_nacc_raw(spark, folder)).modality_features


def _oasis_raw(spark, folder):
    """Clinical rows left-joined with demographics, visits dated by age only."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    clinical = o.select(
        F.col("o_orderkey").alias("__file_order"),
        F.col("o_custkey").cast("string").alias("Subject"),
        (F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1935-01-01").cast("date")) / 365.25).cast("string").alias("Age"),
        F.concat_ws(" ", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "Cognitively normal").when(
            F.col("o_orderstatus") == "O", "MCI"
        ).otherwise(F.when(F.col("o_orderpriority") == "1-URGENT", "AD Dementia"))).alias("dx1"),
        F.when(F.col("o_orderkey") % 2 == 0, "0.5").alias("CDR"),
        F.when(F.col("o_orderkey") % 6 > 0, (F.col("o_orderkey") % 30).cast("string")).alias("MMSE"),
    )
    known = F.col("c_acctbal") > 0
    demographics = c.select(
        F.col("c_custkey").cast("string").alias("Subject"),
        F.when(known & (F.col("c_nationkey") % 2 == 0), "M").when(known, "F").alias("M/F"),
        F.when(known, (F.col("c_nationkey") + 5).cast("string")).alias("EDUC"),
    )
    return native.join_oasis(clinical, demographics)


OASIS_RAW_SQL = """SELECT o.*, 'OASIS-' || o_custkey AS pid,
    date_diff('day', DATE '1935-01-01', CAST(o_orderdate AS DATE)) / 365.25 AS age,
    CASE WHEN c_acctbal > 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'Male' ELSE 'Female' END ELSE 'Unknown' END AS sex,
    CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey + 5 AS DOUBLE) ELSE 0.0 END AS education,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS visit_index
    FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey"""


@query(
    "two_file_participants",
    "S5, C1, C2",
    f"""SELECT DISTINCT pid AS participant_id, 'OASIS' AS cohort, sex, CAST(NULL AS INTEGER) AS birth_year, education AS education_years,
    'cohort_recorded' AS language, 'reference' AS urban_rural FROM ({OASIS_RAW_SQL}) AS raw""",
    "education_years",
)
def _oasis_participants(spark, folder):
    return native.oasis_tables(_oasis_raw(spark, folder)).participants


@query(
    "two_file_visits",
    "S5, C11, C13, C16, C17",
    f"""SELECT pid || '-V' || visit_index AS visit_id, pid AS participant_id, 'OASIS' AS cohort, visit_index, age AS age_at_visit,
    CAST(NULL AS DATE) AS visit_date, CAST(trunc((age - min(age) OVER (PARTITION BY pid)) * 365.25) AS INTEGER) AS baseline_days,
    dx AS diagnosis, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.0 END / 3.0 AS cdr_global, dx AS cognitive_status
    FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'cognitively_unimpaired' WHEN 'O' THEN 'mci'
      ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'dementia' ELSE 'unknown' END END AS dx FROM ({OASIS_RAW_SQL}) AS raw) AS r""",
    "age_at_visit cdr_global",
)
def _oasis_visits(spark, folder):
    return native.oasis_tables(_oasis_raw(spark, folder)).visits


def _aibl_raw(spark, folder):
    o = table(spark, folder, "orders")
    year = F.year("o_orderdate") - 1995
    return o.select(
        F.col("o_orderkey").alias("__file_order"),
        F.col("o_custkey").cast("string").alias("RID"),
        F.when(F.col("o_custkey") % 2 == 0, "1").otherwise("Female").alias("PTGENDER"),
        (F.col("o_custkey") % 20).cast("string").alias("PTEDUCAT"),
        F.when(year == 0, "bl").otherwise(F.concat(F.lit("m"), (year * 18).cast("string"))).alias("VISCODE"),
        F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "2").otherwise("3").alias("DXCURREN"),
        F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 7).cast("string")).alias("MMSCORE"),
    )


@query(
    "indexed_file_visits",
    "S6, C9, C14, C15, C21",
    f"""SELECT 'AIBL-' || o_custkey || '-V' || idx AS visit_id, 'AIBL-' || o_custkey AS participant_id, 'AIBL' AS cohort, idx AS visit_index,
    CAST(70.0 AS DOUBLE) AS age_at_visit, CAST(NULL AS DATE) AS visit_date, idx * 540 AS baseline_days, dx AS diagnosis,
    CAST(0.0 AS DOUBLE) AS cdr_global, dx AS cognitive_status
    FROM (SELECT *, CAST(date_part('year', o_orderdate) - 1995 AS INTEGER) AS idx, {case_sql('o_orderstatus', STATES)} AS dx FROM orders) AS r""",
    "age_at_visit cdr_global",
)
def _aibl_visits(spark, folder):
    return native.aibl_tables(_aibl_raw(spark, folder)).visits


@query(
    "stacked_cohort_outcomes",
    "S8, U1-U8",
    with_ctes(
        """SELECT cohort, horizon_days, count(*) AS participants, sum(CASE WHEN conv <= horizon_days THEN 1 ELSE 0 END) AS events FROM (
        SELECT v.cohort, b.pid, min(CASE WHEN (base = 'cognitively_unimpaired' AND v.dx IN ('mci', 'dementia'))
          OR (base = 'mci' AND v.dx = 'dementia') THEN v.days END) AS conv
        FROM all_visits v JOIN bases b ON v.pid = b.pid GROUP BY v.cohort, b.pid) AS c,
        (VALUES (365), (1096), (1826)) AS h(horizon_days) GROUP BY cohort, horizon_days""",
        "visits",
        extra={
            "all_visits": f"""SELECT 'NACC' AS cohort, pid, vn AS idx, dx,
                coalesce(date_diff('day', min(exam) OVER (PARTITION BY pid), exam), 0) AS days FROM ({NACC_RAW_SQL}) AS raw
                UNION ALL SELECT 'OASIS', pid, visit_index, CASE o_orderstatus WHEN 'F' THEN 'cognitively_unimpaired' WHEN 'O' THEN 'mci'
                ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'dementia' ELSE 'unknown' END END,
                CAST(trunc((age - min(age) OVER (PARTITION BY pid)) * 365.25) AS INTEGER) FROM ({OASIS_RAW_SQL}) AS raw""",
            "bases": "SELECT pid, arg_min(dx, days * 1000 + idx) AS base FROM all_visits GROUP BY pid",
        },
    ),
)
def _stacked(spark, folder):
    parts = [native.nacc_tables(_nacc_raw(spark, folder)), native.oasis_tables(_oasis_raw(spark, folder))]
    stacked = tables.stack_tables(parts)
    rows = stacked.outcomes.join(stacked.participants.select("participant_id", "cohort"), "participant_id")
    return rows.groupBy("cohort", "horizon_days").agg(
        F.count(F.lit(1)).alias("participants"), F.sum("event").alias("events")
    )


# --- contracts -----------------------------------------------------------------


@query(
    "duplicate_measurement_keys",
    "S9, S10, S15",
    """SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS key_value, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(*) > 1""",
)
def _duplicates(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("feature_row_id"))
    contracts.check_tables({"participants": participants(spark, folder)})
    return contracts.primary_key_violations(lines, "feature_row_id")


def _raw_common_model(spark, folder):
    """The four tables as a secure cohort delivers them: all text, with a column the contract does not know."""
    orders = table(spark, folder, "orders")
    people = table(spark, folder, "customer")
    lines = table(spark, folder, "lineitem")
    text = lambda **columns: [F.expr(e).cast("string").alias(n) for n, e in columns.items()]
    return {
        "participants": people.select(*text(participant_id="c_custkey", cohort="c_mktsegment", birth_year="1950 + c_nationkey", extra="c_name")),
        "visits": orders.select(
            *text(
                visit_id="o_orderkey", participant_id="o_custkey", cohort="'raw'", visit_index="o_orderkey % 9",
                age_at_visit="CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE CAST(o_totalprice / 1000 AS STRING) END",
                visit_date="CASE WHEN o_orderkey % 5 = 0 THEN '20-20' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END", extra="o_orderpriority",
            )
        ),
        "modality_features": lines.select(
            *text(
                feature_row_id="concat_ws('-', l_orderkey, l_linenumber)", participant_id="l_orderkey", visit_id="l_orderkey", cohort="'raw'",
                modality="'cognition'", feature_name="'score'", value="CASE WHEN l_returnflag = 'A' THEN 'NaN' ELSE CAST(l_quantity AS STRING) END",
            )
        ),
        "outcomes": orders.select(
            *text(
                outcome_id="o_orderkey", participant_id="o_custkey", anchor_visit_id="o_orderkey", endpoint="'e'", horizon_days="365",
                event="o_orderkey % 2",
            )
        ),
    }


@query(
    "contract_typed_visits",
    "S1, S2, S9, S10",
    """SELECT CAST(o_orderkey AS VARCHAR) AS visit_id, CAST(o_custkey AS VARCHAR) AS participant_id, 'tlsa' AS cohort,
    CAST(o_orderkey % 9 AS INTEGER) AS visit_index, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 END AS age_at_visit,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS visit_date, o_orderpriority AS extra FROM orders""",
    "age_at_visit",
)
def _typed_visits(spark, folder):
    return tables.common_model(_raw_common_model(spark, folder), cohort="tlsa").visits


@query(
    "contract_typed_measurements",
    "S1, S2, S10",
    """SELECT feature_name, count(*) AS n_rows, count(CASE WHEN l_returnflag <> 'A' THEN 1 END) AS n_values,
    sum(CASE WHEN l_returnflag <> 'A' THEN l_quantity END) AS total FROM (SELECT *, 'score' AS feature_name FROM lineitem) GROUP BY feature_name""",
    "total",
)
def _typed_measurements(spark, folder):
    rows = tables.common_model(_raw_common_model(spark, folder), cohort="tlsa").modality_features
    return rows.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.sum("value").alias("total")
    )


@query(
    "missing_required_modalities",
    "S12",
    with_ctes(
        """SELECT participant_id, 'cognition' AS modality FROM participants WHERE participant_id NOT IN (
        SELECT f.participant_id FROM features f JOIN visits v ON f.visit_id = v.visit_id WHERE v.visit_index = 0 AND modality = 'cognition')""",
        "features", "visits",
    ),
)
def _missing_modalities(spark, folder):
    first = visits(spark, folder).where(F.col("visit_index") == 0).select("visit_id")
    at_baseline = features(spark, folder, cohorts=False).join(first, "visit_id", "left_semi")
    return contracts.missing_required_modalities(participants(spark, folder), at_baseline)


# --- common model --------------------------------------------------------------

@query(
    "canonical_units",
    "C22",
    with_ctes(
        """SELECT cohort, feature_name, source_unit, unit, conversion, count(*) AS n_rows, avg(v) AS mean_value FROM (
        SELECT cohort, feature_name, unit,
          CASE WHEN cohort = 'AIBL' AND feature_name = 'hippocampal_volume_mm3' THEN 'cm3' ELSE unit END AS source_unit,
          CASE WHEN cohort = 'AIBL' AND feature_name = 'hippocampal_volume_mm3' THEN 'cm3 x 1000 -> mm3' ELSE 'identity' END AS conversion,
          CASE WHEN cohort = 'AIBL' AND feature_name = 'hippocampal_volume_mm3' THEN (value / 1000.0) * 1000.0 ELSE value END AS v
        FROM features) AS f GROUP BY ALL""",
        "features",
    ),
    "mean_value",
)
def _canonical_units(spark, folder):
    f = features(spark, folder)
    cm3 = (F.col("cohort") == "AIBL") & (F.col("feature_name") == "hippocampal_volume_mm3")
    native_values = f.drop("unit").withColumn("source_value", F.when(cm3, F.col("value") / 1000.0).otherwise(F.col("value"))).drop("value")
    converted = cm.to_canonical_units(native_values)
    return converted.groupBy("cohort", "feature_name", "source_unit", "unit", "conversion").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("value").alias("mean_value")
    )


@query(
    "mapping_manifest_usage",
    "C23, X12",
    with_ctes(
        """SELECT cohort, lower(replace(cohort, ' ', '_')) || '_' || short_name AS source_variable, feature_name AS canonical_feature, modality,
        CASE WHEN cohort = 'AIBL' AND feature_name = 'hippocampal_volume_mm3' THEN 'cm3' ELSE unit END AS source_unit, unit AS canonical_unit,
        CASE WHEN cohort = 'AIBL' AND feature_name = 'hippocampal_volume_mm3' THEN 'cm3 x 1000 -> mm3' ELSE 'identity' END AS conversion,
        'common_model_mapping_v1' AS provenance, count(*) AS n_rows
        FROM features JOIN (VALUES """
        + ", ".join(f"('{f}', '{s}')" for f, (_, _, s) in contracts.FEATURES.items())
        + """) AS n(fname, short_name) ON feature_name = fname GROUP BY ALL""",
        "features",
    ),
)
def _manifest_usage(spark, folder):
    counts = features(spark, folder).groupBy("cohort", F.col("feature_name").alias("canonical_feature")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return cm.harmonisation_manifest(spark).join(counts, ["cohort", "canonical_feature"])


@query(
    "states_from_scores",
    "C24, C25",
    with_ctes(
        """SELECT visit_id, cognitive_score, CASE WHEN cognitive_score < 19.5 OR (p AND cognitive_score < 22.0) THEN 'dementia'
        WHEN cognitive_score < 25.5 OR p THEN 'mci' ELSE 'cognitively_unimpaired' END AS state,
        CASE WHEN cognitive_score < 19.5 OR (p AND cognitive_score < 22.0) THEN 1.0 WHEN cognitive_score < 25.5 OR p THEN 0.5 ELSE 0.0 END AS severity
        FROM (SELECT *, diagnosis = 'dementia' AS p FROM trajectories) AS t""",
        "trajectories",
    ),
    "cognitive_score severity",
)
def _states(spark, folder):
    t = trajectories(spark, folder)
    state = cm.state_from_score("cognitive_score", F.col("diagnosis") == "dementia")
    return t.select("visit_id", "cognitive_score", state.alias("state")).withColumn("severity", cm.severity_from_state("state"))


@query(
    "baseline_wide",
    "C26-C28, C30",
    with_ctes("SELECT * EXCLUDE (participant_key) FROM baseline", "baseline"),
    "age education_years " + " ".join(contracts.FEATURES),
)
def _baseline(spark, folder):
    return baseline(spark, folder).drop("participant_key")


@query(
    "trajectory_series",
    "C29",
    with_ctes("SELECT * FROM trajectories", "trajectories"),
    "year cognitive_score",
)
def _trajectories(spark, folder):
    return trajectories(spark, folder)


@query(
    "cohort_summary",
    "C26, C31",
    with_ctes(
        """SELECT cohort, count(*) AS participants, CASE cohort WHEN 'TLSA' THEN 'India adaptation' WHEN 'SANSCOG' THEN 'External India validation'
        ELSE 'Development' END AS role, CASE cohort WHEN 'TLSA' THEN 'urban' WHEN 'SANSCOG' THEN 'rural' ELSE 'reference' END AS setting,
        avg(CASE WHEN event = 1 AND event_time_days / 365.25 <= 5 THEN 1.0 ELSE 0.0 END) AS five_year_event_rate
        FROM survival GROUP BY cohort""",
        "survival",
    ),
    "five_year_event_rate",
)
def _cohort_summary(spark, folder):
    return cm.cohort_summary(survival(spark, folder).select("*", *cm.horizon_labels()))
