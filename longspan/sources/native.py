"""Cohort-native CSV layouts mapped to the common model.

Every cohort has a ``*_tables(raw)`` function over an all-string frame and a
``read_*`` function that scans the files. Code maps, ids and dates differ per
cohort; unpivot, visit and outcome steps are shared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.functions.columns import (
    coerce_date,
    coerce_integer,
    coerce_number,
    date_from_parts,
    first_substring_rule,
    map_codes,
    month_visit_codes,
    pick,
    prefixed_id,
)
from longspan.operators.common_model import days_since_first, long_measurements
from longspan.operators.ordered import position_within
from longspan.operators.outcomes import progression_outcomes
from longspan.sources.tables import FILE_ORDER, CohortTables, scan_text

# Diagnosis codes per cohort.
ADNI_DIAGNOSES = {
    "CN": "cognitively_unimpaired", "SMC": "cognitively_unimpaired", "EMCI": "mci", "LMCI": "mci", "MCI": "mci",
    "AD": "dementia", "Dementia": "dementia",
}
NACC_DIAGNOSES = {1: "cognitively_unimpaired", 2: "cognitively_unimpaired", 3: "mci", 4: "dementia"}
AIBL_DIAGNOSES = {1: "cognitively_unimpaired", 2: "mci", 3: "dementia"}
OASIS_DIAGNOSIS_RULES = (
    (("normal", "cn"), "cognitively_unimpaired"),
    (("mci",), "mci"),
    (("ad", "dementia"), "dementia"),
)

# Sex codes per cohort.
ADNI_SEX = {"Male": "Male", "Female": "Female"}
NACC_SEX = {1: "Male", 2: "Female"}
OASIS_SEX = {"M": "Male", "F": "Female"}
AIBL_SEX = {"1": "Male", "2": "Female", "Male": "Male", "Female": "Female"}

# Genotype code -> number of e4 alleles.
NACC_E4_ALLELES = {1: 0, 2: 1, 3: 2, 4: 0, 5: 1, 6: 0}

# Source column -> (modality, feature, unit).
ADNI_MEASURES = {
    "MMSE": ("cognition", "cognitive_score", "points"),
    "RAVLT_immediate": ("cognition", "memory_score", "z-score"),
    "Hippocampus": ("mri", "hippocampal_volume_mm3", "mm3"),
    "Ventricles": ("mri", "ventricular_volume_mm3", "mm3"),
    "WholeBrain": ("mri", "whole_brain_volume_mm3", "mm3"),
    "Entorhinal": ("mri", "entorhinal_thickness_mm", "mm"),
    "MidTemp": ("mri", "midtemp_thickness_mm", "mm"),
    "APOE4": ("genomics", "apoe_e4_count", "alleles"),
}
NACC_MEASURES = {
    "NACCMMSE": ("cognition", "cognitive_score", "points"),
    "MOCATOTS": ("cognition", "moca_score", "points"),
    "apoe_e4_count": ("genomics", "apoe_e4_count", "alleles"),
}
OASIS_MEASURES = {"MMSE": ("cognition", "cognitive_score", "points")}
AIBL_MEASURES = {"MMSCORE": ("cognition", "cognitive_score", "points")}

ADNI_VISIT_CODES = month_visit_codes(6, 174, ("bl", "sc"), 6, padded=True)
AIBL_VISIT_CODES = month_visit_codes(18, 126, ("bl",), 18, padded=False)


def _first_rows(raw: DataFrame, key: str, order: str) -> DataFrame:
    """First row of every entity by an explicit order; a hash aggregate, no sort."""
    rest = [c for c in raw.columns if c not in (key, order)]
    packed = F.struct(*[F.col(f"`{c}`").alias(c) for c in rest])
    return (
        raw.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min_by(packed, F.col(order)).alias("__row"))
        .select(key, "__row.*")
    )


def _participants(first: DataFrame, pid: Column, cohort: str, sex: Column, birth_year: Column, education: Column) -> DataFrame:
    return first.select(
        pid.alias("participant_id"),
        F.lit(cohort).alias("cohort"),
        sex.alias("sex"),
        birth_year.cast("int").alias("birth_year"),
        F.coalesce(education, F.lit(0.0)).alias("education_years"),
        F.lit("cohort_recorded").alias("language"),
        F.lit("reference").alias("urban_rural"),
    )


def _visits(staged: DataFrame, cohort: str, age: Column, date: Column, severity: Column) -> DataFrame:
    """Shared visit projection; ``staged`` has participant_id, visit_index, baseline_days, diagnosis."""
    return staged.select(
        F.concat("participant_id", F.lit("-V"), F.col("visit_index").cast("string")).alias("visit_id"),
        "participant_id",
        F.lit(cohort).alias("cohort"),
        "visit_index",
        age.alias("age_at_visit"),
        date.alias("visit_date"),
        "baseline_days",
        "diagnosis",
        severity.alias("cdr_global"),
        F.col("diagnosis").alias("cognitive_status"),
    )


def _bundle(participants: DataFrame, visits: DataFrame, staged: DataFrame, measures: dict, cohort: str) -> CohortTables:
    keyed = staged.withColumn(
        "visit_id", F.concat("participant_id", F.lit("-V"), F.col("visit_index").cast("string"))
    )
    return CohortTables(participants, visits, long_measurements(keyed, measures, cohort), progression_outcomes(visits))


def adni_tables(raw: DataFrame, order: str = FILE_ORDER, cohort: str = "ADNI") -> CohortTables:
    pid = prefixed_id("ADNI-", "RID", width=4)
    exam = coerce_date("EXAMDATE")
    age = F.coalesce(coerce_number("AGE"), F.lit(70.0))
    participants = _participants(
        _first_rows(raw, "RID", order),
        pid,
        cohort,
        map_codes("PTGENDER", ADNI_SEX, "Unknown"),
        F.year(exam) - age,
        coerce_number("PTEDUCAT"),
    )
    staged = raw.select(
        "*",
        pid.alias("participant_id"),
        exam.alias("exam_date"),
        map_codes(F.lower("VISCODE"), ADNI_VISIT_CODES, 0).alias("visit_index"),
        map_codes("DX", ADNI_DIAGNOSES, "unknown").alias("diagnosis"),
    )
    staged = days_since_first(staged, "exam_date", missing=0)
    severity = F.coalesce(coerce_number(pick(raw, "CDRSB")), F.lit(0.0)) / 18.0
    return _bundle(participants, _visits(staged, cohort, age, F.col("exam_date"), severity), staged, ADNI_MEASURES, cohort)


def nacc_tables(raw: DataFrame, order: str = FILE_ORDER, cohort: str = "NACC") -> CohortTables:
    pid = prefixed_id("NACC-", "NACCID")
    participants = _participants(
        _first_rows(raw, "NACCID", order),
        pid,
        cohort,
        map_codes(coerce_integer(pick(raw, "SEX")), NACC_SEX, "Unknown"),
        coerce_integer(pick(raw, "BIRTHYR")),
        coerce_number(pick(raw, "EDUC")),
    )
    if all(c in raw.columns for c in ("VISITYR", "VISITMO", "VISITDAY")):
        exam = date_from_parts("VISITYR", "VISITMO", "VISITDAY")
    else:
        exam = F.lit(None).cast("date")
    staged = raw.select(
        "*",
        pid.alias("participant_id"),
        exam.alias("exam_date"),
        F.coalesce(coerce_integer(pick(raw, "VISITNUM", 0)), F.lit(0)).alias("visit_index"),
        map_codes(coerce_integer(pick(raw, "NACCUDSD")), NACC_DIAGNOSES, "unknown").alias("diagnosis"),
        *(
            [map_codes(coerce_integer("NACCAPOE"), NACC_E4_ALLELES).cast("string").alias("apoe_e4_count")]
            if "NACCAPOE" in raw.columns
            else []
        ),
    )
    staged = days_since_first(staged, "exam_date", missing=0)
    age = coerce_number(pick(raw, "NACCAGE", 70.0))
    severity = F.coalesce(coerce_number(pick(raw, "CDRGLOB")), F.lit(0.0)) / 3.0
    return _bundle(participants, _visits(staged, cohort, age, F.col("exam_date"), severity), staged, NACC_MEASURES, cohort)


def oasis_tables(raw: DataFrame, order: str = FILE_ORDER, cohort: str = "OASIS") -> CohortTables:
    pid = prefixed_id("OASIS-", "Subject")
    participants = _participants(
        _first_rows(raw, "Subject", order),
        pid,
        cohort,
        map_codes(pick(raw, "M/F"), OASIS_SEX, "Unknown"),
        F.lit(None),
        coerce_number(pick(raw, "EDUC")),
    )
    staged = raw.select(
        "*",
        pid.alias("participant_id"),
        coerce_number("Age").alias("__age"),
        first_substring_rule(pick(raw, "dx1"), OASIS_DIAGNOSIS_RULES, "unknown").alias("diagnosis"),
    )
    # Visits are numbered by age; whole years of age are the ranges.
    staged = position_within(staged, ["participant_id"], "__age", order, "visit_index", range_key=F.floor("__age"))
    first_age = staged.groupBy("participant_id").agg(F.min("__age").alias("__first_age"))
    staged = staged.join(first_age, "participant_id").withColumn(
        "baseline_days", F.coalesce(((F.col("__age") - F.col("__first_age")) * 365.25).cast("int"), F.lit(0))
    )
    severity = F.coalesce(coerce_number(pick(raw, "CDR")), F.lit(0.0)) / 3.0
    no_date = F.lit(None).cast("date")
    return _bundle(participants, _visits(staged, cohort, F.col("__age"), no_date, severity), staged, OASIS_MEASURES, cohort)


def aibl_tables(raw: DataFrame, order: str = FILE_ORDER, cohort: str = "AIBL") -> CohortTables:
    pid = prefixed_id("AIBL-", "RID")
    participants = _participants(
        _first_rows(raw, "RID", order),
        pid,
        cohort,
        map_codes(pick(raw, "PTGENDER"), AIBL_SEX, "Unknown"),
        F.lit(None),
        coerce_number(pick(raw, "PTEDUCAT")),
    )
    staged = raw.select(
        "*",
        pid.alias("participant_id"),
        map_codes(F.lower(pick(raw, "VISCODE")), AIBL_VISIT_CODES, 0).alias("visit_index"),
        map_codes(coerce_integer(pick(raw, "DXCURREN")), AIBL_DIAGNOSES, "unknown").alias("diagnosis"),
    ).withColumn("baseline_days", F.col("visit_index") * 540)
    age = coerce_number(pick(raw, "AGE", 70.0))
    severity = F.coalesce(coerce_number(pick(raw, "CDRSB")), F.lit(0.0)) / 18.0
    no_date = F.lit(None).cast("date")
    return _bundle(participants, _visits(staged, cohort, age, no_date, severity), staged, AIBL_MEASURES, cohort)


def read_adni(spark: SparkSession, folder: str) -> CohortTables:
    return adni_tables(scan_text(spark, f"{folder}/ADNIMERGE.csv", "ADNIMERGE.csv"))


def read_nacc(spark: SparkSession, folder: str) -> CohortTables:
    return nacc_tables(scan_text(spark, f"{folder}/investigator_nacc.csv", "investigator_nacc.csv"))


def join_oasis(clinical: DataFrame, demographics: DataFrame) -> DataFrame:
    """Clinical rows with their demographics; no hint, both sides grow with the cohort."""
    return clinical.join(demographics, "Subject", "left")


def read_oasis(spark: SparkSession, folder: str) -> CohortTables:
    demographics = scan_text(spark, f"{folder}/OASIS3_demographics.csv", "OASIS3_demographics.csv").drop(FILE_ORDER)
    clinical = scan_text(spark, f"{folder}/OASIS3_clinical.csv", "OASIS3_clinical.csv")
    return oasis_tables(join_oasis(clinical, demographics))


def read_aibl(spark: SparkSession, folder: str) -> CohortTables:
    return aibl_tables(scan_text(spark, f"{folder}/aibl_clinical.csv", "aibl_clinical.csv"))


READERS = {"adni": read_adni, "nacc": read_nacc, "oasis": read_oasis, "aibl": read_aibl}


def sorted_for_output(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total order for a sink; operators themselves leave rows unordered."""
    return df.orderBy(*keys)
