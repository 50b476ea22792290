"""The driver tables seen as a longitudinal study, in Spark and in SQL.

customer -> participants, orders -> visits, lineitem -> long measurements,
documents + labels -> a scored binary table, events -> irregular series.
"""

from __future__ import annotations

from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longspan.functions.columns import DRAW_MODULI, clip, flag, map_codes, seeded_draw, seeded_draws
from longspan.operators.checks import TRAIN_ROLES, VALIDATION_ROLES
from longspan.operators.common_model import baseline_wide, days_since_first, may_match, trajectory_series
from longspan.operators.modality import group_available
from longspan.operators.ordered import position_within
from longspan.operators.outcomes import conversion_summary, place_of
from longspan.operators.risk_arrays import risk_rows, with_batch_risk
from longspan.operators.splits import assign_roles
from longspan.operators.survival import cumulative_risk
from longspan.session import cut_lineage
from longspan.sources import contracts

SEGMENTS = {"AUTOMOBILE": "ADNI", "BUILDING": "NACC", "FURNITURE": "AIBL", "HOUSEHOLD": "TLSA", "MACHINERY": "SANSCOG"}
STATES = {"F": "cognitively_unimpaired", "O": "mci", "P": "dementia"}
SETTINGS = {0: "rural", 1: "urban", 2: "reference"}
SPLIT_SEED = 7
REPLICATES = 12

# (line number, source column) -> (feature, factor, shift): value = source * factor + shift.
MEASURES = {
    (1, "l_quantity"): ("cognitive_score", -0.3, 30.0),
    (1, "l_discount"): ("memory_score", 40.0, -2.0),
    (1, "l_tax"): ("executive_score", 50.0, -2.0),
    (2, "l_extendedprice"): ("hippocampal_volume_mm3", 0.04, 4000.0),
    (2, "l_quantity"): ("wmh_burden_ml", 0.25, 0.0),
    (2, "l_discount"): ("entorhinal_thickness_mm", 10.0, 2.5),
    (2, "l_tax"): ("cortical_thickness_mean_mm", 8.0, 2.2),
    (3, "l_extendedprice"): ("ventricular_volume_mm3", 0.3, 20000.0),
    (3, "l_quantity"): ("hba1c_percent", 0.06, 4.5),
    (3, "l_discount"): ("hs_crp_mg_l", 60.0, 0.0),
    (4, "l_quantity"): ("total_cholesterol_mg_dl", 2.5, 150.0),
    (4, "l_discount"): ("fasting_glucose_mg_dl", 600.0, 80.0),
    (5, "l_quantity"): ("rnfl_um", 0.7, 70.0),
    (5, "l_discount"): ("vessel_density_percent", 120.0, 40.0),
    (5, "l_tax"): ("gfaz_area_mm2", 3.0, 0.2),
    (6, "l_quantity"): ("apoe_e4_count", 1.0, 0.0),
    (6, "l_tax"): ("ancestry_pc1", 30.0, -1.2),
    (7, "l_quantity"): ("total_cholesterol_mg_dl", 2.5, 150.0),
    (7, "l_discount"): ("fasting_glucose_mg_dl", 600.0, 80.0),
    (7, "l_tax"): ("ancestry_pc1", 30.0, -1.2),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def participants(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("participant_id"),
        F.col("c_custkey").alias("participant_key"),
        map_codes("c_mktsegment", SEGMENTS).alias("cohort"),
        F.when(F.col("c_nationkey") % 2 == 0, "Male").otherwise("Female").alias("sex"),
        ((F.col("c_acctbal") + 1000.0) / 11000.0 * 40.0 + 50.0).alias("age"),
        (F.col("c_nationkey") % 14 + 4).cast("double").alias("education_years"),
        map_codes(F.col("c_nationkey") % 3, SETTINGS).alias("urban_rural"),
    )


def visits(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("visit_key"),
        F.col("o_orderkey").cast("string").alias("visit_id"),
        F.col("o_custkey").cast("string").alias("participant_id"),
        F.col("o_orderdate").cast("date").alias("visit_date"),
        map_codes("o_orderstatus", STATES).alias("diagnosis"),
    )
    dated = days_since_first(o, "visit_date")
    return position_within(
        dated, ["participant_id"], "visit_date", "visit_key", "visit_index", range_key=F.year("visit_date")
    )


def first_visits(spark: SparkSession, folder: str) -> DataFrame:
    """The earliest visit of every participant, in one hash aggregate."""
    o = table(spark, folder, "orders")
    place = place_of(F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey"))
    return o.groupBy(F.col("o_custkey").cast("string").alias("participant_id")).agg(
        F.min_by("o_orderkey", place).cast("string").alias("visit_id"), F.lit(0).alias("visit_index")
    )


def outcome_visits(spark: SparkSession, folder: str) -> DataFrame:
    """Visits for outcome aggregates, with days since 1970 and the key as order within a day."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("visit_index"),
        F.col("o_orderkey").cast("string").alias("visit_id"),
        F.col("o_custkey").cast("string").alias("participant_id"),
        F.unix_date(F.col("o_orderdate").cast("date")).alias("baseline_days"),
        map_codes("o_orderstatus", STATES).alias("diagnosis"),
    )


def _cells(names: Collection[str] | None) -> dict[int, tuple[int, dict[str, str]]]:
    """Number of every measurement -> its line number and its columns as SQL; only of the features ``names`` if given."""
    out = {}
    for number, ((line, source), (feature, factor, shift)) in enumerate(MEASURES.items()):
        value = f"{source} * {factor}D + {shift}D"
        if feature == "apoe_e4_count":
            value = f"least(cast(floor({source} / 17D) as double), 2D)"
        modality, unit, _ = contracts.FEATURES[feature]
        if names is None or feature in names:
            out[number] = line, {
                "source_variable": f"'{source}'", "feature_name": f"'{feature}'", "modality": f"'{modality}'", "unit": f"'{unit}'", "value": value
            }
    return out


LINE_SOURCES = tuple(dict.fromkeys(source for _, source in MEASURES))


def features(
    spark: SparkSession, folder: str, cohorts: bool = True, at: DataFrame | None = None, names: Collection[str] | None = None
) -> DataFrame:
    """Long measurements, of the visits in ``at`` (visit_id) and of the features ``names`` if they are given.

    Lines meet their orders before they unfold into cells, so a line moves once. A line unfolds into the numbers of its
    cells and the cells' columns are worked out behind them, so columns that nobody reads do not move. Most lines
    and orders of other visits than those in ``at`` are left out where they are read, lines of other features as well.
    """
    cells = _cells(names)
    by_line: dict[int, list[int]] = {}
    for number, (line, _) in cells.items():
        by_line.setdefault(line, []).append(number)
    lines = table(spark, folder, "lineitem").where(F.col("l_linenumber").isin(*by_line))
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *LINE_SOURCES)
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("participant_id")
    )
    if at is not None:
        wanted = at.select(F.col("visit_id").cast("long").alias("l_orderkey"))
        lines = may_match(lines, "l_orderkey", wanted, "l_orderkey")
        orders = may_match(orders, "l_orderkey", wanted, "l_orderkey").join(wanted, "l_orderkey", "left_semi")
    numbers = "case l_linenumber " + " ".join(f"when {n} then array({', '.join(map(str, c))})" for n, c in by_line.items()) + " end"
    long = lines.join(orders, "l_orderkey").select("*", F.explode(F.expr(numbers)).alias("cell"))

    def of_cell(column: str) -> Column:
        return F.expr("case cell " + " ".join(f"when {n} then {c[column]}" for n, (_, c) in cells.items()) + " end").alias(column)

    rows = long.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", of_cell("source_variable")).alias("feature_row_id"),
        F.expr("l_partkey * 100000000000000000000BD + l_suppkey * 10BD + l_linenumber").alias("sequence"),
        "participant_id",
        F.col("l_orderkey").cast("string").alias("visit_id"),
        *map(of_cell, ("modality", "feature_name", "value", "unit", "source_variable")),
    )
    if not cohorts:
        return rows
    return rows.join(participants(spark, folder).select("participant_id", "cohort"), "participant_id")


def survival(spark: SparkSession, folder: str) -> DataFrame:
    """participant_id, event, event_time_days, cohort, participant_key."""
    people = participants(spark, folder).select("participant_id", "participant_key", "cohort")
    return conversion_summary(outcome_visits(spark, folder), absolute=True).join(people, "participant_id").select(
        "participant_id", "participant_key", "cohort", "event", "event_time_days"
    )


def baseline(spark: SparkSession, folder: str) -> DataFrame:
    labels = conversion_summary(outcome_visits(spark, folder), absolute=True)
    first = first_visits(spark, folder)
    cells = features(spark, folder, cohorts=False, at=first)
    return baseline_wide(participants(spark, folder), None, cells, labels, order="sequence")


def split_draw() -> Column:
    return seeded_draw(F.col("participant_id").cast("long"), SPLIT_SEED)


def roles(spark: SparkSession, folder: str) -> DataFrame:
    return assign_roles(participants(spark, folder), draw=split_draw())


def baseline_with_role(spark: SparkSession, folder: str) -> DataFrame:
    return baseline(spark, folder).join(roles(spark, folder).select("participant_id", "role"), "participant_id")


def train(spark: SparkSession, folder: str) -> DataFrame:
    return baseline_with_role(spark, folder).where(F.col("role").isin(*TRAIN_ROLES))


def validation(spark: SparkSession, folder: str) -> DataFrame:
    return baseline_with_role(spark, folder).where(F.col("role").isin(*VALIDATION_ROLES))


def group_strengths() -> dict[str, Column]:
    """A 0..1 severity per model group, NULL when the group is absent."""
    c = F.col
    return {
        "Cognition + clinical": (30.0 - c("cognitive_score")) / 30.0,
        "MRI": F.coalesce(c("wmh_burden_ml") / 12.5, (8500.0 - c("hippocampal_volume_mm3")) / 8000.0, F.lit(0.4)),
        "Blood": F.coalesce((c("hba1c_percent") - 4.5) / 3.0, c("hs_crp_mg_l") / 6.0, F.lit(0.5)),
        "OCT/OCTA": F.coalesce((105.0 - c("rnfl_um")) / 35.0, (52.0 - c("vessel_density_percent")) / 12.0, F.lit(0.45)),
        "Genomics": F.coalesce(c("apoe_e4_count") / 2.0, F.lit(0.35)),
    }


GROUP_LIST = "array<struct<modality:string,hazards:array<array<double>>>>"


def _group_hazards(names: list[str]):
    """(key, strengths by group place) -> an entry per present group with its hazards by replicate and year."""

    def run(keys: pa.Array, strengths: pa.Array) -> pa.Array:
        n = len(keys)
        cells = strengths.flatten()
        present = cells.is_valid().to_numpy(zero_copy_only=False).reshape(n, len(names))
        person, place = np.nonzero(present)
        strength = cells.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(n, len(names))[person, place]
        known = keys.is_valid().to_numpy(zero_copy_only=False)[person]
        key = keys.fill_null(0).to_numpy(zero_copy_only=False)[person]
        draw = seeded_draws(key[:, None], np.arange(REPLICATES) * 10 + place[:, None])
        hazard = (strength * 0.15 + 0.01)[:, None, None] + np.arange(1, 6) * 0.005 + draw[:, :, None] * 0.02
        values = pa.array(hazard.ravel(), mask=np.repeat(~known, REPLICATES * 5))
        by_year = pa.ListArray.from_arrays(pa.array(np.arange(0, hazard.size + 1, 5, dtype=np.int32)), values)
        by_replicate = pa.ListArray.from_arrays(pa.array(np.arange(0, len(by_year) + 1, REPLICATES, dtype=np.int32)), by_year)
        modality = pa.array(names, pa.string()).take(pa.array(place))
        groups = pa.StructArray.from_arrays([modality, by_replicate], ["modality", "hazards"])
        ends = np.concatenate([[0], np.cumsum(present.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), groups)

    return F.arrow_udf(run, GROUP_LIST)


def with_groups(frame: DataFrame) -> DataFrame:
    """``frame`` with ``groups``: modality and hazards (replicate, year) of each available group."""
    strengths = {g: F.when(group_available(g), strength).cast("double") for g, strength in group_strengths().items()}
    groups = _group_hazards(list(strengths))(F.col("participant_key").cast("long"), F.array(*strengths.values()))
    return frame.withColumn("groups", groups)


def hazards(frame: DataFrame) -> DataFrame:
    """participant_id, modality, replicate, interval_year, hazard for available groups."""
    rows = with_groups(frame).select("participant_id", F.explode("groups").alias("g"))
    rows = rows.select("participant_id", F.col("g.modality").alias("modality"), F.posexplode("g.hazards").alias("replicate", "h"))
    rows = rows.select("participant_id", "modality", "replicate", F.posexplode("h").alias("place", "hazard"))
    return rows.select(
        "participant_id", "modality", "replicate", (F.col("place") + 1).cast("double").alias("interval_year"), "hazard"
    )


def scores(frame: DataFrame) -> DataFrame:
    """participant_id, modality, replicate, horizon, risk.

    The yearly product is a projection of the person's row. Only people whose key is NULL or occurs more than once,
    whose rows share one product, take the long form with its shuffle of 300 rows a person.
    """
    needed = [c for c in frame.columns if c in ("participant_id", "participant_key", *contracts.FEATURES)]
    copies = F.count(F.lit(1)).over(Window.partitionBy("participant_id"))
    people = cut_lineage(frame.select(*needed, copies.alias("__copies")))
    single = (F.col("__copies") == 1) & F.col("participant_key").isNotNull()
    alone = risk_rows(with_groups(people.where(single)))
    shared = cumulative_risk(hazards(people.where(~single)), ("participant_id", "modality", "replicate"))
    return alone.unionByName(shared)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Validation rows with fused median risks; people without groups keep NULL."""
    return with_batch_risk(with_groups(validation(spark, folder)))


def trajectories(spark: SparkSession, folder: str, seen: DataFrame | None = None) -> DataFrame:
    """Score per visit; ``seen`` may give the rows of ``visits`` if they are written already."""
    scores = features(spark, folder, cohorts=False, names=("cognitive_score",))
    return trajectory_series(visits(spark, folder) if seen is None else seen, scores)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, y, toxic, a, b, source, lang: labels with two scores from text length."""
    n = F.col("n_chars")
    return (
        table(spark, folder, "labels")
        .join(table(spark, folder, "documents").select("doc_id", "n_chars", "source", "lang"), "doc_id")
        .select(
            "doc_id",
            F.col("quality").alias("y"),
            "toxic",
            (n / (n + 1500.0)).alias("a"),
            ((n % 97) / 97.0).alias("b"),
            "source",
            "lang",
        )
    )


def series(spark: SparkSession, folder: str) -> DataFrame:
    """participant_id, year, cognitive_score: event values of a user over days."""
    e = table(spark, folder, "events")
    origin = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    return e.select(
        F.col("user_id").cast("string").alias("participant_id"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - origin) / 86_400_000_000.0).alias("year"),
        F.col("value").alias("cognitive_score"),
    )


# --- the same views in SQL ---------------------------------------------------


def draw_sql(key: str, seed: str) -> str:
    def part(m: int) -> str:
        a = f"((({key}) % {m} * 1103515245 + ({seed}) * 12345 + 6789) % {m})"
        return f"CAST(({a} * {a} + ({key}) % {m}) % {m} AS DOUBLE) / {m}.0"

    parts = " + ".join(part(m) for m in DRAW_MODULI)
    return f"(({parts}) - floor({parts}))"


def case_sql(column: str, codes: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in codes.items())
    tail = f" ELSE {default!r}" if default is not None else ""
    return f"CASE {column} {whens}{tail} END"


def _feature_rows_sql() -> str:
    parts = []
    for (line, source), (feature, factor, shift) in MEASURES.items():
        value = (
            f"least(floor({source} / 17.0), 2.0)" if feature == "apoe_e4_count"
            else f"{source} * CAST({factor} AS DOUBLE) + CAST({shift} AS DOUBLE)"
        )
        modality, unit, _ = contracts.FEATURES[feature]
        parts.append(
            f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '{modality}' AS modality, "
            f"'{feature}' AS feature_name, CAST({value} AS DOUBLE) AS value, '{unit}' AS unit, "
            f"'{source}' AS source_variable FROM lineitem WHERE l_linenumber = {line}"
        )
    return "\nUNION ALL ".join(parts)


_pivot_sql = ",\n".join(
    f"arg_min(value, sequence) FILTER (WHERE feature_name = '{f}') AS {f}" for f in contracts.FEATURES
)
_strength_sql = {
    "Cognition + clinical": ("cognitive_score IS NOT NULL", "(30.0 - cognitive_score) / 30.0"),
    "MRI": (None, "coalesce(wmh_burden_ml / 12.5, (8500.0 - hippocampal_volume_mm3) / 8000.0, 0.4)"),
    "Blood": (None, "coalesce((hba1c_percent - 4.5) / 3.0, hs_crp_mg_l / 6.0, 0.5)"),
    "OCT/OCTA": (None, "coalesce((105.0 - rnfl_um) / 35.0, (52.0 - vessel_density_percent) / 12.0, 0.45)"),
    "Genomics": (None, "coalesce(apoe_e4_count / 2.0, 0.35)"),
}


def present_sql(group: str) -> str:
    if group == contracts.CLINICAL_GROUP:
        return "cognitive_score IS NOT NULL"
    return f"coalesce({', '.join(contracts.MODEL_GROUPS[group])}) IS NOT NULL"


def _strengths_union() -> str:
    return "\nUNION ALL ".join(
        f"SELECT participant_id, participant_key, {i} AS place, '{g}' AS modality, CAST({s} AS DOUBLE) AS strength "
        f"FROM scored_people WHERE {present_sql(g)}"
        for i, (g, (_, s)) in enumerate(_strength_sql.items())
    )


CTES = {
    "participants": f"""SELECT CAST(c_custkey AS VARCHAR) AS participant_id, c_custkey AS participant_key,
        {case_sql('c_mktsegment', SEGMENTS)} AS cohort,
        CASE WHEN c_nationkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex,
        (c_acctbal + 1000.0) / 11000.0 * 40.0 + 50.0 AS age,
        CAST(c_nationkey % 14 + 4 AS DOUBLE) AS education_years,
        {case_sql('c_nationkey % 3', SETTINGS)} AS urban_rural
        FROM customer""",
    "visits": f"""SELECT o_orderkey AS visit_key, CAST(o_orderkey AS VARCHAR) AS visit_id,
        CAST(o_custkey AS VARCHAR) AS participant_id, CAST(o_orderdate AS DATE) AS visit_date,
        {case_sql('o_orderstatus', STATES)} AS diagnosis,
        date_diff('day', min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey), CAST(o_orderdate AS DATE)) AS baseline_days,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS visit_index
        FROM orders""",
    "first_state": """SELECT participant_id, arg_min(diagnosis, visit_index) AS base, max(baseline_days) AS follow_up
        FROM visits GROUP BY participant_id""",
    "conversions": """SELECT v.participant_id, min(v.baseline_days) AS conversion_days
        FROM visits v JOIN first_state f ON v.participant_id = f.participant_id
        WHERE (base = 'cognitively_unimpaired' AND diagnosis IN ('mci', 'dementia')) OR (base = 'mci' AND diagnosis = 'dementia')
        GROUP BY v.participant_id""",
    "survival": """SELECT f.participant_id, p.participant_key, p.cohort, f.base, c.conversion_days,
        CASE WHEN c.conversion_days IS NULL THEN 0 ELSE 1 END AS event,
        coalesce(c.conversion_days, greatest(f.follow_up, 1)) AS event_time_days
        FROM first_state f JOIN participants p ON f.participant_id = p.participant_id
        LEFT JOIN conversions c ON f.participant_id = c.participant_id""",
    "line_features": _feature_rows_sql(),
    "features": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, source_variable) AS feature_row_id,
        l_partkey::HUGEINT * 100000000000000000000::HUGEINT + l_suppkey::HUGEINT * 10 + l_linenumber AS sequence,
        CAST(o_custkey AS VARCHAR) AS participant_id, CAST(l_orderkey AS VARCHAR) AS visit_id, p.cohort,
        modality, feature_name, value, unit, source_variable
        FROM line_features JOIN orders ON l_orderkey = o_orderkey
        JOIN participants p ON p.participant_key = o_custkey""",
    "wide": f"""SELECT f.participant_id, {_pivot_sql}
        FROM features f JOIN visits v ON f.visit_id = v.visit_id WHERE v.visit_index = 0 GROUP BY f.participant_id""",
    "baseline": """SELECT p.*, CASE WHEN sex = 'Male' THEN 1 ELSE 0 END AS sex_binary,
        CASE WHEN urban_rural = 'rural' THEN 1 ELSE 0 END AS rural_indicator,
        s.event, s.event_time_days,
        CASE WHEN s.event = 1 AND s.event_time_days / 365.25 <= 1 THEN 1 ELSE 0 END AS event_by_1y,
        CASE WHEN s.event = 1 AND s.event_time_days / 365.25 <= 3 THEN 1 ELSE 0 END AS event_by_3y,
        CASE WHEN s.event = 1 AND s.event_time_days / 365.25 <= 5 THEN 1 ELSE 0 END AS event_by_5y,
        w.* EXCLUDE (participant_id)
        FROM participants p JOIN survival s ON p.participant_id = s.participant_id
        LEFT JOIN wide w ON p.participant_id = w.participant_id""",
    "ranked": f"""SELECT participant_id, cohort,
        row_number() OVER (PARTITION BY cohort ORDER BY {draw_sql('participant_key', str(SPLIT_SEED))}, participant_id) AS place,
        count(*) OVER (PARTITION BY cohort) AS n FROM participants""",
    "roles": """SELECT participant_id, cohort, CASE
        WHEN cohort IN ('ADNI', 'NACC', 'AIBL') AND place <= greatest(1, round_even(n * 0.2, 0)) THEN 'public_validation'
        WHEN cohort IN ('ADNI', 'NACC', 'AIBL') THEN 'global_train'
        WHEN cohort = 'TLSA' AND place <= greatest(1, round_even(n * 0.3, 0)) THEN 'india_validation'
        WHEN cohort = 'TLSA' THEN 'tlsa_adaptation' ELSE 'external_validation' END AS role FROM ranked""",
    "staffed": "SELECT b.*, r.role FROM baseline b JOIN roles r ON b.participant_id = r.participant_id",
    "train": "SELECT * FROM staffed WHERE role IN ('global_train', 'tlsa_adaptation')",
    "validation": "SELECT * FROM staffed WHERE role IN ('public_validation', 'india_validation', 'external_validation')",
    "strengths": _strengths_union(),
    "hazards": f"""SELECT participant_id, modality, replicate, CAST(year AS DOUBLE) AS interval_year,
        strength * 0.15 + 0.01 + year * 0.005 + {draw_sql('participant_key', 'replicate * 10 + place')} * 0.02 AS hazard
        FROM strengths, (SELECT unnest(range({REPLICATES})) AS replicate), (SELECT unnest(range(1, 6)) AS year)""",
    "scores": """SELECT participant_id, modality, replicate, h AS horizon,
        least(greatest(1 - product(1 - least(greatest(hazard, 0.001), 0.95)) FILTER (WHERE interval_year <= h), 0), 1) AS risk
        FROM hazards, (SELECT unnest([1, 3, 5]) AS h) GROUP BY participant_id, modality, replicate, h""",
    "weights": "SELECT * FROM (VALUES ('Cognition + clinical', 0.40), ('MRI', 0.23), ('Blood', 0.14), ('OCT/OCTA', 0.11), ('Genomics', 0.12)) AS w(modality, weight)",
    "fused": """SELECT participant_id, replicate, horizon, sum(risk * CAST(weight AS DOUBLE)) / sum(CAST(weight AS DOUBLE)) AS risk
        FROM scores JOIN weights USING (modality) GROUP BY participant_id, replicate, horizon""",
    "batch": """SELECT participant_id, median(risk) FILTER (WHERE horizon = 1) AS risk_1y,
        median(risk) FILTER (WHERE horizon = 3) AS risk_3y, median(risk) FILTER (WHERE horizon = 5) AS risk_5y
        FROM fused GROUP BY participant_id""",
    "predictions": "SELECT v.*, b.risk_1y, b.risk_3y, b.risk_5y FROM validation v LEFT JOIN batch b ON v.participant_id = b.participant_id",
    "trajectories": """SELECT v.participant_id, v.visit_id, v.visit_index, greatest(v.baseline_days / 365.25, 0.0) AS year,
        f.value AS cognitive_score, v.diagnosis
        FROM visits v JOIN features f ON v.visit_id = f.visit_id WHERE f.feature_name = 'cognitive_score'""",
    "scored": """SELECT l.doc_id, l.quality AS y, l.toxic, d.n_chars / (d.n_chars + 1500.0) AS a, (d.n_chars % 97) / 97.0 AS b, d.source, d.lang
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "series": """SELECT CAST(user_id AS VARCHAR) AS participant_id,
        (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 AS year, value AS cognitive_score FROM events""",
}
NEEDS = {
    "participants": (), "visits": (), "first_state": ("visits",), "conversions": ("visits", "first_state"),
    "survival": ("participants", "first_state", "conversions"), "line_features": (),
    "features": ("participants", "line_features"), "wide": ("features", "visits"),
    "baseline": ("participants", "survival", "wide"), "ranked": ("participants",), "roles": ("ranked",),
    "staffed": ("baseline", "roles"), "train": ("staffed",), "validation": ("staffed",),
    "strengths": ("scored_people",), "hazards": ("strengths",), "scores": ("hazards",), "weights": (),
    "fused": ("scores", "weights"), "batch": ("fused",), "predictions": ("validation", "batch"),
    "trajectories": ("visits", "features"), "scored": (), "series": (), "scored_people": ("validation",),
}


#: Views that DuckDB must not merge into what reads them: together they are too large to plan well.
MATERIALIZED = {"trajectories", "staffed"}
#: The same for chains of local views, one per step of a fit.
LONG_CHAIN = ("nt_", "hz_", "cx_")


def with_ctes(body: str, *names: str, people: str = "validation", extra: dict[str, str] | None = None) -> str:
    """``body`` behind the named views and everything they need, in order.

    ``people`` is the view whose rows get scores; ``extra`` adds local views
    after the shared ones.
    """
    ordered: list[str] = []
    texts = {**CTES, "scored_people": f"SELECT * FROM {people}"}

    def visit(name: str) -> None:
        for need in ((people,) if name == "scored_people" else NEEDS[name]):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS {'MATERIALIZED ' * (n in MATERIALIZED)}({texts[n]})" for n in ordered] + [f"{n} AS {'MATERIALIZED ' * n.startswith(LONG_CHAIN)}({t})" for n, t in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def metrics_sql(source: str, y: str, score: str, by: str = "", weight: str = "1.0", min_n: int = 4) -> dict[str, str]:
    """Local views ``ms_*`` ending in ``ms`` (by..., n, event_rate, auroc, auprc, brier) by plain window SQL."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return {
        "ms_points": f"""SELECT {keys}CAST({score} AS DOUBLE) AS s, sum(CASE WHEN {y} = 1 THEN {weight} ELSE 0.0 END) AS pos,
            sum(CASE WHEN {y} = 1 THEN 0.0 ELSE {weight} END) AS neg FROM {source}
            WHERE {y} IS NOT NULL AND {score} IS NOT NULL GROUP BY {keys}CAST({score} AS DOUBLE)""",
        "ms_run": f"""SELECT *, sum(neg) OVER ({part} ORDER BY s) AS neg_upto,
            sum(pos) OVER ({part} ORDER BY s DESC) AS tp, sum(neg) OVER ({part} ORDER BY s DESC) AS fp FROM ms_points""",
        "ms_sums": f"""SELECT {keys}sum(pos) AS p, sum(neg) AS q, sum(pos * (neg_upto - neg / 2.0)) AS wins,
            sum(CASE WHEN tp + fp > 0 THEN pos * tp / (tp + fp) ELSE 0.0 END) AS ap, sum(pos * (1 - s) * (1 - s) + neg * s * s) AS se
            FROM ms_run {group}""",
        "ms": f"""SELECT {keys}p + q AS n, p / nullif(p + q, 0) AS event_rate,
            CASE WHEN p + q >= {min_n} AND p > 0 AND q > 0 THEN wins / (p * q) END AS auroc,
            CASE WHEN p + q >= {min_n} AND p > 0 AND q > 0 THEN ap / p END AS auprc,
            CASE WHEN p + q >= {min_n} AND p > 0 AND q > 0 THEN se / (p + q) END AS brier FROM ms_sums""",
    }
