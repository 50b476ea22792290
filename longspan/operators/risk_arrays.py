"""Replicate risks as nested arrays: one row per person, no window, no grouping, no shuffle.

A person's column ``groups`` is array<struct<modality string, hazards array<array<double>>>>, hazards by replicate
and year, with an entry for each group the person has. All steps are projections, so a person's
groups x replicates x years values stay in one row where the long form moves them three times. The arithmetic
runs in Arrow batches over the flat values; nested lambdas would be interpreted value by value.

Defined results: hazards are clamped as in ``cumulative_risk``, and a NULL hazard counts as none that year. A
replicate with fewer years than a horizon has no (NULL) risk there. Groups without weight, and disabled
ones, do not count; if no group is left the fused risk is NULL. Quantiles leave NULL replicates out. All
groups of a person have the replicates of the first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.operators.discrimination import ABLATION_SCENARIOS, binary_metrics, with_delta_to_full
from longspan.operators.survival import HAZARD_CEILING, HAZARD_FLOOR
from longspan.session import cut_lineage
from longspan.sources import contracts


RISK_GROUPS = "array<struct<modality:string,risks:array<array<double>>>>"


def _lists(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _spans(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(start, length, values) of a list array; a NULL list is empty."""
    offsets = lists.offsets.to_numpy()
    known = lists.is_valid().to_numpy(zero_copy_only=False)
    return offsets[:-1].astype(np.int64), np.where(known, np.diff(offsets), 0).astype(np.int64), lists.values


def _members(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all values of the spans, in order."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def _doubles(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, known); NULL and NaN stay apart."""
    return values.fill_null(0.0).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False)


def with_risks(frame: DataFrame, groups: str = "groups", horizons: Sequence[int] = contracts.HORIZON_YEARS) -> DataFrame:
    """``groups`` with risks (replicate, horizon) in the place of its hazards."""
    years = list(horizons)

    def run(people: pa.Array) -> pa.Array:
        start, count, cells = _spans(people)
        cells = cells.take(pa.array(_members(start, count)))
        first, replicates, lists = _spans(cells.field("hazards"))
        lists = lists.take(pa.array(_members(first, replicates)))
        at, length, values = _spans(lists)
        hazard, known = _doubles(values)
        clamped = np.where(np.isnan(hazard), HAZARD_CEILING, np.clip(hazard, HAZARD_FLOOR, HAZARD_CEILING))
        # One more place, so that a short or empty replicate has somewhere to point.
        left = np.append(np.where(known, 1.0 - clamped, 1.0), 1.0)
        survival, out, reached = np.ones(len(at)), np.empty((len(at), len(years))), np.empty((len(at), len(years)), bool)
        done = 0
        for place, horizon in sorted(enumerate(years), key=lambda item: item[1]):
            for year in range(done, horizon):
                survival = survival * left[np.where(year < length, at + year, -1)]
            done = horizon
            out[:, place], reached[:, place] = np.clip(1.0 - survival, 0.0, 1.0), length >= horizon
        risks = _lists(pa.array(out.ravel(), mask=~reached.ravel()), np.full(len(at), len(years)))
        named = pa.StructArray.from_arrays([cells.field("modality"), _lists(risks, replicates)], ["modality", "risks"])
        return _lists(named, count)

    risks = F.arrow_udf(run, RISK_GROUPS)
    return frame.withColumn(groups, risks(groups))


def enabled(groups: Column, disabled: Sequence[str]) -> Column:
    return F.filter(groups, lambda g: ~g["modality"].isin(*disabled)) if disabled else groups


def fused_risks(
    groups: Column, horizons: Sequence[int] = contracts.HORIZON_YEARS, weights: Mapping[str, float] = contracts.GROUP_WEIGHTS
) -> Column:
    """array<array<double>>: weighted mean over the known risks, by horizon and replicate."""
    if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("Fusion weights must be non-negative and sum to a positive value")
    names, shares, places = list(weights), np.array([*weights.values(), 0.0], float), len(horizons)

    def run(people: pa.Array) -> pa.Array:
        start, count, cells = _spans(people)
        kind = pc.index_in(cells.field("modality"), value_set=pa.array(names, pa.string())).fill_null(len(names))
        weight = np.append(shares[kind.to_numpy(zero_copy_only=False)], 0.0)
        first, replicates, lists = _spans(cells.field("risks"))
        first, replicates = np.append(first, 0), np.append(replicates, 0)
        at, length, values = _spans(lists)
        at, length = np.append(at, 0), np.append(length, 0)
        risk, known = _doubles(values)
        risk, known = np.append(risk, 0.0), np.append(known, False)
        each = np.where(count > 0, replicates[np.where(count > 0, start, -1)], 0)
        person = np.repeat(np.arange(len(people)), each)
        replicate = _members(np.zeros(len(people), np.int64), each)
        total, mass = np.zeros((places, len(person))), np.zeros((places, len(person)))
        for j in range(int(count.max(initial=0))):
            group = np.where(j < count[person], start[person] + j, -1)
            one = np.where(replicate < replicates[group], first[group] + replicate, -1)
            for place in range(places):
                cell = np.where(place < length[one], at[one] + place, -1)
                w = np.where(known[cell], weight[group], 0.0)
                total[place] += w * risk[cell]
                mass[place] += w
        fused = np.divide(total, mass, out=np.zeros_like(total), where=mass > 0)
        # By person, then horizon, then replicate.
        order = np.lexsort((np.tile(replicate, places), np.repeat(np.arange(places), len(person)), np.tile(person, places)))
        inner = _lists(pa.array(fused.ravel()[order], mask=~(mass > 0).ravel()[order]), np.repeat(each, places))
        return _lists(inner, np.full(len(people), places))

    return F.arrow_udf(run, "array<array<double>>")(groups)


def quantile_of(ordered: Column, q: float) -> Column:
    """Linear quantile of a sorted array without NULLs; NULL if it is empty."""
    at = F.lit(float(q)) * (F.size(ordered) - 1)
    below, above = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return below + (above - below) * (at - F.floor(at))


def _distribution(frame: DataFrame, disabled: Sequence[str]) -> DataFrame:
    """``frame`` with ``__fused``, sorted replicate risks by horizon, where a group is left."""
    kept = with_risks(frame.withColumn("groups", enabled(F.col("groups"), disabled)))
    fused = kept.withColumn("__fused", fused_risks(F.col("groups")))
    ordered = [F.sort_array(F.array_compact(F.col("__fused")[i])) for i in range(len(contracts.HORIZON_YEARS))]
    return fused.withColumn("__fused", F.array(*ordered))


def with_batch_risk(frame: DataFrame, disabled: Sequence[str] = (), horizons: Sequence[int] = contracts.HORIZON_YEARS) -> DataFrame:
    """All rows with the median over replicates as ``risk_<h>y``; NULL for people without groups."""
    out = _distribution(frame, disabled)
    medians = [quantile_of(F.col("__fused")[i], 0.5).alias(f"risk_{h}y") for i, h in enumerate(horizons)]
    return out.select(*[F.col(f"`{c}`") for c in frame.columns if c != "groups"], *medians)


def distribution_rows(frame: DataFrame, disabled: Sequence[str] = (), horizons: Sequence[int] = contracts.HORIZON_YEARS) -> DataFrame:
    """participant_id, replicate, horizon, risk: the long form, unfolded at the end."""
    kept = with_risks(frame.withColumn("groups", enabled(F.col("groups"), disabled)))
    rows = kept.select("participant_id", F.posexplode(fused_risks(F.col("groups"))).alias("place", "risks"))
    horizon = F.array(*[F.lit(h) for h in horizons])[F.col("place")]
    return rows.select("participant_id", horizon.alias("horizon"), F.posexplode("risks").alias("replicate", "risk"))


def risk_rows(frame: DataFrame, horizons: Sequence[int] = contracts.HORIZON_YEARS) -> DataFrame:
    """participant_id, modality, replicate, horizon, risk: each group's own risks in long form."""
    rows = with_risks(frame.select("participant_id", "groups"), horizons=horizons)
    rows = rows.select("participant_id", F.explode("groups").alias("g"))
    rows = rows.select("participant_id", "g.modality", F.posexplode("g.risks").alias("replicate", "risks"))
    cells = F.arrays_zip(F.array(*[F.lit(h) for h in horizons]).alias("horizon"), F.col("risks").alias("risk"))
    return rows.select("participant_id", "modality", "replicate", F.inline(cells).alias("horizon", "risk"))


def interval_rows(frame: DataFrame, low: float = 0.1, high: float = 0.9, horizons: Sequence[int] = contracts.HORIZON_YEARS) -> DataFrame:
    """participant_id, horizon, median risk, and replicate quantiles kept around it."""
    people = _distribution(frame, ()).where(F.size("groups") > 0)
    rows = people.select("participant_id", F.posexplode("__fused").alias("place", "ordered"))
    q = [quantile_of(F.col("ordered"), p) for p in (low, 0.5, high)]
    return rows.select(
        "participant_id",
        F.array(*[F.lit(h) for h in horizons])[F.col("place")].alias("horizon"),
        q[1].alias("risk"), F.least(q[0], q[1]).alias("lower"), F.greatest(q[2], q[1]).alias("upper"),
    )


def ablation(frame: DataFrame, y: str = "event_by_3y", scenarios: Mapping[str, Sequence[str]] = ABLATION_SCENARIOS) -> DataFrame:
    """Metrics per scenario of disabled groups and the AUPRC difference to the full model.

    The scenarios of a person unfold in the row; a person left without groups has none there.
    """
    cases = F.array(
        *[
            F.struct(F.lit(s).alias("scenario"), enabled(F.col("groups"), disabled).alias("groups"))
            for s, disabled in scenarios.items()
        ]
    )
    rows = frame.select("participant_id", y, F.explode(cases).alias("case"))
    rows = rows.select("participant_id", y, "case.*").where(F.size("groups") > 0)
    # The metrics read the risks several times.
    risks = cut_lineage(with_batch_risk(rows))
    return with_delta_to_full(binary_metrics(risks, y, "risk_3y", ["scenario"]))
