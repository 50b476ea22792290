"""How far the sources of each language differ in vocabulary: exact distances and telling terms.

Terms are counted per (lang, source) inside each task, so that a hot source or word sends one row
per task. A term stays when enough documents of its language hold it. Every group then gives
each kept term an integer share p, smoothed, and z is its share of a term it does not hold.

The distance of two groups is a row of a sparse product, taken the way Gustavson does: the kept
terms of a language are dealt into buckets, and each bucket holds a term-major index of (peer, p).
A group walks its own terms through that index and scatters into one dense accumulator with a
cell per peer, so no pair of postings becomes a row; tasks emit accumulators, which Spark adds up.
Only terms that both groups hold are met that way, so the walk adds
|p-q| - |p-z'| - |z-q| + |z-z'|, and the zero baselines are put right by sums that need no meeting:
the terms of either group against the other's z (sorted shares and prefix sums), and |z-z'| for
the kept terms that neither holds. Sources are cut into chunks, so an accumulator table has at
most CHUNK x CHUNK cells and a posting list at most 2 x CHUNK entries in one task.

Partial sums stay below 2^53 (the shares of a group add up to less than 10^9 + V), so the float64
scatter is exact. Shares themselves are decimal divisions.

Defined results: NULL text, lang and source are ''. Repeated rows are documents of their own. A
group without kept terms has shares too; with no kept term at all its distances are 0. Ties go by
the item in UTF-8 order. Texts are counted whole, long ones in slices (the set of one document's
distinct terms is held). Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.session import cut_lineage

MIN_DOCS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
CHUNK = 1024
BUCKET_ROWS = 50_000
HELD_TERMS = 200_000
SLICE = 1 << 20

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def slices(text: bytes, table: bytes):  # type: ignore[no-untyped-def]
    """The translated text in parts of bounded length, cut at separators."""
    if len(text) <= SLICE:
        yield text.translate(table)
        return
    text, start = text.translate(table), 0
    while start < len(text):
        end = text.find(b" ", start + SLICE)
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end


def _tally(batches):  # type: ignore[no-untyped-def]
    """(lang, source, term, n, docs) of this task; held counts are sent whenever they reach a bound."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def send():  # type: ignore[no-untyped-def]
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.binary()), pa.array([source] * len(part), pa.binary()), pa.array(part, pa.binary()),
                        pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for part in slices(text.as_py(), _LETTERS):
                terms = part.split()
                n.update(terms)
                own.update(terms)
            docs.update(own)
            size += len(n) - before
            if size > HELD_TERMS:
                yield from send()
                held, size = {}, 0
    yield from send()


def _share(count: str, total: str, terms: str, prior: int, scale: int) -> Column:
    """1 + floor(scale * (count + prior) / (total + prior * terms)) without 64-bit overflow; 0 when there are no terms."""
    top = f"CAST({scale} AS DECIMAL(10,0)) * CAST({count} + {prior} AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({top}) div CAST({total} + {prior} * {terms} AS DECIMAL(20,0)) ELSE 0L END")


def _sorted_gap(p: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Sum of |p - z| over all p, for each z."""
    p = np.sort(p)
    prefix = np.concatenate(([0], np.cumsum(p)))
    k = np.searchsorted(p, z)
    return prefix[-1] - 2 * prefix[k] + (2 * k - len(p)) * z


def accumulate(rows, cols, zi: np.ndarray, zj: np.ndarray) -> np.ndarray:  # type: ignore[no-untyped-def]
    """Distances of each row group to each peer over the terms of this bucket, less |z - z'| for every further kept term.

    ``rows`` and ``cols`` are (group, term code, p) of the two chunks; ``zi`` and ``zj`` their shares of absent terms.
    """
    out = np.zeros((len(zi), len(zj)), np.int64)
    base = np.abs(zi[:, None] - zj[None, :])
    peer, code, share = cols
    order = np.argsort(code, kind="stable")
    index_peer, index_p = peer[order], share[order]
    starts = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=max(rows[1].max(initial=-1), code.max(initial=-1)) + 1))))
    for group, terms, p in _by_group(rows):
        first, count = starts[terms], starts[terms + 1] - starts[terms]
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        met, q, own = index_peer[at], index_p[at], np.repeat(p, count)
        gain = np.abs(own - q) - np.abs(own - zj[met]) - np.abs(zi[group] - q) + base[group][met]
        row = np.bincount(met, weights=gain, minlength=len(zj))
        out[group] += np.rint(row).astype(np.int64) + _sorted_gap(p, zj) - len(p) * base[group]
    for group, _, p in _by_group(cols):
        out[:, group] += _sorted_gap(p, zi) - len(p) * base[:, group]
    return out


def _by_group(side):  # type: ignore[no-untyped-def]
    order = np.argsort(side[0], kind="stable")
    group, code, p = (x[order] for x in side)
    cuts = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(group)], strict=True):
        if hi > lo:
            yield group[lo], code[lo:hi], p[lo:hi]


def _distances(chunk: int):  # type: ignore[no-untyped-def]
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, ci, cj, bucket = (k.as_py() for k in key)
        absent = pc.is_null(table["term"]).to_numpy()
        idx, p = table["idx"].to_numpy(), table["p"].to_numpy()
        at_i, at_j = idx // chunk == ci, idx // chunk == cj

        def zero_shares(here: np.ndarray, number: int) -> np.ndarray:
            z = np.zeros(np.count_nonzero(here & absent), np.int64)
            z[idx[here & absent] - number * chunk] = p[here & absent]
            return z

        zi, zj = zero_shares(at_i, ci), zero_shares(at_j, cj)
        codes = table["term"].combine_chunks().dictionary_encode().indices.fill_null(0).to_numpy()

        def side(here: np.ndarray, number: int) -> tuple[np.ndarray, ...]:
            here = here & ~absent
            return idx[here] - number * chunk, codes[here], p[here]

        out = accumulate(side(at_i, ci), side(at_j, cj), zi, zj)
        if bucket == 0:  # once for each pair: every kept term as if neither held it
            out += table["v"][0].as_py() * np.abs(zi[:, None] - zj[None, :])
        faces = [(out, ci, cj)] if ci == cj else [(out, ci, cj), (out.T, cj, ci)]
        found = [(number * chunk + g, other, row) for face, number, other in faces for g, row in enumerate(face)]
        return pa.table(
            {
                "lang": pa.array([lang] * len(found), pa.string()),
                "idx": pa.array([g for g, _, _ in found], pa.int32()),
                "chunk": pa.array([c for _, c, _ in found], pa.int32()),
                "sums": pa.array([row for _, _, row in found], pa.list_(pa.int64())),
            }
        )

    return run


def source_divergence(
    docs: DataFrame, min_docs: int = MIN_DOCS, prior: int = PRIOR, scale: int = SCALE, top_terms: int = TOP_TERMS,
    chunk: int = CHUNK, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` for every other source, part ``term`` for telling terms."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    source = docs.select(*own, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    named = source.select(F.col("lang").cast("binary").alias("lang"), F.col("source").cast("binary").alias("source"), "text")
    tallies = named.mapInArrow(_tally, "lang binary, source binary, term binary, n long, docs long")
    counts = tallies.groupBy(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")]).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    # A (lang, term) window holds one row per source.
    of_term = Window.partitionBy("lang", "term")
    kept = cut_lineage(
        counts.select(
            "lang", "source", "term", "n", F.sum("n").over(of_term).alias("total"), F.sum("docs").over(of_term).alias("docs"),
            (F.row_number().over(of_term.orderBy("source")) == 1).cast("long").alias("head"),
        ).where(F.col("docs") >= min_docs).drop("docs")
    )
    langs = kept.groupBy("lang").agg(F.sum("head").alias("v"), F.sum("n").alias("lang_n"), F.ceil(F.count("*") / bucket_rows).cast("int").alias("buckets"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = source.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, ["lang"], "left")
    groups = groups.na.fill(0, ["group_n", "v", "lang_n"]).na.fill(1, ["buckets"])
    of_lang = Window.partitionBy("lang")
    groups = cut_lineage(
        groups.select(
            "*", (F.row_number().over(of_lang.orderBy("source")) - 1).alias("idx"),
            (F.ceil(F.count("*").over(of_lang) / chunk) - 1).cast("int").alias("last_chunk"), _share("0", "group_n", "v", prior, scale).alias("z"),
        )
    )
    entries = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "idx", "term", "v", "buckets", "last_chunk",
        _share("n", "group_n", "v", prior, scale).alias("p"), _share("total", "lang_n", "v", prior, scale).alias("q"),
    )

    telling = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    # Cells (ci, cj) with ci <= cj; a row goes to each cell that has its chunk.
    cell = F.explode(F.sequence(F.lit(0), F.col("last_chunk"))).alias("other")
    mine = F.expr(f"CAST(idx DIV {chunk} AS INT)")
    ends = [F.least(mine, F.col("other")).alias("ci"), F.greatest(mine, F.col("other")).alias("cj")]
    bucket = F.expr("CAST(pmod(xxhash64(term), buckets) AS INT)").alias("bucket")
    held = entries.select("*", cell).select("lang", *ends, bucket, "idx", "term", "p", "v")
    zeros = groups.select("*", cell).select(
        "lang", *ends, F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "idx", F.lit(None).cast("string").alias("term"), F.col("z").alias("p"), "v"
    )
    parts = held.unionByName(zeros).groupBy("lang", "ci", "cj", "bucket").applyInArrow(_distances(chunk), "lang string, idx int, chunk int, sums array<bigint>")
    sums = (
        parts.select("lang", "idx", "chunk", F.posexplode("sums").alias("place", "value"))
        .groupBy("lang", "idx", (F.col("chunk") * chunk + F.col("place")).alias("peer"))
        .agg(F.sum("value").alias("value"))
        .where("idx <> peer")
    )
    names = groups.select("lang", "idx", "source")
    peers = groups.select("lang", F.col("idx").alias("peer"), F.col("source").alias("item"))
    pairs = sums.join(names, ["lang", "idx"]).join(peers, ["lang", "peer"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)
