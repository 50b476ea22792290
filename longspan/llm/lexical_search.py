"""Ranked lexical search of an item set over all documents by dense blocked matrix products.

One pass over the texts keeps, per document, its length and its counts of the items' terms, in a
written table. The other passes read that table. A task gathers tiles of DOC_TILE documents; for
each tile of items it takes the tile's compact vocabulary (the terms of those items alone), fills a
dense documents x terms tile with integer impacts and multiplies it with the dense terms x items
tile of weights, in float64. An impact is below IMPACT_BOUND, and a vocabulary tile ends before
the sum of weight x IMPACT_BOUND of any item reaches 2^53, so all partial sums are exact
integers; tiles add up in 64-bit integers. Each task keeps k rows per item by (score, id): a
document that equals the k-th score still enters by its smaller id.

Items come in blocks of at most BLOCK_BYTES of text on average, chosen by a hash of the item, so
what the driver holds and broadcasts (terms and sparse weights of one block) has a bound; more items
mean more blocks over the same written table's source. Documents are never paired with each other.

Defined results: a NULL text has no term, and an item without terms, or whose terms no document
holds, has no row. Items that share an item_id are ranked each on their own; rows that share a
doc_id are documents of their own; a NULL doc_id comes after all others among equal scores. Other
columns are ignored; an empty table on either side gives an empty result. Texts are read whole, long
ones in slices.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longspan.llm.common import MAX_ID, doc_text
from longspan.llm.source_divergence import slices
from longspan.session import cut_lineage

TOP_K = 10
DOC_TILE = 512
ITEM_TILE = 64
VOCABULARY_TILE = 2048
BLOCK_BYTES = 16 << 20
EXACT = 1 << 53
SCALE = 1_000_000_000
IMPACT_BOUND = SCALE // 1000

_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    counts: Counter = Counter()
    for part in slices(text, _TERMS):
        counts.update(part.split())
    return counts


def _postings(vocabulary):  # type: ignore[no-untyped-def]
    """doc_id, n (all terms), columns and counts of the vocabulary's terms."""

    def run(batches):  # type: ignore[no-untyped-def]
        column = vocabulary.value.get
        for batch in batches:
            lengths, columns, counts = [], [], []
            for text in batch["text"]:
                n, found = 0, []
                for part in slices(text.as_py() or b"", _TERMS):
                    terms = part.split()
                    n += len(terms)
                    hits = np.fromiter((c for c in map(column, terms) if c is not None), np.int32)
                    found.append(np.unique(hits, return_counts=True))
                own, place = np.unique(np.concatenate([c for c, _ in found] or [np.empty(0, np.int32)]), return_inverse=True)
                total = np.bincount(place, np.concatenate([t for _, t in found] or [np.empty(0)]), len(own)).astype("<i8")
                lengths.append(n)
                columns.append(own.astype("<i4").tobytes())
                counts.append(total.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(lengths, pa.int64()), pa.array(columns, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "n", "columns", "counts"],
            )

    return run


def _holders(size: int):  # type: ignore[no-untyped-def]
    """Documents of this task that hold each term."""

    def run(batches):  # type: ignore[no-untyped-def]
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(np.frombuffer(b"".join(batch["columns"].to_pylist()), "<i4"), minlength=size)
        column = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(column.astype(np.int32)), pa.array(held[column])], ["column", "df"])

    return run


def vocabulary_tiles(items: list[dict[int, int]], weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(columns, columns x items weights): tiles of one item tile's own vocabulary whose sums stay below 2^53.

    A term that an item repeats too often for one tile enters several tiles with a part of its repeats.
    """
    entries = []
    for place, counts in enumerate(items):
        for column, count in counts.items():
            most = (EXACT - 1) // IMPACT_BOUND // max(1, int(weight[column]))
            while count > 0:
                entries.append((column, place, min(count, most)))
                count -= most
    taken: set[int] = set()
    sums = [0] * len(items)
    tile: list[tuple[int, int, int]] = []

    def dense() -> tuple[np.ndarray, np.ndarray]:
        columns = np.array(sorted(taken), np.int64)
        out = np.zeros((len(columns), len(items)))
        for c, place, value in tile:
            out[np.searchsorted(columns, c), place] = value
        return columns, out

    seen: set[tuple[int, int]] = set()
    for column, place, count in sorted(entries):
        value = count * int(weight[column])
        if (len(taken) >= VOCABULARY_TILE and column not in taken) or sums[place] + value * IMPACT_BOUND >= EXACT or (column, place) in seen:
            yield dense()
            taken, sums, tile, seen = set(), [0] * len(items), [], set()
        taken.add(column)
        seen.add((column, place))
        sums[place] += value * IMPACT_BOUND
        tile.append((column, place, value))
    if tile:
        yield dense()


class Best:
    """The k best (score, id) of each item of a tile."""

    def __init__(self, k: int, items: int):
        self.k = k
        self.least = np.ones(items, np.int64)
        self.item = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.id = np.empty(0, np.int64)
        self.unknown = np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        """Scores are documents x items; equal scores enter, as a smaller id may win."""
        doc, item = np.nonzero(scores >= self.least)
        if not len(doc):
            return
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[doc, item[len(self.item) :]]])
        id_, unknown = np.concatenate([self.id, ids[doc]]), np.concatenate([self.unknown, unknown[doc]])
        order = np.lexsort((id_, unknown, -score, item))
        item, score, id_, unknown = item[order], score[order], id_[order], unknown[order]
        starts = np.flatnonzero(np.concatenate(([True], np.diff(item) > 0)))
        rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(item)]))))
        last, stay = rank == self.k - 1, rank < self.k
        self.least[item[last]] = score[last]
        self.item, self.score, self.id, self.unknown = item[stay], score[stay], id_[stay], unknown[stay]


def _doc_tiles(batches):  # type: ignore[no-untyped-def]
    for batch in batches:
        for start in range(0, batch.num_rows, DOC_TILE):
            yield batch.slice(start, DOC_TILE)


def _search(shared, k: int):  # type: ignore[no-untyped-def]
    """(item, score, doc_id): the best k of this task for each item of the block."""

    def run(batches):  # type: ignore[no-untyped-def]
        items, weight = shared.value
        item_tiles = [(lo, items[lo : lo + ITEM_TILE]) for lo in range(0, len(items), ITEM_TILE)]
        tiles = [list(vocabulary_tiles(part, weight)) for _, part in item_tiles]
        best = [Best(k, len(part)) for _, part in item_tiles]
        for batch in _doc_tiles(batches):
            columns = [np.frombuffer(x, "<i4") for x in batch["columns"].to_pylist()]
            doc = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
            column = np.concatenate(columns)
            tf = np.frombuffer(b"".join(batch["counts"].to_pylist()), "<i8")
            impact = SCALE * tf // (1000 * tf + 8 * batch["m"].to_numpy()[doc])
            unknown = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            ids = batch["doc_id"].fill_null(MAX_ID).to_numpy()
            local = np.full(len(weight), -1, np.int64)
            for (_, part), vocabulary, top in zip(item_tiles, tiles, best, strict=True):
                scores = np.zeros((len(columns), len(part)), np.int64)
                for wanted, weights in vocabulary:
                    local[wanted] = np.arange(len(wanted))
                    at = local[column]
                    held = at >= 0
                    local[wanted] = -1
                    if held.any():
                        dense = np.zeros((len(columns), len(wanted)))
                        dense[doc[held], at[held]] = impact[held]
                        scores += (dense @ weights).astype(np.int64)
                top.add(scores, ids, unknown)
        for (lo, _), top in zip(item_tiles, best, strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(top.item + lo, pa.int64()), pa.array(top.score), pa.array(top.id, mask=top.unknown)], ["item", "score", "doc_id"]
            )

    return run


def _block(items: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """All documents for the items of one block, whose number of terms is bounded."""
    spark = docs.sparkSession
    rows = items.collect()
    counts = [term_counts(bytes(r.text)) for r in rows]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(chain.from_iterable(counts)))}
    table = cut_lineage(docs.mapInArrow(_postings(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, columns binary, counts binary"))
    size = table.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    held = table.select("columns").mapInArrow(_holders(len(vocabulary)), "column int, df long").groupBy("column").agg(F.sum("df").alias("df"))
    for row in held.collect():  # one row per term of the block
        df[row.column] = row.df
    weight = np.array([math.floor(1000 * math.log((2 * size.docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    # A term that no document holds gives no score.
    sparse = [{vocabulary[t]: c for t, c in own.items() if df[vocabulary[t]]} for own in counts]
    scaled = F.expr(f"25 + (CAST(75 * n AS DECIMAL(20,0)) * CAST({size.docs} AS DECIMAL(18,0))) div CAST({max(1, size.terms)} AS DECIMAL(20,0))")
    found = table.where(F.octet_length("columns") > 0).select("doc_id", "columns", "counts", scaled.alias("m"))
    parts = found.mapInArrow(_search(spark.sparkContext.broadcast((sparse, weight)), k), "item long, score long, doc_id long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], items.select(F.lit(0).cast("long").alias("item"), "item_id").schema)
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def lexical_search(items: DataFrame, docs: DataFrame, k: int = TOP_K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    wanted = items.select("item_id", text)
    source = doc_text(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    blocks = max(1, math.ceil(wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b / block_bytes))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for b in range(blocks):
        found = _block(wanted.where(number == b), source, k)
        out = found if out is None else out.unionByName(found)
    return out
