"""Substring dedup on a De Bruijn graph of word windows.

A window of 13 consecutive words is an edge between the 12-word nodes at its ends. Only repeated
edges matter, and they are found, compacted and verified in five Spark steps:

1. Documents are dealt into id-range blocks of bounded size. Each block sends the distinct
   *minimizers* of its windows (the smallest 5-gram hash inside a window) to hash buckets; equal
   windows have equal minimizers, so an edge whose minimizer is met once cannot repeat.
2. Each block sends the edges that hold a repeated minimizer, with their coordinates, to the bucket
   of the minimizer. Of copies inside one block only the first document's are sent, so an edge that
   a third of all documents share arrives once per block, never once per document.
3. A bucket gives every edge its source: the first coordinate where it occurs. Edges of one document
   that follow each other, and whose sources follow each other too, are one nonbranching path; where
   another successor was seen first, the sources jump and the path ends.
4. Paths end at bucket borders as well. A self-join of path ends with path starts finds the
   borders that are no branch, and a running count over each document's paths glues them to
   long spans.
5. Each block removes its spans and digests their words; the source blocks digest the words at
   the source coordinates, and any difference (two windows with one 64-bit hash) makes the whole
   run repeat with other hash functions.

Defined results: NULL text has no words. Row order is free. A NULL id counts as larger than every
id. Rows that share an id are the same document for "smaller id": none of them covers another, and
each row gets its own result. Documents of fewer than 13 words keep all. An empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longspan.llm.common import (
    MAX_ID,
    binary,
    block_of,
    cells,
    doc_text,
    gram_hashes,
    id_edges,
    joined,
    text_bytes,
    word_hashes,
    words,
)
from longspan.session import cut_lineage

WINDOW = 13
MINIMIZER = 5
BLOCK_BYTES = 4 << 20
ATTEMPTS = 5

_EDGES = "bucket int, block int, edges binary, rows binary, places binary"
_PATHS = "block int, row int, start int, n int, src_block int, src_row int, src_start int"
_RESULT = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string,"
    " spans array<struct<start:int,n_words:int,source_block:int,source_row:int,source_start:int>>,"
    " digests array<binary>"
)


class _Block:
    """The documents of one block in a fixed order, their edges and minimizers."""

    def __init__(self, table: pa.Table, window: int, seed: int):
        ids = [MAX_ID if x is None else x for x in table["doc_id"].to_pylist()]
        texts = table["text"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] is not None, texts[i] or ""))
        self.ids = [ids[i] for i in order]
        self.null_id = [table["doc_id"][i].as_py() is None for i in order]
        self.texts = [texts[i] for i in order]
        self.order = order
        self.window, self.seed = window, seed

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edge hash, minimizer, row and start of every window, in order."""
        edge, small, row, start = [], [], [], []
        m = min(MINIMIZER, self.window)
        for i, text in enumerate(self.texts):
            hashes = word_hashes(words(text))
            e = gram_hashes(hashes, self.window, self.seed)
            if not len(e):
                continue
            grams = gram_hashes(hashes, m, self.seed + 1)
            least = grams[: len(e)].copy()
            for k in range(1, self.window - m + 1):
                np.minimum(least, grams[k : k + len(e)], out=least)
            edge.append(e)
            small.append(least)
            row.append(np.full(len(e), i, np.int32))
            start.append(np.arange(len(e), dtype=np.int32))
        if not edge:
            return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int32),) * 2
        return np.concatenate(edge), np.concatenate(small), np.concatenate(row), np.concatenate(start)

    def doc_of_row(self) -> np.ndarray:
        """Number of the distinct id of each row."""
        ids = np.array(self.ids, np.int64)
        return np.cumsum(np.r_[0, ids[1:] != ids[:-1]]).astype(np.int32) if len(ids) else np.empty(0, np.int32)


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Rows of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    numbers, at = np.unique(bucket[order], return_index=True)
    return list(zip(numbers.tolist(), np.split(order, at[1:]), strict=True)) if len(bucket) else []


def _paths(block, row, start, src_block, src_row, src_start) -> dict[str, np.ndarray]:  # type: ignore[no-untyped-def]
    """Rows sorted by coordinate to maximal paths: sources step on by one with the coordinates."""
    if not len(row):
        empty = np.empty(0, np.int32)
        return dict.fromkeys(("block", "row", "start", "n", "src_block", "src_row", "src_start"), empty)
    same = (block[1:] == block[:-1]) & (row[1:] == row[:-1]) & (start[1:] == start[:-1] + 1)
    same &= (src_block[1:] == src_block[:-1]) & (src_row[1:] == src_row[:-1]) & (src_start[1:] == src_start[:-1] + 1)
    at = np.flatnonzero(np.r_[True, ~same])
    n = np.diff(np.r_[at, len(row)]).astype(np.int32)
    names = ("block", "row", "start", "src_block", "src_row", "src_start")
    return {k: v[at].astype(np.int32) for k, v in zip(names, (block, row, start, src_block, src_row, src_start), strict=True)} | {"n": n}


def _first_of(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row the first row, in this order, that has its key."""
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    out = np.empty(len(key), np.int64)
    out[order] = order[new][np.cumsum(new) - 1]
    return out


def _minimizers(window: int, seed: int, buckets: int):  # type: ignore[no-untyped-def]
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("often", pa.binary())])

    def send(table: pa.Table) -> pa.Table:
        docs = _Block(table, window, seed)
        _, small, row, _ = docs.edges()
        doc = docs.doc_of_row()[row]
        # Rows stand in document order, so a value whose first and last document agree has no other.
        order = np.argsort(small, kind="stable")
        small, doc = small[order], doc[order]
        at = np.flatnonzero(np.r_[True, small[1:] != small[:-1]][: len(small)])
        values, several = small[at], doc[at] != doc[np.r_[at[1:], len(doc)][: len(at)] - 1]
        out = {k: [] for k in schema.names}
        for number, rows in _by_bucket(_bucket(values, buckets)):
            often = several[rows]
            out["bucket"].append(number)
            out["block"].append(table["block"][0].as_py())
            out["once"].append(binary(values[rows][~often]))
            out["often"].append(binary(values[rows][often]))
        return pa.table(out, schema=schema)

    return send


def _repeated(table: pa.Table) -> pa.Table:
    """Each block's minimizers that occur in two documents."""
    once, often = cells(table["once"], np.uint64), cells(table["often"], np.uint64)
    values, times = np.unique(np.concatenate([*once, *often]), return_counts=True)
    hits = np.union1d(values[times > 1], np.concatenate([*often, np.empty(0, np.uint64)]))
    own = [np.intersect1d(np.concatenate([a, b]), hits, assume_unique=True) for a, b in zip(once, often, strict=True)]
    kept = [i for i, x in enumerate(own) if len(x)]
    return pa.table({"block": table["block"].take(pa.array(kept, pa.int64())).cast(pa.int32()), "minimizers": pa.array([binary(own[i]) for i in kept], pa.binary())})


def _send_edges(window: int, seed: int, buckets: int):  # type: ignore[no-untyped-def]
    """Repeated edges to the buckets of their minimizers (bucket >= 0), and paths inside the block (bucket -1)."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("edges", pa.binary()), ("rows", pa.binary()), ("places", pa.binary())])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in schema.names}
        if left.num_rows and right.num_rows:
            block = left["block"][0].as_py()
            docs = _Block(left, window, seed)
            edge, small, row, start = docs.edges()
            hits = np.sort(joined(right["minimizers"], np.uint64))
            found = hits[np.minimum(np.searchsorted(hits, small), len(hits) - 1)] == small
            edge, small, row, start = edge[found], small[found], row[found], start[found]
            if len(edge):
                first = _first_of(np.argsort(edge, kind="stable"), edge)
                doc = docs.doc_of_row()
                later = doc[row] != doc[row[first]]
                own = np.full(int(later.sum()), block, np.int32)
                inner = _paths(own, row[later], start[later], own, row[first][later], start[first][later])
                out["bucket"].append(-1)
                out["block"].append(block)
                out["edges"].append(binary(np.stack([inner[k] for k in ("row", "start", "n", "src_row", "src_start")])))
                out["rows"].append(b"")
                out["places"].append(b"")
                edge, small, row, start = edge[~later], small[~later], row[~later], start[~later]
                for number, rows in _by_bucket(_bucket(small, buckets)):
                    out["bucket"].append(number)
                    out["block"].append(block)
                    out["edges"].append(binary(edge[rows]))
                    # Differences of neighbours are small numbers, which the shuffle's codec packs well.
                    out["rows"].append(binary(np.diff(row[rows], prepend=np.int32(0))))
                    out["places"].append(binary(np.diff(start[rows], prepend=np.int32(0))))
        return pa.table(out, schema=schema)

    return send


def _compact(table: pa.Table) -> pa.Table:
    """Paths of one bucket whose sources lie in an earlier block."""
    parts = sorted(
        zip(table["block"].to_pylist(), cells(table["edges"], np.uint64), cells(table["rows"], np.int32), cells(table["places"], np.int32), strict=True),
        key=lambda x: x[0],
    )
    block = np.concatenate([np.full(len(e), b, np.int32) for b, e, _, _ in parts])
    edge = np.concatenate([e for _, e, _, _ in parts])
    row = np.concatenate([np.cumsum(r, dtype=np.int32) for _, _, r, _ in parts])
    start = np.concatenate([np.cumsum(p, dtype=np.int32) for _, _, _, p in parts])
    first = _first_of(np.argsort(edge, kind="stable"), edge)
    later = block > block[first]
    paths = _paths(block[later], row[later], start[later], block[first][later], row[first][later], start[first][later])
    return pa.table({k: paths[k] for k in ("block", "row", "start", "n", "src_block", "src_row", "src_start")})


def _unpacked(batches):  # type: ignore[no-untyped-def]
    for batch in batches:
        for block, packed in zip(batch["block"].to_pylist(), batch["edges"].to_pylist(), strict=True):
            row, start, n, src_row, src_start = np.frombuffer(packed, np.int32).reshape(5, -1)
            own = np.full(len(row), block, np.int32)
            yield pa.RecordBatch.from_pydict({"block": own, "row": row, "start": start, "n": n, "src_block": own, "src_row": src_row, "src_start": src_start})


def glue(paths: DataFrame) -> DataFrame:
    """Join paths that continue each other in the document and at the source, to maximal spans."""
    ends = paths.select(
        "block", "row", (F.col("start") + F.col("n")).alias("start"), "src_block", "src_row",
        (F.col("src_start") + F.col("n")).alias("src_start"), F.lit(0).alias("head"),
    )
    keys = ["block", "row", "start", "src_block", "src_row", "src_start"]
    marked = paths.join(ends, keys, "left").withColumn("head", F.coalesce("head", F.lit(1)))
    in_doc = Window.partitionBy("block", "row").orderBy("start")
    return (
        marked.withColumn("span", F.sum("head").over(in_doc))
        .groupBy("block", "row", "span")
        .agg(
            F.min("start").alias("start"), F.sum("n").cast("int").alias("n"),
            F.min("src_block").alias("src_block"), F.min("src_row").alias("src_row"), F.min("src_start").alias("src_start"),
        )
        .drop("span")
    )


def _digest(tokens: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(tokens))


def _remove(window: int, seed: int, carry: tuple[str, ...]):  # type: ignore[no-untyped-def]
    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = _Block(left, window, seed) if left.num_rows else None
        spans: dict[int, list] = {}
        columns = [right[k].to_pylist() for k in ("row", "start", "n", "src_block", "src_row", "src_start")]
        for row, start, n, *source in zip(*columns, strict=True):
            spans.setdefault(row, []).append((start, n + window - 1, *source))
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans", "digests")}
        for row, text in enumerate(docs.texts if docs else ()):
            tokens, own = words(text), sorted(spans.get(row, ()))
            kept, end = [], 0
            for start, n, *_ in own:
                kept += tokens[end:start] if start > end else []
                end = max(end, start + n)
            kept += tokens[end:]
            text_left = b" ".join(kept)
            out["doc_id"].append(None if docs.null_id[row] else docs.ids[row])
            out["n_words"].append(len(tokens))
            out["n_removed"].append(len(tokens) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(text_left).hexdigest())
            out["kept_text"].append(text_left.decode("utf-8", "surrogatepass") if own else None)
            out["spans"].append([dict(zip(("start", "n_words", "source_block", "source_row", "source_start"), x, strict=True)) for x in own])
            out["digests"].append([_digest(tokens[start : start + n]) for start, n, *_ in own])
        kept_rows = pa.array(docs.order if docs else [], pa.int64())
        kind = pa.struct([(k, pa.int32()) for k in ("start", "n_words", "source_block", "source_row", "source_start")])
        return pa.table(
            {
                "doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()),
                "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
                "kept_text": pa.array(out["kept_text"], pa.string()), "spans": pa.array(out["spans"], pa.list_(kind)),
                "digests": pa.array(out["digests"], pa.list_(pa.binary())),
                **{c: left[c].take(kept_rows) for c in carry},
            }
        )

    return remove


def _differs(window: int, seed: int):  # type: ignore[no-untyped-def]
    def differs(left: pa.Table, right: pa.Table) -> pa.Table:
        """Requests whose source words have another digest."""
        wrong = 0
        if right.num_rows:
            docs = _Block(left, window, seed)
            requests: dict[int, list] = {}
            for row, start, n, digest in zip(*(right[k].to_pylist() for k in ("row", "start", "n_words", "digest")), strict=True):
                requests.setdefault(row, []).append((start, n, digest))
            for row, asked in requests.items():
                tokens = words(docs.texts[row])
                wrong += sum(_digest(tokens[start : start + n]) != digest for start, n, digest in asked)
        return pa.table({"wrong": pa.array([wrong] if wrong else [], pa.int64())})

    return differs


def remove_repeated_spans(
    docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Remove every word under a window that also starts in a document with a smaller id.

    Columns: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space),
    kept_text (NULL where nothing was removed), spans (removed windows' union pieces with block,
    row and word offset of their source), and the input's columns named in ``carry``. One row per
    input row.
    """
    carried = {f"carried_{i}": name for i, name in enumerate(carry)}
    source = doc_text(docs, *[F.col(name).alias(alias) for alias, name in carried.items()])
    parts = 1 + text_bytes(source) // block_bytes
    edges = id_edges(source, parts)
    blocks = source.withColumn("block", block_of(edges))
    by_block = blocks.groupBy("block")
    result_schema = ", ".join([_RESULT, *(f"{alias} {source.schema[alias].dataType.simpleString()}" for alias in carried)])
    for seed in range(0, 10 * ATTEMPTS, 10):
        met = by_block.applyInArrow(_minimizers(window, seed, parts), "bucket int, block int, once binary, often binary")
        repeated = met.groupBy("bucket").applyInArrow(_repeated, "block int, minimizers binary")
        # Three readers: the buckets, the paths inside blocks, and their glue.
        sent = cut_lineage(by_block.cogroup(repeated.groupBy("block")).applyInArrow(_send_edges(window, seed, parts), _EDGES))
        across = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(_compact, _PATHS)
        inside = sent.where("bucket < 0").mapInArrow(_unpacked, _PATHS)
        spans = glue(cut_lineage(across.unionByName(inside)))
        result = cut_lineage(by_block.cogroup(spans.groupBy("block")).applyInArrow(_remove(window, seed, tuple(carried)), result_schema))
        asked = (
            result.select(F.explode(F.arrays_zip("spans", "digests")).alias("x"))
            .select(
                F.col("x.spans.source_block").alias("block"), F.col("x.spans.source_row").alias("row"),
                F.col("x.spans.source_start").alias("start"), F.col("x.spans.n_words").alias("n_words"), F.col("x.digests").alias("digest"),
            )
            .distinct()
        )
        used = blocks.join(asked.select("block").distinct(), "block", "left_semi")
        if used.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_differs(window, seed), "wrong long").isEmpty():
            return result.drop("digests").withColumnsRenamed(carried)
    raise RuntimeError(f"hash functions collided {ATTEMPTS} times")
