"""Token counts by a two-tier lookup on the map side, without a shuffle of pre-tokens.

Tier 1 is a compact table of the corpus's frequent pre-tokens with their token counts. Each task
counts its pre-tokens in a bounded summary (Misra-Gries: when it is full, the smaller half goes),
tree-merged to one summary of the same bound, so only summaries move. The table has at most
FREQUENT entries, a proven bound, and is broadcast. Tier 2 is the worker's own cache of pieces met
before. Both only save time: a count never depends on what the table holds.

Defined results: NULL and empty texts have 0 bytes and 0 tokens. Rows keep their ids, also NULL or
repeated ones; an empty table gives an empty result; other columns are ignored. Texts are counted
whole, however long. The string of a special token inside a text is that token, as is the
library's default.
"""

from __future__ import annotations

import pickle
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from longspan.llm.common import doc_text
from longspan.llm.pieces import PIECE, default_tokenizer, encoder

FREQUENT = 32_768
SUMMARY = 8 * FREQUENT
LIMIT = 512


def _bounded(counts: Counter, size: int) -> Counter:
    """Misra-Gries step: take off the count at the bound, and keep what stays above zero."""
    if len(counts) <= size:
        return counts
    least = counts.most_common(size + 1)[-1][1]
    return Counter({k: v - least for k, v in counts.items() if v > least})


def _summaries(path: str):  # type: ignore[no-untyped-def]
    def summarise(batches):  # type: ignore[no-untyped-def]
        plain, counts = encoder(path).plain, Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                if text and plain(text):
                    counts.update(PIECE.findall(text))
                if len(counts) > SUMMARY:
                    counts = _bounded(counts, SUMMARY // 2)
        yield pa.RecordBatch.from_pydict({"summary": [pickle.dumps(dict(_bounded(counts, FREQUENT)))]})

    return summarise


def _merged(a: bytes, b: bytes) -> bytes:
    counts = Counter(pickle.loads(a))
    counts.update(pickle.loads(b))
    return pickle.dumps(dict(_bounded(counts, FREQUENT)))


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """At most FREQUENT pre-tokens with their numbers of tokens."""
    rows = docs.mapInArrow(_summaries(path), "summary binary").rdd.map(lambda r: bytes(r.summary))
    # Each step of the tree merges about 16 summaries, so the last one gets as many whatever the input.
    parts, depth = rows.getNumPartitions(), 2
    while 16**depth < parts:
        depth += 1
    merged = rows.treeAggregate(pickle.dumps({}), _merged, _merged, depth)
    lengths = encoder(path).counts
    return {piece: lengths[piece] for piece in pickle.loads(merged)}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Columns doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens); one row per input row."""
    path = path or default_tokenizer()
    source = doc_text(docs)
    table = source.sparkSession.sparkContext.broadcast(frequent_lengths(source, path))

    def count(batches):  # type: ignore[no-untyped-def]
        frequent, own = table.value, encoder(path)
        lookup = frequent.get
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch["text"].to_pylist():
                text = text or ""
                n_bytes.append(len(text.encode("utf-8")))
                if own.plain(text):
                    found = list(map(lookup, pieces := PIECE.findall(text)))
                    if None in found:
                        rest = own.counts
                        found = [rest[p] if n is None else n for p, n in zip(pieces, found, strict=True)]
                    n_tokens.append(sum(found))
                else:
                    n_tokens.append(len(own.library_ids(text)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return source.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
