"""Helpers shared by the text operators: input columns, words, hashes, id-range blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ID = 2**63 - 1
WORD_CACHE = 250_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_text(docs: DataFrame, *more: Column) -> DataFrame:
    """Only the id and the text (and ``more``), so that no further column of the input can clash with internal names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


class WordHashes(dict):
    """64-bit hash of a word; at most WORD_CACHE words are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_word_hashes = WordHashes()


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space and U+0009 to U+000D: exactly what bytes.split takes as white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word_hashes.__getitem__, tokens), np.uint64, len(tokens))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = values ^ (values >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n words, in order; empty when there are fewer words."""
    size = len(hashes) - n + 1
    if size < 1:
        return np.empty(0, np.uint64)
    out = np.full(size, 0x9E3779B97F4A7C15 + seed, np.uint64)
    base = np.uint64((0xD6E8FEB86659FD93 + 2 * seed) % 2**64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * base + hashes[k : k + size]
    return mix(out)


def id_edges(docs: DataFrame, blocks: int) -> np.ndarray:
    """Upper ends of id ranges that hold about equally many rows; rows of one id share a range."""
    if blocks < 2:
        return np.empty(0, np.int64)
    shares = ",".join(f"{i / blocks!r}D" for i in range(1, blocks))
    row = docs.select(F.expr(f"approx_percentile(doc_id, array({shares}), {max(10_000, 20 * blocks)}) AS e")).first()
    return np.unique(np.array(row.e or [], np.int64))


def block_of(edges: np.ndarray) -> Column:
    """Number of the id range; a NULL id falls in the last one."""

    @F.pandas_udf("int")
    def block(ids):  # type: ignore[no-untyped-def]
        import pandas as pd

        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="left").astype(np.int32))

    # NULLs go before the call, as pandas would turn all ids of the batch to doubles.
    return block(F.coalesce("doc_id", F.lit(MAX_ID)))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b


def binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def joined(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    """All the binary cells of a column as one array."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def cells(column: pa.ChunkedArray, kind: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]
