"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Only lengths decide a packing, so the instance is the table (length, number of pieces): at most
``capacity`` rows, however many documents there are. On it the driver

1. fixes dominating sets for good (Martello-Toth): a full piece alone; a piece together with its
   exact complement to the capacity; the longest piece alone if not even the shortest fits beside
   it, or with the longest that fits if no two pieces fit in its place. Each time the instance
   shrinks, and more sets may dominate;
2. packs the rest by best fit, longest lengths first, over open room by size.

Both work on whole runs of equal pieces, so the plan is a table of fillings (a list of lengths and
how many sequences use it). Executors then number the pieces of every length: a distributed rank
(counts per length and part, then an offset per part), never one global order. The n-th
piece of a length goes to the slot of that number.

Defined results: NULL and empty texts are the single end token. Rows with equal ids are packed as
rows of their own. An empty table gives an empty result. Documents longer than the capacity are cut
into pieces of exactly the capacity but for the first, which takes the remainder.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longspan.llm.common import doc_text
from longspan.llm.pieces import default_tokenizer, encoder
from longspan.session import cut_lineage

CAPACITY = 2048
END = 0
PARTS = 256

Filling = tuple[int, tuple[int, ...]]


def pieces_of(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""

    def cut(batches):  # type: ignore[no-untyped-def]
        own, end = encoder(path), np.array([END], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = memoryview(own.ids_of(text or "") + end)
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    length = capacity if piece else first
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()], names=list(out)
            )

    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Lengths:
    """Numbers of pieces by length, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v}
        self.order = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.order.pop(bisect.bisect_left(self.order, length))

    def longest(self, room: int) -> int | None:
        at = bisect.bisect_right(self.order, room)
        return self.order[at - 1] if at else None


def dominating(left: _Lengths, capacity: int) -> list[Filling]:
    """Fix sets that are part of some best packing, until no rule applies; ``left`` keeps the rest."""
    plan: list[Filling] = []

    def fix(lengths: tuple[int, ...], n: int) -> None:
        plan.append((n, lengths))
        for length in lengths:
            left.take(length, n)

    for length in list(left.order)[::-1]:
        n, mate = left.count.get(length, 0), capacity - length
        if length == capacity:
            fix((length,), n)
        elif n and mate == length and n > 1:
            plan.append((n // 2, (length, length)))
            left.take(length, n // 2 * 2)
        elif n and length > mate and (m := min(n, left.count.get(mate, 0))):
            fix((length, mate), m)
    while left.order:
        length = left.order[-1]
        room = capacity - length
        if left.order[0] > room:
            fix((length,), left.count[length])
            continue
        shortest = left.order[0]
        # The two shortest pieces together do not fit beside it, so it takes one piece at most: the longest.
        second = shortest if left.count[shortest] > 1 else (left.order[1] if len(left.order) > 1 else capacity)
        mate = left.longest(room)
        if length * 2 <= capacity or shortest + second <= room or mate is None:
            break
        fix((length, mate), min(left.count[length], left.count[mate]))
    return plan


def best_fit(left: _Lengths, capacity: int) -> list[Filling]:
    """Longest lengths first, each into the fullest sequences that still have room for it."""
    full: list[Filling] = []
    open_by_room: dict[int, list[list]] = {}  # room -> [number of sequences, lengths]
    rooms: list[int] = []

    def put(room: int, n: int, lengths: tuple[int, ...]) -> None:
        if not room:
            full.append((n, lengths))
            return
        if room not in open_by_room:
            open_by_room[room] = []
            bisect.insort(rooms, room)
        open_by_room[room].append([n, lengths])

    for length in left.order[::-1]:
        n = left.count[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n // each:
                    put(capacity - each * length, n // each, (length,) * each)
                if n % each:
                    put(capacity - n % each * length, 1, (length,) * (n % each))
                break
            room = rooms[at]
            group = open_by_room[room][-1]
            fits = room // length
            if n >= fits:
                used, times = min(group[0], n // fits), fits
            else:
                used, times = 1, n
            group[0] -= used
            lengths = group[1]
            if not group[0]:
                open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(at)
            n -= used * times
            put(room - times * length, used, lengths + (length,) * times)
    return full + [(n, lengths) for groups in open_by_room.values() for n, lengths in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Filling]:
    """(number of sequences, lengths in it); every piece has one slot."""
    left = _Lengths(counts)
    return dominating(left, capacity) + best_fit(left, capacity)


def slots(fillings: list[Filling]) -> list[tuple]:
    """(length, first and end of slot numbers, first sequence, offset) of each place in a filling."""
    rows, taken, sequence = [], {}, 0
    for n, lengths in fillings:
        offset = 0
        for length in lengths:
            first = taken.get(length, 0)
            taken[length] = first + n
            rows.append((length, first, first + n, sequence, offset))
            offset += length
        sequence += n
    return rows


def numbered(pieces: DataFrame) -> DataFrame:
    """Number, from 0, of each piece among those of its length, without ordering them in one task."""
    order = ["doc_id", "piece", "start", "ids_crc32"]
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int"))
    sizes = parted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    in_part = F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)).cast("long")
    return (
        parted.withColumn("place", in_part - 1)
        .join(starts, ["length", "part"])
        .withColumn("slot", F.col("base") + F.col("place"))
        .drop("part", "base", "place")
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    path = path or default_tokenizer()
    # Two readers, the lengths and the assignment; the texts are encoded once.
    pieces = cut_lineage(pieces_of(doc_text(docs), path, capacity))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = pieces.sparkSession.createDataFrame(
        slots(plan(counts, capacity)), "length long, first long, end long, sequence long, offset long"
    )
    # At most ``capacity`` rows, each with the few runs of its length: a bound that no input moves, so it is broadcast.
    by_length = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "end", "sequence", "offset"))).alias("runs"))
    placed = numbered(pieces).join(F.broadcast(by_length), "length")
    run = F.expr("filter(runs, r -> r.first <= slot AND slot < r.end)[0]")
    return placed.withColumn("run", run).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.sequence") + F.col("slot") - F.col("run.first")).alias("sequence_id"),
        F.col("run.offset").alias("offset"),
    )
