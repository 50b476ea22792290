"""Exact top-k search over binary codes by incremental multi-index hashing.

A code's bits are cut into segments, and (segment, value) -> codes is the index. If two codes differ in
at most s * (r + 1) - 1 bits over s segments, some segment differs in at most r bits. So after all
segment values within radius r have been probed, every code up to that distance has been seen, and
a query is finished once its k-th verified distance is within it. Radii grow one by one; each
round only takes the queries that are not finished, and probes only the values at that exact radius. With
radius r in its first j segments and r - 1 in the others a query is covered up to s * r + j - 1, so a
query that has k neighbours probes no more segments than its k-th distance asks for.

Segments are so wide that a value holds about BUCKET codes, which lie in arrays of about CHUNK codes; a hot
value is many arrays. A probe meets an array as one row, and distances are verified inside the array:
only codes within the query's k-th distance so far, and within the k + 1 nearest of the array, become
rows. A pair is made by the first (radius, segment) that meets it, so no pair is made twice.

The bit masks of a radius are listed on the driver. Where a segment has more than
MOST_MASKS of them, or more than there are arrays for (and above FEW_MASKS), the queries that are still
open read every array of one segment instead, which covers all codes.

The index holds distinct codes, each with its number of rows and its k + 1 smallest ids, so any number of
equal vectors is one entry. The last possible radius covers all codes, so the search ends.

Ties go to the smaller id. A row never finds itself (one row of its id is left out). Defined results:
NULL vectors, and NULL ids among the indexed rows, are not searched and not found; dimensions beyond
the longest vector are 0 bits, as are NULL elements. Rows with equal ids are one row each; a query is a
distinct pair of id and code. With fewer than k other rows a query returns them all. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.session import cut_lineage

BITS = 64
MOST_SEGMENTS = 16
BUCKET = 256
CHUNK = 1024
FEW_MASKS = 256
MOST_MASKS = 65_536
K = 10


def sign_code(embedding: str, bits: int = BITS) -> Column:
    """Bit i of the code is set where element i is above 0."""
    code = F.lit(0).cast("long")
    for i in range(bits):
        on = F.coalesce(F.get(F.col(embedding), F.lit(i)) > 0, F.lit(False))
        code = code.bitwiseOR(F.when(on, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return code


def segments_for(codes: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of each segment: so wide that about BUCKET of evenly spread codes share a value."""
    parts = min(MOST_SEGMENTS, max(1, round(bits / max(1.0, math.log2((codes + 1) / BUCKET)))))
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:], strict=False)]


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in chosen) for chosen in combinations(range(width), radius)]


def _entries(codes: DataFrame, k: int) -> DataFrame:
    """Distinct codes with their k + 1 smallest ids, as a query's own may be among them; a hot code is cut down in parts first."""
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = salted.withColumn("n", F.row_number().over(Window.partitionBy("code", "salt").orderBy("id"))).where(F.col("n") <= k + 1)
    kept = some.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    return kept.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _part_value(code: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _values(code: str, segments: list[tuple[int, int]]) -> Column:
    """One (segment, value) for each segment."""
    parts = [F.struct(F.lit(i).alias("segment"), _part_value(F.col(code), *part).alias("value")) for i, part in enumerate(segments)]
    return F.explode(F.array(*parts)).alias("part")


def _buckets(entries: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """segment, value, chunk, codes: the codes of a segment value in arrays of about CHUNK."""
    flat = entries.select("code", _values("code", segments)).select("code", "part.*")
    sizes = flat.groupBy("segment", "value").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = flat.join(sizes, ["segment", "value"]).withColumn("chunk", F.pmod(F.xxhash64("code"), F.col("chunks")))
    return dealt.groupBy("segment", "value", "chunk").agg(F.collect_list("code").alias("codes"))


def _verified(met: DataFrame, segments: list[tuple[int, int]], radius: int, k: int, scanned: bool) -> DataFrame:
    """query_id, query_code, code, distance of the codes in the met arrays that may be among the k nearest and were not met before."""

    def distance(code: Column) -> Column:
        return F.bit_count(code.bitwiseXOR(F.col("query_code")))

    def first_met(code: Column) -> Column:
        gaps = [F.bit_count(_part_value(code.bitwiseXOR(F.col("query_code")), *part)) for part in segments]
        if scanned:
            return (F.least(*gaps) if len(gaps) > 1 else gaps[0]) >= radius
        turns = [gap * len(segments) + i for i, gap in enumerate(gaps)]
        return (F.least(*turns) if len(turns) > 1 else turns[0]) == F.lit(radius * len(segments)) + F.col("segment")

    # k + 1 codes, as the query's own may be among them.
    nearest = F.get(F.sort_array(F.transform("codes", distance)), F.lit(k))
    bound = F.least(F.col("farthest"), nearest)  # least() skips the NULL of a short array
    within = met.withColumn("bound", bound)
    near = F.filter("codes", lambda code: (distance(code) <= F.col("bound")) & first_met(code))
    rows = within.select("query_id", "query_code", F.explode(near).alias("code"))
    return rows.withColumn("distance", distance(F.col("code")))


def top_k_codes(codes: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS) -> DataFrame:
    """query_id, rank, neighbor_id, distance from ``codes`` (id, code) and ``queries`` (id, code)."""
    spark = codes.sparkSession
    entries = cut_lineage(_entries(codes, k))
    segments = segments_for(entries.count(), bits)
    parts = len(segments)
    widest = max(width for _, width in segments)
    buckets = cut_lineage(_buckets(entries, segments))
    arrays = buckets.where("segment = 0").count()
    query = ["query_id", "query_code"]
    # ``need``: the segments to probe in the round; ``farthest``: the k-th distance so far.
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query_code")).distinct()
    asked = cut_lineage(asked.withColumns({"need": F.lit(parts), "farthest": F.lit(bits)}))
    found, answers = None, None
    for radius in range(1 + widest):
        masks_each = math.comb(widest, radius)
        scanned = masks_each > MOST_MASKS or masks_each > max(FEW_MASKS, arrays)
        if scanned:
            # Every open query goes to every slot once; the arrays are dealt over the slots.
            slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
            everywhere = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
            dealt = buckets.where("segment = 0").withColumn("slot", F.pmod(F.xxhash64("value", "chunk"), F.lit(slots)).cast("int"))
            met = everywhere.join(dealt, "slot")
        else:
            masks = spark.createDataFrame(
                [(i, mask) for i, (_, width) in enumerate(segments) for mask in _masks(width, radius)], "segment int, mask long"
            )
            own = asked.select(*query, "need", "farthest", _values("query_code", segments)).where("part.segment < need")
            probes = own.select(*query, "farthest", "part.*").join(F.broadcast(masks), "segment")
            met = probes.withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).join(buckets, ["segment", "value"])
        fresh = _neighbors(_verified(met, segments, radius, k, scanned), entries)
        reached = cut_lineage(_nearest(fresh if found is None else found.unionByName(fresh), k))
        per_query = reached.groupBy(*query).agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        state = cut_lineage(asked.select(*query).join(per_query, query, "left"))
        covered = F.lit(parts * radius - 1) + F.lit(parts)
        final = scanned or radius == widest
        done = (F.col("n") >= k) & (F.col("last") <= covered)
        open_ = state.where(F.lit(False) if final else ~F.coalesce(done, F.lit(False)))
        enough = F.col("n") >= k
        need = F.when(enough, F.least(F.col("last") - F.lit(parts * (radius + 1) - 1), F.lit(parts))).otherwise(F.lit(parts))
        asked = cut_lineage(
            open_.select(*query, need.cast("int").alias("need"), F.when(enough, F.col("last")).otherwise(F.lit(bits)).alias("farthest"))
        )
        finished = reached if final else reached.join(asked.select(*query), query, "left_anti")
        answers = finished if answers is None else answers.unionByName(finished)
        if final or asked.isEmpty():
            break
        found = reached.join(asked.select(*query), query, "left_semi")
    rank = F.row_number().over(Window.partitionBy(*query).orderBy("distance", "neighbor_id"))
    return answers.select("query_id", rank.alias("rank"), "neighbor_id", "distance")


def _neighbors(verified: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows behind verified codes, at most k + 1 for a code; one row of the query's own id is the query itself."""
    rows = verified.join(entries, "code").select("*", F.posexplode("ids").alias("at", "neighbor_id"))
    itself = (F.col("code") == F.col("query_code")) & (F.col("at") + 1 == F.array_position("ids", F.col("query_id")))
    return rows.where(~itself).select("query_id", "query_code", "distance", "neighbor_id")


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("query_id", "query_code").orderBy("distance", "neighbor_id"))
    return rows.withColumn("n", order).where(F.col("n") <= k).drop("n")


def search_embeddings(embeddings: DataFrame, k: int = K, every: int = 100) -> DataFrame:
    """Queries are all rows whose id is divisible by ``every``, against all rows."""
    codes = embeddings.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("id"), sign_code("embedding").alias("code")
    )
    return top_k_codes(codes, codes.where(F.col("id") % every == 0).distinct(), k)
