"""Exact Jaccard join of word n-gram sets through a signature tree.

A node of the tree stands for documents and holds the OR of their token bitmaps, their range of set
sizes and of the slack between size and bitmap. For a pair of nodes the overlap of any two documents
is at most the smaller slack plus the common bits, so node pairs that cannot reach the threshold are
cut without looking at their documents.

The tree's upper levels are laid out by a shuffle, its lower ones inside tasks:

1. Copies: documents with equal sets become one, their smallest id.
2. Upper nodes: a size class, and in it one slice of the token space with exactly equal content. Sets
   that reach the threshold differ in at most d tokens, so of more than d slices with tokens they agree
   on a whole one: two documents that share no upper node cannot link. Sets whose slices are too
   often empty for that take finer slices as well; the keys stay linear in the tokens.
   A task sends each upper node's smallest document only, and links the others to that one
   itself, so a node that a third of the rows share gets one row per task.
   With k slices that have tokens, linked sets agree on k - d of them at least. So a document leaves its
   k - d - 1 nodes of most documents: of all nodes in one order, the first that two linked sets share
   stays with both. One that shares no more nodes than that with all others together is done. Nodes that
   documents tie together become one while they hold no more than a block's documents.
3. Every document is checked against that first document with which it shares most nodes; the links
   give first components. Nodes that lie in one component are done, as only reachability is asked,
   and of nodes with the same documents one is enough.
4. Of the other nodes the lower trees are built (documents in order of size and bitmap, 16 to a
   node), and traversed in pairs. Pairs in one component are cut too. Nodes of many documents are
   traversed as pairs of blocks in tasks of their own.
5. Surviving pairs are checked exactly on whole texts, the most promising of each document first. Their
   links join components, which cuts most of the others, and steps 4 and 5 repeat with sixteen times
   as many pairs to a document, for the blocks that left a pair unchecked, until there are none.

Sets are held as 64-bit hashes of the n-grams. Defined results: NULL, empty and blank texts have an
empty set and link with nothing. Texts of fewer words than n have one token, the whole sequence. Rows
that share an id are one document for reachability. NULL ids count as one largest id, given back as
NULL. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longspan.llm.common import MAX_ID, binary, cells, doc_text, gram_hashes, mix, text_bytes, word_hashes, words
from longspan.llm.components import components
from longspan.session import cut_lineage, temporary_tables

N = 3
PERCENT = 90
CLASS_RATIO = 1.5
FANOUT = 16
BLOCK = 1024
#: Bits to a token in a document's bitmap, at least. With few, tokens that differ fall on one bit so often that many pairs
#: below the threshold pass. Bitmaps over WIDE_BITS get fewer, down to LEAST_BITS, which bounds the blocks' memory.
BITS, LEAST_BITS, WIDE_BITS = 16, 2, 1 << 16
#: 64-bit words of bitmaps compared at once, and node pairs whose children are.
COMPARED_WORDS, OPENED_PAIRS = 1 << 20, 512
FLUSH = 4_000_000
BUCKET_BYTES = 16 << 20
LEVELS = 3
#: Times that labels pass from documents to nodes and back.
TIES = 2
#: The lowest bits of a node's key say its size class and level.
SLOT = (1 << 9) - 1
#: Bytes of keys that a task holds before it passes them on.
HELD_BYTES = 16 << 20


def _lower(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted set of n-gram hashes; bytes.lower changes A-Z only."""
    hashes = word_hashes(_lower(text))
    grams = gram_hashes(hashes, n) if len(hashes) >= n else gram_hashes(hashes, len(hashes), 1) if len(hashes) else hashes
    return np.unique(grams)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


class _Classes:
    """Size classes with their number of slices. A pair meets in the class of its larger set."""

    def __init__(self, percent: int):
        self.percent = percent
        # So many more slices than can differ that, in most sets, more of them have tokens than can differ.
        self.spread = 2 - percent / 100

    def of(self, size: int) -> int:
        c = int(np.log(size) / np.log(CLASS_RATIO))
        while self.low(c + 1) <= size:
            c += 1
        while self.low(c) > size:
            c -= 1
        return c

    @staticmethod
    def low(c: int) -> int:
        return int(np.ceil(CLASS_RATIO**c))

    def slices(self, c: int) -> int:
        """One more than the most tokens in which two linked sets can differ, both no larger than the class."""
        return (100 - self.percent) * 2 * (self.low(c + 1) - 1) // (100 + self.percent) + 1

    def joined(self, size: int) -> list[int]:
        """Its own class, and the next ones as far as a set there can link."""
        c = self.of(size)
        out = [c]
        while size * 100 >= self.percent * self.low(out[-1] + 1):
            out.append(out[-1] + 1)
        return out


def _slice_sums(tokens: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Per slice of the ordered token space the sum of mixed tokens, and whether it is empty."""
    upper = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
    at = np.r_[0, np.searchsorted(tokens, upper), len(tokens)]
    sums = np.r_[np.uint64(0), np.cumsum(mix(tokens), dtype=np.uint64)]
    with np.errstate(over="ignore"):
        return sums[at[1:]] - sums[at[:-1]], at[1:] == at[:-1]


def upper_nodes(tokens: np.ndarray, classes: _Classes) -> np.ndarray:
    """Keys of the upper nodes that hold a set: at most LEVELS + 1 for each token and class.

    Linked sets differ in at most d tokens, so at most d of a set's slices differ. Only slices with
    tokens get a key; a set with more than d of them has one that its partner holds too. A set with
    fewer adds the keys of twice as many slices, and so on, and in the end a key per token, of which it
    has more than d. The partner of a set that is content at a level has come to that level as well,
    or was content before and then met it there.
    """
    keys = []
    with np.errstate(over="ignore"):
        for c in classes.joined(len(tokens)):
            most = classes.slices(c) - 1
            if most == 0:
                continue  # only equal sets can link, and they are one document already
            for level in range(LEVELS + 1):
                salt = np.uint64((c << 40) + (level << 50))
                if level == LEVELS:
                    keys.append(_in_slot(mix(mix(tokens) + mix(np.array([salt]))), c, level))
                    break
                parts = int(np.ceil(classes.spread * (most + 1))) << level
                sums, empty = _slice_sums(tokens, parts)
                keys.append(_in_slot(mix(sums + mix(np.arange(parts, dtype=np.uint64) + salt))[~empty], c, level))
                if len(keys[-1]) > most:
                    break
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def _in_slot(keys: np.ndarray, c: int, level: int) -> np.ndarray:
    return keys & np.uint64(~SLOT & (1 << 64) - 1) | np.uint64(c << 2 | level)


def spare_nodes(nodes: np.ndarray, classes: _Classes) -> list[dict[str, int]]:
    """Per class and level (slot) of a set's nodes, how many fewer than it shares with any set linked to it there."""
    slots, sizes = np.unique(np.unique(nodes) & np.uint64(SLOT), return_counts=True)
    return [{"slot": s, "spare": max(0, k - classes.slices(s >> 2))} for s, k in zip(slots.tolist(), sizes.tolist(), strict=True)]


SPARES = pa.list_(pa.struct([("slot", pa.int64()), ("spare", pa.int64())]))


def _sets(n: int, percent: int):  # type: ignore[no-untyped-def]
    def sets(batches):  # type: ignore[no-untyped-def]
        classes = _Classes(percent)
        kinds = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "digest": pa.binary(), "nodes": pa.binary(), "spares": SPARES}
        rows: list[tuple] = []
        held = 0

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                tokens = shingles(text.as_py(), n)
                digest = xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None
                nodes = upper_nodes(tokens, classes) if len(tokens) else None
                spares = spare_nodes(nodes, classes) if len(tokens) else None
                rows.append((doc_id.as_py(), len(tokens), digest, None if nodes is None else binary(nodes), spares))
                held += 200 + (0 if nodes is None else nodes.nbytes)
                if held > HELD_BYTES:
                    yield passed_on()
                    rows, held = [], 0
        if rows:
            yield passed_on()

    return sets


def _send(buckets: int):  # type: ignore[no-untyped-def]
    """Smallest document of each upper node in a task to the node's bucket; the others are met here."""

    def send(batches):  # type: ignore[no-untyped-def]
        keys: list[np.ndarray] = []
        docs: list[np.ndarray] = []

        def flush():  # type: ignore[no-untyped-def]
            key, doc = np.concatenate(keys), np.concatenate(docs)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.r_[True, key[1:] != key[:-1]]
            first = doc[new][np.cumsum(new) - 1]
            met = (~new) & (doc != first)
            bucket = ((key[new] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            numbers, at = np.unique(bucket[by], return_index=True)
            out = [(int(b), binary(key[new][r]), binary(doc[new][r]), b"") for b, r in zip(numbers, np.split(by, at[1:]), strict=True)]
            if met.any():
                # Any bucket passes these on; the task's own first key picks one.
                out.append((int(bucket[0]), binary(key[met]), binary(doc[met]), binary(first[met])))
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2, 3))],
                ["bucket", "keys", "docs", "firsts"],
            )

        for batch in batches:
            for doc, own in zip(batch["doc_id"].to_pylist(), batch["nodes"].to_pylist(), strict=True):
                keys.append(np.frombuffer(own, np.uint64))
                docs.append(np.full(len(keys[-1]), doc, np.int64))
            if sum(map(len, keys)) > FLUSH:
                yield flush()
                keys.clear()
                docs.clear()
        if keys:
            yield flush()

    return send


def _meet(table: pa.Table) -> pa.Table:
    """(node, doc, first) of the documents of every upper node that holds two or more."""
    keys, docs, firsts = cells(table["keys"], np.uint64), cells(table["docs"], np.int64), cells(table["firsts"], np.int64)
    passed = [i for i, f in enumerate(firsts) if len(f)]
    sent = [i for i, f in enumerate(firsts) if not len(f)]
    key = np.concatenate([keys[i] for i in sent]) if sent else np.empty(0, np.uint64)
    doc = np.concatenate([docs[i] for i in sent]) if sent else np.empty(0, np.int64)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
    first = doc[new][np.cumsum(new) - 1] if len(key) else doc
    several = doc != first
    return pa.table(
        {
            "node": np.concatenate([key[several], *(keys[i] for i in passed)]).view(np.int64),
            "doc": np.concatenate([doc[several], *(docs[i] for i in passed)]),
            "first": np.concatenate([first[several], *(firsts[i] for i in passed)]),
        }
    )


def _check(n: int, percent: int):  # type: ignore[no-untyped-def]
    def check(batches):  # type: ignore[no-untyped-def]
        last, tokens = None, None
        for batch in batches:
            kept = []
            columns = (batch[k].to_pylist() for k in ("b", "text_a", "text_b"))
            for i, (b, text_a, text_b) in enumerate(zip(*columns, strict=True)):
                if last is None or last != (b, text_b):
                    last, tokens = (b, text_b), shingles(text_b, n)
                if _linked(shingles(text_a, n), tokens, percent):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return check


def checked(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold, on whole texts."""
    side_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    side_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    # b is often the first of many, so it is joined last and its set is built once for consecutive rows.
    return pairs.join(side_a, "a").join(side_b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_check(n, percent), "a long, b long")


def _bits(size: int) -> int:
    least, wanted = (1 << max(6, (k * size - 1).bit_length()) for k in (LEAST_BITS, BITS))
    return max(least, min(wanted, WIDE_BITS))


def _bitmaps(n: int):  # type: ignore[no-untyped-def]
    def bitmaps(batches):  # type: ignore[no-untyped-def]
        for batch in batches:
            sizes, maps = [], []
            for text in batch["text"].to_pylist():
                tokens = shingles(text, n)
                bits = _bits(len(tokens))
                on = np.zeros(bits, bool)
                on[(mix(tokens ^ np.uint64(0x5A5A5A5A)) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)] = True
                sizes.append(len(tokens))
                maps.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], ["doc", "size", "bitmap"])

    return bitmaps


class SignatureTree:
    """Levels of nodes over documents in order of size; level 0 has the documents themselves."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, component: np.ndarray):
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [{"bits": bits, "least": size, "most": size, "slack": size - ones, "from": component, "to": component}]
        while len(self.levels[-1]["least"]) > 1:
            below = self.levels[-1]
            at = np.arange(0, len(below["least"]), FANOUT)
            fold = {"bits": np.bitwise_or, "least": np.minimum, "most": np.maximum, "slack": np.maximum, "from": np.minimum, "to": np.maximum}
            self.levels.append({k: f.reduceat(below[k], at, axis=0) for k, f in fold.items()})


def _may_link(one: dict, two: dict, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether documents below two nodes can link, and the most they can have in common."""
    most = np.zeros(len(i), np.int64)
    keep = (100 * one["most"][i] >= percent * two["least"][j]) & (100 * two["most"][j] >= percent * one["least"][i])
    done = (one["from"][i] == one["to"][i]) & (two["from"][j] == two["to"][j]) & (one["from"][i] == two["from"][j])
    keep &= ~done
    at = np.flatnonzero(keep)
    step = max(1, COMPARED_WORDS // one["bits"].shape[1])
    for start in range(0, len(at), step):
        part = at[start : start + step]
        common = np.bitwise_count(one["bits"][i[part]] & two["bits"][j[part]]).sum(axis=1, dtype=np.int64)
        most[part] = overlap = common + np.minimum(one["slack"][i[part]], two["slack"][j[part]])
        # 100 * overlap >= percent * union, with union = sizes - overlap
        keep[part] = (100 + percent) * overlap >= percent * (one["least"][i[part]] + two["least"][j[part]])
    return keep, most


def traverse(one: SignatureTree, two: SignatureTree, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document pairs that no node pair above them rules out, and their most possible overlap relative
    to their sizes; each pair once if both trees are the same."""

    def kept(level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        if same:
            ordered = i <= j if level else i < j
            i, j = i[ordered], j[ordered]
        keep, most = _may_link(one.levels[level], two.levels[level], i, j, percent)
        return i[keep], j[keep], most[keep]

    def children(level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = np.arange(FANOUT)
        below_i = np.repeat(i * FANOUT, FANOUT * FANOUT) + np.tile(np.repeat(steps, FANOUT), len(i))
        below_j = np.repeat(j * FANOUT, FANOUT * FANOUT) + np.tile(np.tile(steps, FANOUT), len(j))
        inside = (below_i < len(one.levels[level]["least"])) & (below_j < len(two.levels[level]["least"]))
        return below_i[inside], below_j[inside]

    top = min(len(one.levels), len(two.levels)) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(one.levels[top]["least"])), np.arange(len(two.levels[top]["least"]))))
    i, j, most = kept(top, i, j)
    for level in range(top - 1, -1, -1):
        # A few node pairs at a time, so only pairs that are kept are held.
        starts = range(0, max(1, len(i)), OPENED_PAIRS)
        parts = [kept(level, *children(level, i[s : s + OPENED_PAIRS], j[s : s + OPENED_PAIRS])) for s in starts]
        i, j, most = (np.concatenate(p) for p in zip(*parts, strict=True))
    return i, j, most / (one.levels[0]["least"][i] + two.levels[0]["least"][j])


def _pairs(percent: int, each: int):  # type: ignore[no-untyped-def]
    def tree(table: pa.Table, width: int) -> tuple[np.ndarray, SignatureTree]:
        bits = np.stack([_folded(m, width) for m in cells(table["bitmap"], np.uint64)])
        size, doc = table["size"].to_numpy().astype(np.int64), table["doc"].to_numpy()
        order = np.lexsort((doc, *bits.T[:4], size))
        return doc[order], SignatureTree(size[order], bits[order], table["component"].to_numpy()[order])

    def pairs(table: pa.Table) -> pa.Table:
        # Bits are the leading ones of a hash, so longer maps fold to the shortest.
        width = min(map(len, table["bitmap"].to_pylist())) // 8
        side = table["side"].to_numpy()
        parts = [table.filter(pa.array(side == s)) for s in (0, 1)]
        if not parts[0].num_rows:
            # No document fell in the first block; the second one meets itself elsewhere.
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "more": pa.array([], pa.bool_())})
        one, t1 = tree(parts[0], width)
        two, t2 = tree(parts[1], width) if parts[1].num_rows else (one, t1)
        i, j, hope = traverse(t1, t2, percent, same=not parts[1].num_rows)
        # The most promising ones of each document come first; ``more`` tells that some were left.
        order = np.lexsort((one[i], -hope, j))
        i, j = i[order], j[order]
        at = np.flatnonzero(np.r_[True, j[1:] != j[:-1]]) if len(j) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[at, len(j)])
        place = np.arange(len(j)) - np.repeat(at, sizes)
        first = place < each
        a, b = one[i[first]], two[j[first]]
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b), "more": np.repeat(sizes > each, sizes)[first]})

    return pairs


def _folded(bitmap: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of fewer 64-bit words, by OR of neighbouring bits."""
    if len(bitmap) <= width:
        return bitmap
    on = np.unpackbits(bitmap.view(np.uint8), bitorder="little").reshape(width * 64, -1).any(axis=1)
    return np.packbits(on, bitorder="little").view(np.uint64)


def _members(met: DataFrame, spares: DataFrame) -> DataFrame:
    """(node, doc, blocks) of every upper node, without the nodes that documents can spare; of nodes with the same documents only one.

    Documents take the smallest label that they meet in their nodes, a few times over. Nodes of one class and
    level whose documents all have one label are one node if they hold no more documents than a block, so
    a document of many such nodes moves once. The other nodes stay as they are.
    The order of all nodes is that of their numbers of documents, and of equal ones their keys'. Different
    sets under one id are spared what each of them can spare, and those under the NULL id nothing.
    """
    members = met.select("node", "doc").unionByName(met.select("node", F.col("first").alias("doc"))).distinct()
    sizes = members.groupBy("node").agg(F.count("*").alias("n"))
    named = members.where(F.col("doc") != MAX_ID).join(sizes, "node").withColumn("slot", F.col("node").bitwiseAND(SLOT))
    place = F.row_number().over(Window.partitionBy("doc", "slot").orderBy(F.desc("n"), F.desc("node")))
    least = spares.groupBy("doc", "slot").agg(F.min("spare").alias("spare"))
    needed = named.withColumn("place", place).join(least, ["doc", "slot"]).where("place > spare").select("node", "doc")
    members = cut_lineage(needed.unionByName(members.where(F.col("doc") == MAX_ID)))
    sizes = members.groupBy("node").agg(F.count("*").alias("n"), F.min("doc").alias("first")).where("n > 1")
    members = cut_lineage(members.join(sizes.select("node", "first"), "node"))
    labels = members.groupBy("doc").agg(F.min("first").alias("label"))
    for _ in range(TIES):
        least = members.join(labels, "doc").groupBy("node").agg(F.min("label").alias("least"))
        labels = members.join(least, "node").groupBy("doc").agg(F.min("least").alias("label"))
    named = members.join(labels, "doc")
    ends = named.groupBy("node").agg(F.min("label").alias("l0"), F.max("label").alias("l1"))
    group = F.when(F.expr("l0 = l1"), F.xxhash64("l0", F.col("node").bitwiseAND(SLOT)))
    members = cut_lineage(members.join(ends, "node").select("node", "doc", group.alias("group")))
    of_groups = members.where("group IS NOT NULL").select("group", "doc").distinct()
    fitting = of_groups.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") <= BLOCK).select("group")
    small = of_groups.join(fitting, "group", "left_semi").select(F.col("group").alias("node"), "doc", F.lit(1).alias("blocks"))
    members = members.join(fitting, "group", "left_anti").select("node", "doc")
    marks = members.groupBy("node").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("m0"), F.bit_xor(F.xxhash64(F.lit(1), "doc")).alias("m1")
    )
    one_each = marks.groupBy("n", "m0", "m1").agg(F.min("node").alias("node"))
    return small.unionByName(members.join(one_each.select("node", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "node"))


def _of_blocks(percent: int, each: int):  # type: ignore[no-untyped-def]
    pairs = _pairs(percent, each)

    def of_blocks(key: tuple, table: pa.Table) -> pa.Table:
        out = pairs(table)
        for name, value in zip(("node", "one", "two"), key, strict=True):
            out = out.append_column(name, pa.array([value.as_py()] * out.num_rows, value.type))
        return out

    return of_blocks


def _candidates(
    members: DataFrame, labels: DataFrame, texts: DataFrame, n: int, percent: int, each: int, todo: DataFrame | None
) -> DataFrame:
    """Pairs (a, b, more, and where they met) of different components that a dual traversal of their node's trees leaves.

    Only of the blocks ``todo`` (node, one, two) if they are given.
    """
    if todo is not None:
        members = members.join(todo.select("node").distinct(), "node", "left_semi")
    known = labels.select(F.col("node").alias("label_node"), "component")
    labelled = members.join(known, F.col("doc") == F.col("label_node"), "left").select(
        "node", "doc", "blocks", F.coalesce("component", "doc").alias("component")
    )
    open_nodes = labelled.groupBy("node").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("node")
    open_members = cut_lineage(
        labelled.join(open_nodes, "node", "left_semi").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    )
    maps = texts.join(open_members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(
        _bitmaps(n), "doc long, size long, bitmap binary"
    )
    # A block meets itself (one = two) and every other block of its node.
    meeting = open_members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "doc", "component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    if todo is not None:
        meeting = meeting.join(todo, ["node", "one", "two"], "left_semi")
    return meeting.join(maps, "doc").groupBy("node", "one", "two").applyInArrow(
        _of_blocks(percent, each), "a long, b long, more boolean, node long, one int, two int"
    )


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest reachable doc_id) of every row.

    The result is written once, so the tables of keys, texts and links do not outlive the join.
    """
    with temporary_tables(docs.sparkSession):
        return cut_lineage(_joined(docs, n, percent), keep=True)


def _shared_nodes(source: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets (doc_id, n_shingles, digest), the upper nodes' members, and (a, b) of documents and the first one they share most nodes with."""
    buckets = 1 + text_bytes(source) // BUCKET_BYTES
    kinds = "doc_id long, n_shingles long, digest binary, nodes binary, spares array<struct<slot: long, spare: long>>"
    with temporary_tables(source.sparkSession):
        sets = cut_lineage(source.mapInArrow(_sets(n, percent), kinds))
        copies = sets.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
        kept = sets.where("length(nodes) > 0").join(
            copies.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi"
        )
        met = cut_lineage(
            kept.select("doc_id", "nodes")
            .mapInArrow(_send(buckets), "bucket int, keys binary, docs binary, firsts binary")
            .groupBy("bucket")
            .applyInArrow(_meet, "node long, doc long, first long")
        )
        members = cut_lineage(_members(met, kept.select(F.col("doc_id").alias("doc"), F.inline("spares"))), keep=True)
        used = members.select("doc").distinct()
        shared = met.groupBy("doc", "first").agg(F.count("*").alias("n"))
        shared = shared.join(used, "doc", "left_semi").join(used.select(F.col("doc").alias("first")), "first", "left_semi")
        nearest = shared.groupBy("doc").agg(F.min_by("first", F.struct(-F.col("n"), "first")).alias("b"))
        nearest = cut_lineage(nearest.select(F.col("doc").alias("a"), "b"), keep=True)
        return cut_lineage(sets.select("doc_id", "n_shingles", "digest"), keep=True), members, nearest


def _joined(docs: DataFrame, n: int, percent: int) -> DataFrame:
    source = doc_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(MAX_ID)))
    sets, members, nearest = _shared_nodes(source, n, percent)
    copies = sets.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    texts = cut_lineage(source.join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    # Rows that share an id tie their sets' copies together as links do.
    shared = sets.where("digest IS NOT NULL").join(copies, "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(checked(nearest, texts, n, percent).unionByName(shared))
    each, todo = 1, None
    while True:
        left = cut_lineage(_candidates(members, final, texts, n, percent, each, todo))
        left_over = left.agg(F.count("*").alias("pairs"), F.max("more").alias("more")).first()
        if left_over.pairs:
            # Known components stay as stars, so only the new links are worked in.
            new = checked(left.select("a", "b").distinct(), texts, n, percent)
            final = components(final.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new))
        if not left_over.more:
            break
        # All pairs of the other blocks are checked.
        todo = left.where("more").select("node", "one", "two").distinct()
        each *= 16
    out = sets.join(final, F.col("doc_id") == F.col("node"), "left")
    ids = lambda c: F.nullif(c, F.lit(MAX_ID))
    return out.select(
        ids(F.col("doc_id")).alias("doc_id"), "n_shingles", ids(F.coalesce("component", "doc_id")).alias("component_id")
    )
