"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The symbols of a pre-token are leaves of a segment tree whose nodes keep the smallest (rank, place)
below them. The root is thus the leftmost pair of lowest rank; merging it changes at most three
leaves (the pair itself, the one before, the one that vanishes), each in logarithmic time, until
the root is empty. A run of a million letters costs n log n, not n^2.

Merged words are kept per worker (at most CACHE, none above CACHED_LENGTH). Ordinary texts are
normalised and split here by an expression that equals the tokenizer's on those characters (tests
compare over every one of them); other texts go through the library's own normaliser and splitter,
and are merged here as well. Texts are handled in slices that end after white space, which no
pre-token spans, so a very long text needs no second copy. Nothing is shuffled.

Defined results: NULL and empty texts have no tokens, and the hashes of nothing. The string of a
special token inside a text is that token, as is the library's default. Rows keep their ids, also
NULL or repeated ones; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from longspan.llm.common import doc_text
from longspan.llm.pieces import UNUSUAL, _byte_letters

CACHE = 500_000
CACHED_LENGTH = 64
SLICE = 1 << 20
WORD = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
GAP = re.compile(r"[ \n\t\r]")
EMPTY = 1 << 62


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PairTree:
    """Smallest (rank, place) of a row of leaves; a value is rank * size + place, so that equal ranks go by place."""

    def __init__(self, ranks: list[int | None]):
        self.size = 1 << max(0, len(ranks) - 1).bit_length()
        leaves = [EMPTY if r is None else r * self.size + i for i, r in enumerate(ranks)]
        nodes = [EMPTY] * self.size + leaves + [EMPTY] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            nodes[i] = min(nodes[2 * i], nodes[2 * i + 1])
        self.nodes = nodes

    def lowest(self) -> int | None:
        """Place of the leftmost lowest rank."""
        root = self.nodes[1]
        return None if root == EMPTY else root % self.size

    def set(self, place: int, rank: int | None) -> None:
        nodes, i = self.nodes, self.size + place
        nodes[i] = EMPTY if rank is None else rank * self.size + place
        while i > 1:
            i >>= 1
            low = min(nodes[2 * i], nodes[2 * i + 1])
            if nodes[i] == low:
                return
            nodes[i] = low


class Words(dict):
    """word -> joined text of its tokens; long words are not kept."""

    def __init__(self, make):  # type: ignore[no-untyped-def]
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> str:
        made = self.make(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[word] = made
        return made


class Codec:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["ignore_merges"] or model["byte_fallback"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path} is no plain BPE without a decoder")
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            raise ValueError(f"{path} has special tokens that are not plain strings")
        vocab: dict[str, int] = model["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens = {i: t for t, i in chain(vocab.items(), self.special.items())}
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.merged.append(vocab[a + b])
        suffix = model["end_of_word_suffix"] or ""
        letters = [chr(c) for _, c in sorted(zip(*_byte_letters(), strict=True))]
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + suffix] for x in letters]
        self.byte = {x: i for i, x in enumerate(letters)}
        self.find_special = re.compile("|".join(map(re.escape, self.special)))
        self.ids = Words(lambda word: " ".join(map(str, self.merge(word.encode("utf-8")))))
        self.text = Words(lambda word: " ".join(self.tokens[int(i)] for i in self.ids[word].split()))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [*map(self.inner.__getitem__, word[:-1]), self.last[word[-1]]]
        n, rank_of = len(ids), self.ranks.get
        if n == 1:
            return ids
        tree = PairTree([rank_of((ids[i], ids[i + 1])) for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (i := tree.lowest()) is not None:
            j = after[i]
            ids[i] = self.merged[rank_of((ids[i], ids[j]))]  # type: ignore[index]
            k = after[i] = after[j]
            ids[j] = -1
            if k < n:
                before[k] = i
                tree.set(j, None)
            tree.set(i, rank_of((ids[i], ids[k])) if k < n else None)
            if before[i] >= 0:
                tree.set(before[i], rank_of((ids[before[i]], ids[i])))
        return [x for x in ids if x >= 0]

    def words(self, part: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if UNUSUAL.search(part) is None:
            return WORD.findall(part.lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(map(self.byte.__getitem__, piece)).decode("utf-8", "surrogateescape") for piece, _ in pieces]

    def encoded(self, text: str):  # type: ignore[no-untyped-def]
        """(joined ids, joined tokens) of each part of the text that has any."""
        start = 0
        while start < len(text):
            gap = GAP.search(text, start + SLICE)
            end = gap.end() if gap else len(text)
            part, start = text[start:end], end
            done = 0
            for found in chain(self.find_special.finditer(part), (None,)):
                words = self.words(part[done : found.start() if found else len(part)])
                if words:
                    yield " ".join(map(self.ids.__getitem__, words)), " ".join(map(self.text.__getitem__, words))
                if found:
                    yield str(self.special[found.group()]), found.group()
                    done = found.end()

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, and the hashes of the ids and of the decoded text."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        for ids, tokens in self.encoded(text):
            if n:
                ids_hash.update(b" ")
                text_hash.update(b" ")
            n += ids.count(" ") + 1
            ids_hash.update(ids.encode())
            text_hash.update(tokens.encode("utf-8"))
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.encoded(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder of its own the tokenizer joins tokens by one space; ids that it does not know are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One per worker process, so that its caches outlive a task."""
    return Codec(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Columns doc_id, ids (array of int), decoded; one row per input row."""
    path = path or default_tokenizer()

    def run(batches):  # type: ignore[no-untyped-def]
        own = codec(path)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = own.encode(text.as_py() or "")
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([doc_id.as_py()], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int32())), "decoded": pa.array([own.decode(ids)], pa.string())}
                )

    return doc_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Columns doc_id, n_tokens, ids_sha256, decoded_sha256; one row per input row."""
    path = path or default_tokenizer()

    def run(batches):  # type: ignore[no-untyped-def]
        own = codec(path)
        for batch in batches:
            found = [own.digests(text.as_py() or "") for text in batch["text"]]
            n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return doc_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
