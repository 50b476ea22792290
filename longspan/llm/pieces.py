"""Byte-level BPE by pre-tokens: split a text as the tokenizer does, and encode each distinct piece once.

Texts of common Latin characters and punctuation are split here by an expression that equals the
tokenizer's own on those characters (tests compare both over every one of them). All other texts,
and texts that hold the string of a special token, go whole through the tokenizers library.
A new piece is merged by tiktoken's BPE over the ranks of the same vocabulary file, whose order
is the merge order, so its ids are those of the tokenizers library at a seventh of the time per piece.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

PIECE = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Outside of these the classes of the two expression engines may differ (other digits, controls, newer letters).
UNUSUAL = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧₠-₵]")
CACHE = 1_000_000
#: Ids take several times the room of a count.
IDS_CACHE = 250_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces(dict):
    """piece -> value(ids), computed once per worker; at most ``size`` pieces are kept."""

    def __init__(self, encoder: Encoder, value: Callable, size: int):
        super().__init__()
        self.encoder, self.value, self.size = encoder, value, size

    def __missing__(self, piece: str):  # type: ignore[no-untyped-def]
        if len(self) >= self.size:
            self.clear()
        out = self[piece] = self.value(self.encoder.merge(piece.encode("utf-8")))
        return out


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or not spec["pre_tokenizer"]["use_regex"]:
            raise ValueError(f"{path} is no byte-level BPE without normalisation")
        self.special = [x["content"] for x in spec["added_tokens"]]
        unmap = {chr(c): b for b, c in zip(*_byte_letters(), strict=True)}
        ranks = {
            bytes(unmap[c] for c in token): rank
            for token, rank in spec["model"]["vocab"].items()
            if token not in self.special
        }
        self.merge = tiktoken.Encoding("pieces", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.counts = Pieces(self, len, CACHE)
        self.ids = Pieces(self, lambda ids: np.array(ids, "<u4").tobytes(), IDS_CACHE)

    def plain(self, text: str) -> bool:
        return UNUSUAL.search(text) is None and not any(s in text for s in self.special)

    def library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def ids_of(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.plain(text):
            return b"".join(map(self.ids.__getitem__, PIECE.findall(text)))
        return np.array(self.library_ids(text), "<u4").tobytes()


def _byte_letters() -> tuple[list[int], list[int]]:
    """Byte-level BPE writes printable bytes as they are and the others, in order, from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return shown + hidden, shown + list(range(256, 256 + len(hidden)))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process, so that its caches outlive a task."""
    return Encoder(path)
