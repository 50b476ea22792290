"""License scan by conditional compression.

A template that occurs in a block makes the block nearly free to compress when the template is the
compressor's dictionary. Candidate blocks are the words around words that license texts use, and
pieces of them that overlap by more than a template; each piece is compressed plainly and with every
template as a zstandard raw dictionary, by the same parameters. Templates are ranked by the share of their
own cost that they save; only the winners, those that save at least an eighth (SAVED), are confirmed, by exact
wording differences: the piece's and the template's words are aligned, and the match stands if at most a tenth of
the template's words are missing or have words put between them, and none of its names, numbers and
versions is missing. Templates that claim one place are ranked by the bytes they save there.

A notice that stands near others of the same phrases saves little, as the plain piece has these phrases too.
Pieces are therefore short (PIECE words and one template): recall against the alignment of
every template at every place is tested per template and block length.

The shared head of the BSD licenses counts as BSD-2-Clause, unless the clause on endorsement, which only the longer one has,
stands within BSD_REACH words after it.

Defined results: NULL and empty texts, and texts without a candidate block, have an empty list. Texts
are scanned whole. A license is reported once per place. Rows keep their ids, also NULL or repeated
ones; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.llm.common import doc_text

# Customary notices of public licenses, by SPDX identifier.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Licensed under the terms of the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((name, f"SPDX-License-Identifier: {name}") for name in (
        "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only",
        "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT",
        "MPL-2.0", "Unlicense",
    )),
)
# The head that both BSD licenses share, and the clause that tells them apart.
BSD_HEAD = next(i for i, (_, text) in enumerate(TEMPLATES) if text.startswith("Redistribution and use"))
BSD_CLAUSE = next(i for i, (_, text) in enumerate(TEMPLATES) if text.startswith("nor the names"))
BSD_REACH = 160

ANCHOR = re.compile(r"licen[sc]|copyright|permission|permitted|redistribut|public domain|creative commons|gnu general", re.IGNORECASE)
ANCHOR_PARTS = ("licens", "licenc", "copyright", "permission", "permitted", "redistribut", "public domain", "creative commons", "gnu general")
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
TOLERANCE = 10
SAVED = 8
LEVEL = 3
# A piece owns the places that begin in PIECE words; it has the words that these can reach besides.
PIECE = 40
# For compression only: no template's word is longer, and a piece stays below the window.
WORD_CHARS = 32
WINDOW_LOG = 15

_MATCHES = "array<struct<license:string,template:int,start:int,end:int,saved_bytes:int,missing_words:int,extra_words:int>>"


def _plain(words: list[str]) -> bytes:
    return " ".join([w[:WORD_CHARS] for w in words]).encode("utf-8", "surrogatepass")


class _Template:
    def __init__(self, license_id: str, text: str):
        self.license_id = license_id
        spelled = WORD.findall(text)
        self.words = [w.lower() for w in spelled]
        # Words with a digit, and capitalised ones after the first, carry names and versions.
        self.names = {i for i, w in enumerate(spelled) if any(c.isdigit() for c in w) or (i and w[0].isupper())}
        content = _plain(self.words)
        # The block is packed with a space on both sides, so that its words meet the template's as they stand there.
        self.packer = _packer(zstandard.ZstdCompressionDict(b" " + content + b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.cost = len(_packer(None).compress(content)) - len(_packer(None).compress(b""))


def _packer(dictionary: zstandard.ZstdCompressionDict | None) -> zstandard.ZstdCompressor:
    # Sizes are given, as else the library takes other parameters with a small dictionary than without one.
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=1 << WINDOW_LOG, window_log=WINDOW_LOG, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters) if dictionary else zstandard.ZstdCompressor(compression_params=parameters)


@lru_cache(maxsize=2)
def _templates(table: tuple[tuple[str, str], ...]) -> tuple[list[_Template], zstandard.ZstdCompressor, int]:
    built = [_Template(*row) for row in table]
    return built, _packer(None), max(len(t.words) for t in built)


def candidate_blocks(text: str, reach: int) -> list[tuple[int, list[str]]]:
    """(first word number, words) of the merged surroundings of anchors; ``reach`` words on both sides."""
    low = text.lower()
    if not any(part in low for part in ANCHOR_PARTS):
        return []
    places = [m.start() for m in ANCHOR.finditer(text)]
    spans = [m.span() for m in WORD.finditer(text)]
    blocks: list[list[int]] = []
    at = 0
    for place in places:
        while at + 1 < len(spans) and spans[at + 1][0] <= place:
            at += 1
        first, end = max(0, at - reach), min(len(spans), at + reach + 1)
        if blocks and first <= blocks[-1][1]:
            blocks[-1][1] = end
        else:
            blocks.append([first, end])
    return [(first, [low[a:b] if len(low) == len(text) else text[a:b].lower() for a, b in spans[first:end]]) for first, end in blocks]


def pieces(words: list[str], reach: int) -> list[tuple[int, int]]:
    """(first, end) of a block's pieces; a place of up to ``reach`` words lies whole in one of them."""
    return [(a, min(len(words), a + PIECE + reach)) for a in range(0, max(1, len(words) - reach), PIECE)]


def winners(templates: list[_Template], plain: zstandard.ZstdCompressor, words: list[str]) -> list[tuple[int, int]]:
    """(template, saved bytes) of those that save enough of a piece, by the share of their own cost that they save."""
    packed = b" " + _plain(words) + b" "
    size = len(plain.compress(packed))
    saved = [size - len(template.packer.compress(packed)) for template in templates]
    ranked = sorted(range(len(templates)), key=lambda i: (-saved[i] / templates[i].cost, i))
    return [(i, saved[i]) for i in ranked if SAVED * saved[i] >= templates[i].cost]


def wording(template: _Template, words: list[str]) -> list[tuple[int, int, int, int]]:
    """(first, end, missing, extra) of each confirmed place of the template in the block."""
    found, begin = [], 0
    size, allowed = len(template.words), len(template.words) * TOLERANCE // 100
    while True:
        # Places start where one of the template's first words does, as at most ``allowed`` may be missing.
        heads = set(template.words[: allowed + 1])
        start = next((i for i in range(begin, len(words)) if words[i] in heads), None)
        if start is None:
            return found
        part = words[start : start + size + allowed]
        runs = SequenceMatcher(None, template.words, part, autojunk=False).get_matching_blocks()[:-1]
        matched = {i for run in runs for i in range(run.a, run.a + run.size)}
        end = max((run.b + run.size for run in runs), default=0)
        missing, extra = size - len(matched), end - len(matched)
        if missing + extra <= allowed and template.names <= matched:
            found.append((start, start + end, missing, extra))
            begin = start + end
        else:
            begin = start + 1


def scan(text: str | None, table: tuple[tuple[str, str], ...] = TEMPLATES) -> list[dict]:
    """Confirmed licenses of one text in order of place; of several templates for one place the one that saves most."""
    templates, plain, longest = _templates(table)
    reach = longest + longest * TOLERANCE // 100
    out: list[dict] = []
    for first, block in candidate_blocks(text or "", reach):
        found: dict[tuple[int, int, int], tuple] = {}
        for begin, stop in pieces(block, reach):
            words = block[begin:stop]
            for i, saved in winners(templates, plain, words):
                for start, end, missing, extra in wording(templates[i], words):
                    key = (i, begin + start, begin + end)
                    if key not in found or found[key][1] < saved:
                        place = b" " + _plain(words[start:end]) + b" "
                        here = len(plain.compress(place)) - len(templates[i].packer.compress(place))
                        found[key] = (here, saved, missing, extra)
        taken: set[int] = set()
        order = sorted(found.items(), key=lambda x: (-x[1][0], x[1][2] + x[1][3], x[0]))
        for (i, start, end), (_, saved, missing, extra) in order:
            if taken.isdisjoint(range(start, end)):
                taken.update(range(start, end))
                out.append(
                    {
                        "license": templates[i].license_id, "template": i, "start": first + start, "end": first + end,
                        "saved_bytes": saved, "missing_words": missing, "extra_words": extra,
                    }
                )
    out.sort(key=lambda m: m["start"])
    return _bsd_by_clause(out) if table is TEMPLATES else out


def _bsd_by_clause(matches: list[dict]) -> list[dict]:
    """A BSD head before the endorsement clause is one of the longer license."""
    for match, after in zip(matches, matches[1:], strict=False):
        if match["template"] == BSD_HEAD and after["template"] == BSD_CLAUSE and after["start"] - match["end"] <= BSD_REACH:
            match["license"] = "BSD-3-Clause"
    return matches


def scan_licenses(docs: DataFrame, table: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, licenses (sorted distinct identifiers) and matches (with word places) of every row."""
    fields = [("license", pa.string()), *((k, pa.int32()) for k in ("template", "start", "end", "saved_bytes", "missing_words", "extra_words"))]

    def scanned(batches):  # type: ignore[no-untyped-def]
        for batch in batches:
            matches = [scan(text, table) for text in batch["text"].to_pylist()]
            licenses = [sorted({m["license"] for m in row}) for row in matches]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(licenses, pa.list_(pa.string())), pa.array(matches, pa.list_(pa.struct(fields)))],
                ["doc_id", "licenses", "matches"],
            )

    return doc_text(docs).mapInArrow(scanned, f"doc_id long, licenses array<string>, matches {_MATCHES}").withColumn(
        "n_matches", F.size("matches")
    )
