"""License scans by conditional compression.

A block of text that speaks of licences is compressed with each template as zstandard raw dictionary. Templates rank by
how much they shrink it beyond its plain compressed size, and the first whose exact wording agrees wins: no word that
tells licences apart may differ, few others may, and what differs is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

#: The wording that identifies each licence, several templates for some.
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NEITHER = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
SPDX = {
    "MIT": "MIT", "ISC": "ISC", "Unlicense": "Unlicense", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause",
    "GPL-2.0": "GPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0": "GPL-3.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0",
    "LGPL-2.1": "LGPL-2.1", "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0": "LGPL-3.0", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0",
    "AGPL-3.0": "AGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0", "MPL-2.0": "MPL-2.0", "EPL-2.0": "EPL-2.0",
    "CC0-1.0": "CC0-1.0", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0",
}
TEMPLATES = (
    ("MIT", "MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format(kind="General", n="3")),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format(kind="General", n="2")),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format(kind="Lesser General", n="3")),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _GNU.format(kind="Lesser General", n="2.1")),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format(kind="Affero General", n="3")),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", _BSD + _NEITHER),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "licensed under the Mozilla Public License, version 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."),
    ("EPL-2.0", "licensed under the Eclipse Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    *((name, f"SPDX-License-Identifier: {key}") for key, name in SPDX.items()),
)
ANCHOR = re.compile(r"licen[cs]e|permission|redistribut|public domain|unencumbered|free software|source code form", re.I)
#: Share of a template's words that a block must hold in order; characters before an anchor.
WORDING, REACH = 0.85, 120
WORD = re.compile(r"[a-z0-9.+-]*[a-z0-9+]", re.I)
BEFORE = re.compile(r"[a-z']+", re.I)


def words(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case and their places."""
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


@lru_cache(maxsize=1)
def _prepared():
    out = []
    for name, text in TEMPLATES:
        d = zstandard.ZstdCompressionDict(text.encode() * 2, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((name, tuple(w for w, _, _ in words(text)), zstandard.ZstdCompressor(level=3, dict_data=d)))
    return zstandard.ZstdCompressor(level=3), out, max(len(t) for _, t in TEMPLATES)


def blocks(text: str) -> list[tuple[int, int]]:
    """Candidate blocks: the surroundings of each anchor, overlapping ones joined up to the longest template's reach."""
    reach, out = _prepared()[2], []
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + reach)
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], b, m.end())
        else:
            out.append((a, b, m.end()))
    return [(a, b) for a, b, _ in out]


#: Words that deny a statement which follows them.
DENIALS = frozenset("not never no isn't aren't wasn't".split())


def differences(template: tuple[str, ...], block: list[str]) -> list[str]:
    """The wording's differences: ``-word`` for each word of the template that is missing, ``+word`` for each that is new."""
    out = []
    for kind, a, b, c, d in SequenceMatcher(None, template, block, autojunk=False).get_opcodes():
        if kind != "equal":
            out += [f"-{w}" for w in template[a:b]] + [f"+{w}" for w in block[c:d]]
    return out


def agreement(template: tuple[str, ...], block: list[str]) -> tuple[float, int, int]:
    """Share of the template's words that a run of the block holds in order, and the run's first and last word.

    Digits, versions and names in capitals of the template must all be there: they tell licences apart.
    """
    best = (0.0, 0, 0)
    first = {template[0], *template[1:2]} - (PLAIN - {template[0]})
    starts = [i for i, w in enumerate(block) if w in first]
    for i in starts:
        part = block[i : i + len(template) + 2]
        same = [x for x in SequenceMatcher(None, template, part, autojunk=False).get_matching_blocks() if x.size]
        held = sum(x.size for x in same)
        last = same[-1].b + same[-1].size if same else 0
        share = 2 * held / (len(template) + max(last, 1))
        if share > best[0]:
            kept = {template[k] for x in same for k in range(x.a, x.a + x.size)}
            if telling(template) <= kept:
                best = (share, i, i + last)
    return best


#: Words without digits that tell licences apart; second words too plain to look for a statement at.
TELLING = frozenset("mit isc apache gnu lesser affero general public bsd redistributions endorse mozilla eclipse unlicense unencumbered cc by by-sa by-nc cc0 attribution attribution-sharealike attribution-noncommercial".split())
PLAIN = frozenset("and is to this".split())


@lru_cache(maxsize=1_000)
def telling(template: tuple[str, ...]) -> set[str]:
    """The words of a template that tell its licence from others: with digits, or of ``TELLING``."""
    return {w for w in template if re.search(r"\d", w) or w in TELLING}


def licences(text: str, wording: float = WORDING) -> list[tuple[str, int, int, str]]:
    """(licence, start, end, differences) of every confirmed licence statement of a text, by start.

    A block's templates are tried by the size that each saves, the first in the table on ties, and the first one whose
    wording is confirmed is the statement's; what stands before and after it is ranked again, so a block may hold
    several. A statement that a word like "not", among the three words before it, denies is none.
    """
    plain, templates, _ = _prepared()
    found, open_ = [], blocks(text)
    while open_:
        a, b = open_.pop()
        block = text[a:b]
        if not ANCHOR.search(block):
            continue
        raw, placed = block.encode("utf-8", "surrogatepass"), words(block)
        size, each = len(plain.compress(raw)), [w for w, _, _ in placed]
        there = set(each)
        for _, i in sorted((len(z.compress(raw)) - size, i) for i, (_, told, z) in enumerate(templates) if telling(told) <= there):
            share, first, last = agreement(templates[i][1], each)
            if share >= wording:
                start, end = a + placed[first][1], a + placed[last - 1][2]
                if not DENIALS & {w.lower() for w in BEFORE.findall(text[max(0, start - 60) : start])[-3:]}:
                    found.append((templates[i][0], start, end, " ".join(differences(templates[i][1], each[first:last]))))
                open_ += [(a, start), (end, b)]
                break
    return read_once(found)


def read_once(found: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Statements by start; of those of one licence that overlap, as two overlapping blocks read them, the longest."""
    kept: list[tuple[str, int, int, str]] = []
    for name, start, end, differs in sorted(set(found), key=lambda x: (x[1] - x[2], x[1], x[0], len(x[3]))):
        if not any(name == n and start < e and s < end for n, s, e, _ in kept):
            kept.append((name, start, end, differs))
    return sorted(kept, key=lambda x: x[1:])


def scan(docs: DataFrame, wording: float = WORDING) -> DataFrame:
    """``(doc_id, licenses, n_statements, n_exact, spans, differences)``, a row for each input row, over whole texts.

    ``licenses`` are the distinct identifiers in order of name, comma-joined; ``spans`` is identifier:start:end by
    start, in code points, end exclusive; ``differences`` has for each span the words that its template lacks (+) or has
    (-), and ``n_exact`` counts the spans without any. A null or empty text has none; repeated rows are read each; other
    columns, whatever their names, are ignored; an empty table gives an empty table.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [licences(t, wording) if isinstance(t, str) else [] for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "licenses": [",".join(sorted({y[0] for y in x})) for x in found], "n_statements": [len(x) for x in found], "n_exact": [sum(not y[3] for y in x) for x in found], "spans": [",".join(f"{n}:{s}:{e}" for n, s, e, _ in x) for x in found], "differences": [[y[3] for y in x] for x in found]})

    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, licenses string, n_statements long, n_exact long, spans string, differences array<string>")
