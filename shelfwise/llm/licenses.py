"""License scans by patience alignment.

A text and a template are aligned on the words that occur once in both: the longest chain of them that stands in the same
order in both is kept, and the gaps between its links are aligned in the same way. The share of the template's words that
are aligned is its coverage. Only places that hold enough of a template's words to reach the wanted coverage are aligned;
that is a necessary condition, so nothing is lost by it. Words between asterisks in a template (name, version, variant) must
all be aligned, to consecutive words of the text: they tell a license from its neighbours.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.textbytes import LOWER, SpanHasher, Texts, chunks, words_of

COVERAGE = 0.8
#: Words that a passage may hold besides, in shares of its template's words: what lies wider apart is no passage.
MOST_INSERTED = 1.0
#: Cells up to which a gap without a common unique word is aligned by one table; larger ones are halved first.
TABLE_CELLS = 4096

# Notices, grants, names and whole texts of common licenses, by name and class.
TEMPLATES: dict[tuple[str, str], list[str]] = {
    ("MIT", "permissive"): [
        "Released under the *MIT* License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    ("Apache-2.0", "permissive"): [
        "Licensed under the *Apache License, Version 2.0* (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    ("BSD", "permissive"): [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ],
    ("ISC", "permissive"): [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    ("Zlib", "permissive"): [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions",
    ],
    ("Unlicense", "permissive"): ["This is free and unencumbered software released into the public domain."],
    ("BSL-1.0", "permissive"): ["Distributed under the *Boost Software License, Version 1.0*."],
    ("CC0-1.0", "permissive"): [
        "To the extent possible under law, the author has *waived all copyright* and related or neighboring rights to this work.",
    ],
    ("GPL-3.0", "copyleft"): ["This work is licensed under the *GNU General Public License, version 3*."],
    ("MPL-2.0", "copyleft"): [
        "This Source Code Form is subject to the terms of the *Mozilla Public License, v. 2.0*. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    ("EPL-2.0", "copyleft"): [
        "This program and the accompanying materials are made available under the terms of the *Eclipse Public License 2.0* "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    ("Reserved", "reserved"): ["All rights reserved."],
}
#: Names by which a text is put under a license.
_NAMES = {
    ("MIT", "permissive"): ["MIT License", "MIT"],
    ("Apache-2.0", "permissive"): ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"],
    ("BSD", "permissive"): ["BSD License"],
    ("BSD-2-Clause", "permissive"): ["BSD 2-Clause", "2-Clause BSD"],
    ("BSD-3-Clause", "permissive"): ["BSD 3-Clause", "3-Clause BSD"],
    ("ISC", "permissive"): ["ISC License"],
    ("CC0-1.0", "permissive"): ["CC0 1.0", "Creative Commons Zero 1.0"],
    ("Zlib", "permissive"): ["zlib License"],
    ("Unlicense", "permissive"): ["Unlicense"],
    ("BSL-1.0", "permissive"): ["Boost Software License 1.0"],
    ("Artistic-1.0", "permissive"): ["Artistic License 1.0"],
    ("Artistic-2.0", "permissive"): ["Artistic License 2.0"],
    ("MPL-1.1", "copyleft"): ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"],
    ("MPL-2.0", "copyleft"): ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    ("EPL-1.0", "copyleft"): ["Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "EPL 1.0"],
    ("EPL-2.0", "copyleft"): ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "EPL 2.0"],
}
_GNU = {
    "GPL": ("General Public", ["1", "2", "3"]),
    "LGPL": ("Lesser General Public", ["2.1", "3"]),
    "AGPL": ("Affero General Public", ["3"]),
    "GFDL": ("Free Documentation", ["1.1", "1.2", "1.3"]),
}
_CREATIVE = {"": "", "-SA": "-ShareAlike", "-ND": "-NoDerivatives", "-NC": "-NonCommercial", "-NC-SA": "-NonCommercial-ShareAlike",
             "-NC-ND": "-NonCommercial-NoDerivatives"}
#: Files of whole texts, the words that must be aligned in them, and their licenses.
_WHOLE = {
    "MIT": ("THE SOFTWARE IS PROVIDED", "MIT", "permissive"),
    "Apache-2.0": ("Version 2.0, January 2004", "Apache-2.0", "permissive"),
    "BSD": ("Neither the name", "BSD-3-Clause", "permissive"),
    "Artistic": ("Artistic License", "Artistic-1.0", "permissive"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0-1.0", "permissive"),
    "MPL-1.1": ("Version 1.1", "MPL-1.1", "copyleft"),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "MPL-2.0", "copyleft"),
    "GPL-1": ("Version 1, February 1989", "GPL-1.0", "copyleft"),
    "GPL-2": ("GENERAL PUBLIC LICENSE\n                       Version 2, June 1991", "GPL-2.0", "copyleft"),
    "GPL-3": ("GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "GPL-3.0", "copyleft"),
    "LGPL-2": ("GNU LIBRARY GENERAL PUBLIC LICENSE\n                       Version 2, June 1991", "LGPL-2.0", "copyleft"),
    "LGPL-2.1": ("Version 2.1, February 1999", "LGPL-2.1", "copyleft"),
    "LGPL-3": ("GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "LGPL-3.0", "copyleft"),
    "GFDL-1.2": ("Version 1.2, November 2002", "GFDL-1.2", "copyleft"),
    "GFDL-1.3": ("Version 1.3, 3 November 2008", "GFDL-1.3", "copyleft"),
}


def _versioned(name: str, version: str) -> str:
    return f"{name}-{version}" if "." in version else f"{name}-{version}.0"


def _complete() -> None:
    """Adds to the templates what follows from the tables above."""

    def add(name: str, kind: str, text: str) -> None:
        TEMPLATES.setdefault((name, kind), []).append(text)

    for (name, kind), names in _NAMES.items():
        for one in names:
            add(name, kind, f"Licensed under the *{one}*.")
    for short, (long, versions) in _GNU.items():
        for version in versions:
            name, full = _versioned(short, version), f"GNU {long} License"
            for one in (f"{full}, version {version}", f"{full} v{version}", name.replace("-", " "), f"{short}v{version}"):
                add(name, "copyleft", f"Licensed under the *{one}*.")
            if short == "GFDL":
                add(name, "copyleft",
                    "Permission is granted to copy, distribute and/or modify this document under the terms of the "
                    f"*{full}, Version {version}* or any later version published by the Free Software Foundation")  # fmt: skip
                continue
            add(name, "copyleft",
                "This program is free software: you can redistribute it and/or modify it under the terms of the "
                f"*{full}* as published by the Free Software Foundation, either *version {version}* of the License, or (at your "
                "option) any later version.")  # fmt: skip
    library = "GNU Library General Public License"
    add("LGPL-2.0", "copyleft", f"Licensed under the *{library}, version 2*.")
    add("LGPL-2.0", "copyleft",
        f"This library is free software; you can redistribute it and/or modify it under the terms of the *{library}* as published "
        "by the Free Software Foundation; either *version 2* of the License, or (at your option) any later version.")  # fmt: skip
    for short, long in _CREATIVE.items():
        kind = "noncommercial" if "NC" in short else {"-SA": "copyleft", "-ND": "noderivatives"}.get(short, "permissive")
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            name = f"CC-BY{short}-{version}"
            port = {"4.0": "International", "3.0": "Unported"}.get(version, "Generic")
            add(name, kind, f"Licensed under *CC BY{short} {version}*.")
            add(name, kind, f"This work is licensed under a *Creative Commons Attribution{long} {version}* {port} License.")
            if "ND" in short:
                older = long.replace("Derivatives", "Derivs")
                add(name, kind, f"This work is licensed under a *Creative Commons Attribution{older} {version}* {port} License.")
    for file, (mark, name, kind) in _WHOLE.items():
        text = (Path(__file__).parent / "license_texts" / f"{file}.txt").read_text().replace("*", " ")
        if mark not in text:
            raise ValueError(f"{file}: {mark!r} is missing")
        add(name, kind, text.replace(mark, f"*{mark}*", 1))
        if file == "BSD":
            start, end = text.index("3. Neither"), text.index("THIS SOFTWARE")
            add("BSD-2-Clause", "permissive", text[:start] + text[end:])
    for name, kind in list(TEMPLATES):
        if name not in ("BSD", "Reserved"):
            add(name, kind, f"SPDX-License-Identifier: *{name}*")


_complete()

_letter = np.zeros(256, bool)
for _range in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _letter[slice(*_range)] = True

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Template:
    name: str
    kind: str
    words: tuple[int, ...]
    #: Places (first, end) of the words that must be aligned to consecutive words.
    required: tuple[tuple[int, int], ...] = ()


def word_ids(text: str) -> list[int]:
    """Hashes of the words of a text: letters, digits and all beyond ASCII, A-Z lower-cased."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    words = words_of(Texts(data, np.array([0, len(data)]), 0), _letter)
    return SpanHasher(data)(words.starts, words.ends).tolist()


def templates(texts: dict[tuple[str, str], list[str]] = TEMPLATES) -> list[Template]:
    return [_template(name, kind, t) for (name, kind), all_ in texts.items() for t in all_]


def _template(name: str, kind: str, text: str) -> Template:
    words: list[int] = []
    required = []
    for k, part in enumerate(text.split("*")):
        begin = len(words)
        words += word_ids(part)
        if k % 2:
            required.append((begin, len(words)))
    return Template(name, kind, tuple(words), tuple(required))


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises in both places; the pairs come in order of the first."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[pile], piles[pile] = j, k
    chain, k = [], piles[-1] if piles else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def _by_table(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Aligned places of a longest common subsequence, from the table of all lengths."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    found, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def _common_lengths(a: tuple, b: tuple) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and every beginning of ``b``, one row of the table at a time."""
    row, words = np.zeros(len(b) + 1, np.int64), np.array(b, np.uint64)
    for word in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (words == np.uint64(word))))
    return row


def _common_subsequence(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Aligned places of a longest common subsequence of two sequences of any length, in memory of one row.

    The first sequence is halved; where the second is best cut, the lengths of both halves' subsequences tell. Parts that are small
    enough are aligned by a table.
    """
    found: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        i, i_end, j, j_end = open_.pop()
        if i_end - i <= 1 or (i_end - i) * (j_end - j) <= TABLE_CELLS:
            found += [(i + p, j + q) for p, q in _by_table(a[i:i_end], b[j:j_end])]
            continue
        half = (i + i_end) // 2
        begin = _common_lengths(a[i:half], b[j:j_end])
        end = _common_lengths(a[half:i_end][::-1], b[j:j_end][::-1])[::-1]
        cut = j + int(np.argmax(begin + end))
        open_ += [(i, half, j, cut), (half, i_end, cut, j_end)]
    return sorted(found)


def patience(a: tuple[int, ...], b: tuple[int, ...]) -> list[tuple[int, int]]:
    """Aligned places (in ``a``, in ``b``) of two word sequences, rising in both."""
    found: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        i, i_end, j, j_end = open_.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            found.append((i_end, j_end))
        if i >= i_end or j >= j_end:
            continue
        times_a, times_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {w: k for k, w in enumerate(b[j:j_end], j) if times_b[w] == 1}
        anchors = _longest_rising([(k, place[w]) for k, w in enumerate(a[i:i_end], i) if times_a[w] == 1 and w in place])
        if anchors:
            found += anchors
            edges = [(i - 1, j - 1), *anchors, (i_end, j_end)]
            open_ += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges[:-1], edges[1:])]
        else:
            found += [(i + p, j + q) for p, q in _common_subsequence(a[i:i_end], b[j:j_end])]
    return sorted(found)


def _occurrences(words: np.ndarray, row: tuple[int, ...]) -> np.ndarray:
    """Places at which the words of ``row`` stand in a row."""
    at = np.flatnonzero(words == np.uint64(row[0]))
    at = at[at + len(row) <= len(words)]
    for k, w in enumerate(row[1:], 1):
        at = at[words[at + k] == np.uint64(w)]
    return at


def _aligned(template: Template, window: tuple[int, ...], rows: list[np.ndarray]) -> list[tuple[int, int]]:
    """Patience alignment through the first places of the required words; empty if they do not stand in order."""
    found: list[tuple[int, int]] = []
    i = j = 0
    for (first, end), row in zip(template.required, rows):
        k = int(np.searchsorted(row, j))
        if k == len(row) or row[k] + (end - first) > len(window):
            return []
        at = int(row[k])
        found += [(i + p, j + q) for p, q in patience(template.words[i:first], window[j:at])]
        found += [(first + n, at + n) for n in range(end - first)]
        i, j = end, at + (end - first)
    return found + [(i + p, j + q) for p, q in patience(template.words[i:], window[j:])]


def _densest(aligned: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """The most aligned places that lie within ``width`` words of the text; of equally many the closest together."""
    best, begin = (0, 0), 0
    for end in range(1, len(aligned) + 1):
        while aligned[end - 1][1] - aligned[begin][1] >= width:
            begin += 1
        more, now = end - begin, best[1] - best[0]
        span = lambda i, j: aligned[j - 1][1] - aligned[i][1]
        if more > now or (more == now and span(begin, end) < span(*best)):
            best = (begin, end)
    return aligned[best[0] : best[1]]


def _holds_required(template: Template, aligned: list[tuple[int, int]]) -> bool:
    places = dict(aligned)
    return all(
        first in places and all(places.get(first + n) == places[first] + n for n in range(end - first))
        for first, end in template.required
    )


def matches(words: np.ndarray, template: Template, least: float = COVERAGE) -> list[tuple[int, int, float]]:
    """Places (first word, end, coverage) where a text covers at least that share of the template, from left to right.

    A place is a window that begins with one of the template's words and holds ``MOST_INSERTED`` times as many others as
    the template has words; a window with too few of its words to reach the share, or without its required words in a row, is
    passed over. Where the share is reached but not the whole template, a window of twice the width is aligned: a stray
    word ahead of the passage may have cut its end off. After a match the search goes on behind it.
    """
    size = len(template.words)
    rows = [_occurrences(words, template.words[i:j]) for i, j in template.required]
    if any(not len(r) for r in rows):
        return []
    needed = int(np.ceil(least * size - 1e-9))
    width = size + max(2, int(MOST_INSERTED * size))
    member = np.isin(words, np.array(template.words, np.uint64))
    sums = np.concatenate([[0], np.cumsum(member)])
    begins = np.flatnonzero(member)
    begins = begins[sums[np.minimum(begins + width, len(words))] - sums[begins] >= needed]
    for (i, j), r in zip(template.required, rows):
        at = np.searchsorted(r, begins)
        begins = begins[(at < len(r)) & (r[np.minimum(at, len(r) - 1)] + (j - i) <= begins + width)]
    found, free = [], 0
    for begin in begins.tolist():
        if begin < free:
            continue
        window = lambda n: tuple(words[begin : begin + n].tolist())  # noqa: B023, E731
        places = [r - begin for r in rows]
        aligned = _aligned(template, window(width), places)
        if len(aligned) < needed or not aligned:
            continue
        if len(aligned) < size:
            wider = _densest(_aligned(template, window(2 * width), places), width)
            if len(wider) > len(aligned) and _holds_required(template, wider):
                aligned = wider
        found.append((begin + aligned[0][1], begin + aligned[-1][1] + 1, len(aligned) / size))
        free = found[-1][1]
    return found


def distinct_passages(found: list[tuple[int, int, float, Template]]) -> list[dict]:
    """Passages that do not overlap: where templates claim the same words, the one with most aligned words has them."""
    kept: list[tuple[int, int, float, Template]] = []
    for one in sorted(found, key=lambda f: (-f[2] * len(f[3].words), -f[2], f[0], f[3].name)):
        if all(one[1] <= a or b <= one[0] for a, b, _, _ in kept):
            kept.append(one)
    return [
        {"license": t.name, "class": t.kind, "first": a, "end": b, "coverage": c, "words": len(t.words)}
        for a, b, c, t in sorted(kept, key=lambda f: f[0])
    ]


def _scan_batches(all_: list[Template], least: float) -> Callable[[Batches], Batches]:
    """Per text the templates it covers. ``bound`` distinct words are needed of each: if a share ``least`` of its words is
    aligned, at most the rest of its words can be missing."""
    vocabulary = np.unique(np.array([w for t in all_ for w in t.words], np.uint64))
    holds = np.zeros((len(vocabulary), len(all_)), np.int16)
    for k, t in enumerate(all_):
        holds[np.searchsorted(vocabulary, np.array(sorted(set(t.words)), np.uint64)), k] = 1
    missing = [len(t.words) - int(np.ceil(least * len(t.words) - 1e-9)) for t in all_]
    bound = np.array([max(1, len(set(t.words)) - m) for t, m in zip(all_, missing)])
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in chunks(batch.column("text")):
                data = LOWER[part.data]
                words = words_of(Texts(data, part.offsets, part.first_row), _letter)
                hashes = SpanHasher(data)(words.starts, words.ends)
                at = np.flatnonzero(maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
                place = np.minimum(np.searchsorted(vocabulary, hashes[at]), len(vocabulary) - 1)
                at, place = at[vocabulary[place] == hashes[at]], place[vocabulary[place] == hashes[at]]
                pairs = np.unique(words.text_of()[at] * len(vocabulary) + place)
                texts, which = np.divmod(pairs, len(vocabulary))
                begins = np.searchsorted(texts, np.arange(len(part) + 1))
                enough = np.zeros((len(part), len(all_)), bool)
                for i in np.flatnonzero(begins[1:] - begins[:-1] >= bound.min()):
                    enough[i] = holds[which[begins[i] : begins[i + 1]]].sum(axis=0, dtype=np.int64) >= bound
                found: list[list[tuple[int, int, float, Template]]] = [[] for _ in range(len(part))]
                for i, k in zip(*np.nonzero(enough)):
                    own = hashes[words.bounds[i] : words.bounds[i + 1]]
                    t = all_[k]
                    found[i] += [(a, b, c, t) for a, b, c in matches(own, t, least)]
                rows = slice(part.first_row, part.first_row + len(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[rows], pa.array([distinct_passages(f) for f in found], _FOUND)], ["doc_id", "found"]
                )

    return run


_FOUND = pa.list_(
    pa.struct(
        [("license", pa.string()), ("class", pa.string()), ("first", pa.int64()), ("end", pa.int64()),
         ("coverage", pa.float64()), ("words", pa.int64())]
    )
)
_FOUND_SQL = "array<struct<license:string,class:string,first:bigint,end:bigint,coverage:double,words:bigint>>"


def license_scan(docs: DataFrame, all_: list[Template] | None = None, least: float = COVERAGE) -> DataFrame:
    """License passages in every row of ``docs``: ``doc_id, found, licenses, n_passages, best_coverage, restricted``.

    ``found`` lists the passages that cover a template (words of the text from ``first`` to before ``end``), none overlapping
    another. ``licenses`` are their names, sorted and joined with commas; ``restricted`` marks documents under anything but
    a permissive license. Null and empty texts have none; repeated rows get equal rows; no other column is read.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, found {_FOUND_SQL}"
    scanned = docs.select("doc_id", "text").mapInArrow(_scan_batches(all_ or templates(), least), schema)
    names = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"])))
    return scanned.select(
        "doc_id",
        "found",
        F.array_join(names, ",").alias("licenses"),
        F.size("found").cast("bigint").alias("n_passages"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["coverage"])), F.lit(0.0)).alias("best_coverage"),
        F.exists("found", lambda f: f["class"] != "permissive").alias("restricted"),
    )
