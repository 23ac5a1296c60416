"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates are cut into words (runs of letters and digits, lower case); every ``K`` neighbouring words
are hashed, and winnowing keeps the smallest hash of each ``W`` neighbouring ones. The kept fingerprints
form an inverted index: hash to (template, position). A document is probed with all its K-word hashes, so a
passage that shares W + K - 1 words in a row with a template always hits. Hits of one template
on neighbouring diagonals are one candidate; it is aligned with the template in a band around
its diagonals (local alignment by words), and reported if the matched words cover at least ``COVERAGE``
of the template. The index is as large as the templates, which are a parameter; documents are
scanned where they are and nothing is shuffled.

Defined results: null and empty texts have no rows; a template that occurs several times in a text is
reported each time, with its span in words and in characters; a template of fewer than K words is
indexed by all its words; repeated rows are reported each; null doc_ids are kept; an empty table
gives no rows; other columns are not looked at.
"""
from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

K, W, BAND, COVERAGE = 3, 2, 8, 0.7
MATCH, MISS, GAP = 2, -1, -1

# Public license statements and notices.
TEMPLATES = {
    "MIT-statement": "Released under the MIT License.",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
           "following conditions: The above copyright notice and this permission notice shall be included in all "
           "copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                         "in compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                         "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                         "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                         "language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                      "General Public License as published by the Free Software Foundation, either version 3 of the "
                      "License, or (at your option) any later version. This program is distributed in the hope that it will "
                      "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
                      "FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                    "that the following conditions are met: Redistributions of source code must retain the above copyright "
                    "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
                    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                    "documentation and/or other materials provided with the distribution.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                      "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
_WORD = re.compile(r"[^\W_]+")


def template_words(text: str) -> list[str]:
    return [m[0].lower() for m in _WORD.finditer(text)]


def _hash(gram: tuple[int, ...]) -> int:
    return zlib.crc32(repr(gram).encode())


def winnow(hashes: list[int], w: int = W) -> list[int]:
    """Positions of the smallest hash (the last such) of each w neighbouring ones; all if fewer."""
    if len(hashes) <= w:
        return list(range(len(hashes)))
    return sorted({min(range(i, i + w), key=lambda p: (hashes[p], -p)) for i in range(len(hashes) - w + 1)})


class Index:
    """The templates as word numbers, and their winnowed fingerprints by hash."""

    def __init__(self, templates: dict[str, str], k: int = K, w: int = W):
        self.names, self.vocabulary, self.k = list(templates), {}, k
        self.words = [[self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in template_words(t)] for t in templates.values()]
        self.by_hash: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            size = min(k, len(words))
            grams = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)] if words else []
            for p in winnow([_hash(g) for g in grams], w):
                self.by_hash.setdefault(grams[p], []).append((t, p))
        self.sizes = sorted({len(g) for g in self.by_hash})

    def hits(self, ids: list[int]) -> dict[int, list[tuple[int, int]]]:
        """template to (place in the document, place in the template) of every shared fingerprint."""
        out: dict[int, list[tuple[int, int]]] = {}
        known = [i for i, x in enumerate(ids) if x]  # words that no template has cannot be in a hit
        for i in known:
            for size in self.sizes:
                for t, p in self.by_hash.get(tuple(ids[i:i + size]), ()):
                    out.setdefault(t, []).append((i, p))
        return out


def candidates(hits: list[tuple[int, int]], band: int = BAND) -> list[tuple[int, int]]:
    """(smallest, largest) diagonal (document place - template place) of groups of hits whose
    neighbours differ by ``band`` at most."""
    out: list[list[int]] = []
    for d in sorted({i - p for i, p in hits}):
        if out and d - out[-1][1] <= band:
            out[-1][1] = d
        else:
            out.append([d, d])
    return [tuple(x) for x in out]


def align(doc: list[int], template: list[int], low: int, high: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first and past-the-last document word) of the best local alignment within
    ``band`` of the diagonals low..high. Ties go to more matches, then to the earlier end."""
    before: dict[int, tuple] = {}
    best = (0, 0, 0, 0, 0)  # score, matches, -end, start, end
    for p in range(len(template)):
        row: dict[int, tuple] = {}
        for i in range(max(0, low + p - band), min(len(doc), high + p + band + 1)):
            score, matched, start = before.get(i - 1, (0, 0, i)) if before.get(i - 1, (0,))[0] > 0 else (0, 0, i)
            same = doc[i] == template[p]
            cell = (score + (MATCH if same else MISS), matched + same, start)
            for other in (before.get(i), row.get(i - 1)):
                if other and other[0] + GAP > cell[0]:
                    cell = (other[0] + GAP, other[1], other[2])
            if cell[0] > 0:
                row[i] = cell
                if same:
                    best = max(best, (cell[0], cell[1], -(i + 1), cell[2], i + 1))
        before = row
    return best[1], best[3], best[4]


def find(text: str, index: Index, band: int = BAND, coverage: float = COVERAGE) -> list[tuple]:
    """(license, start_word, end_word, start, end, matched, template_words, coverage) in a text."""
    spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    ids = [index.vocabulary.get(text[a:b].lower(), 0) for a, b in spans]
    out = set()
    for t, hits in index.hits(ids).items():
        size = len(index.words[t])
        # narrower than the template, so that a neighbouring copy is out of it; wide enough for words put in at several places
        reach = max(min(band, max(1, size // 2)), size // 3)
        for low, high in candidates(hits, band):
            by_diagonal: dict[int, list[int]] = {}
            for i, p in hits:
                if low <= i - p <= high:
                    by_diagonal.setdefault(i - p, []).append(i)
            told: list[tuple[int, int]] = []
            for d, places in sorted(by_diagonal.items(), key=lambda x: (-len(x[1]), x[0])):  # copies may follow each other closely
                if all(any(a <= i < b for a, b in told) for i in places):
                    continue  # hits of a passage that is found
                first = max(0, d - reach)
                part = ids[first:max(0, d + size + reach)]
                matched, a, b = align(part, index.words[t], d - first, d - first, reach)
                if matched >= coverage * size:
                    told.append((first + a, first + b))
                    out.add((index.names[t], first + a, first + b, spans[first + a][0], spans[first + b - 1][1], matched, size, matched / size))
    return _separate(sorted(out, key=lambda r: (r[0], -r[5], r[1], r[2])))


def _separate(rows: list[tuple]) -> list[tuple]:
    """Of spans of one license that overlap, the one with most matched words (the earliest such)."""
    kept: dict[str, list[tuple[int, int]]] = {}
    out = []
    for r in rows:
        spans = kept.setdefault(r[0], [])
        at = bisect_right(spans, (r[1], r[2]))
        if (at and spans[at - 1][1] > r[1]) or (at < len(spans) and spans[at][0] < r[2]):
            continue
        spans.insert(at, (r[1], r[2]))
        out.append(r)
    return sorted(out, key=lambda r: (r[1], r[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, band: int = BAND, coverage: float = COVERAGE) -> DataFrame:
    """One row for each license passage found in ``docs``."""
    index = Index(TEMPLATES if templates is None else templates)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "license", "start_word", "end_word", "start", "end", "matched", "template_words", "coverage"]
    types = [pa.string(), *[pa.int64()] * 6, pa.float64()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [(r, row) for r, text in enumerate(part["text"].to_pylist()) if text for row in find(text, index, band, coverage)]
                if found:
                    columns = [pa.array([row[c] for _, row in found], t) for c, t in enumerate(types)]
                    yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array([r for r, _ in found])), *columns], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, start_word long, end_word long, start long, end long, matched long, template_words long, coverage double")
