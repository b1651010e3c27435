"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and texts are runs of lower-cased letters and digits. Hashes of GRAM words in a row are winnowed (the least of
every WINDOW neighbours), so a run of GRAM + WINDOW - 1 shared words always shares a fingerprint. An inverted index over
the templates' fingerprints gives, for each text, templates and the diagonals on which they meet it. Around each
diagonal a banded alignment matches the whole template against the text: matches count for, skipped and replaced words
against it. Every diagonal with a hit that no find of its template covers is aligned, so notices side by side are finds
each. Hits outside these finds are chained over several diagonals and aligned in a band that holds them all. A find
covers at least COVERAGE of the template's words; of finds that overlap the one with the best score stays.

Defined cases: null or empty text has no finds; repeated rows are scanned once each; equal scores go to the occurrence
nearest to the diagonal, then to the first name, then to the first place; very long texts are scanned whole in time that
is linear in their words and hits; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Memo, table

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8
CHUNK = 300_000
_WORD = re.compile(r"[^\W_]+")

# The wording of public licences and of the notices that name them.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "Licensed under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def _hash(word: str) -> int:
    return zlib.crc32(word.encode()) << 32 | zlib.crc32(word.encode(), 77)


def gram_hashes(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(words) - GRAM + 1), np.uint64)
        for k in range(GRAM):
            out = (out ^ words[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Positions of the least hash of every WINDOW neighbours, the last of equals."""
    n = len(grams) - WINDOW + 1
    if n < 1:
        return np.arange(len(grams))
    rows = np.stack([grams[k : k + n] for k in range(WINDOW)][::-1])
    return np.unique(np.arange(n) + WINDOW - 1 - rows.argmin(0))


class Spans:
    """Sorted spans without overlap."""

    def __init__(self) -> None:
        self.first: list[int] = []
        self.last: list[int] = []

    def meets(self, first: int, last: int) -> bool:
        k = bisect_right(self.first, last) - 1
        return k >= 0 and self.last[k] >= first

    def add(self, first: int, last: int) -> None:
        """The span together with those that it meets."""
        k = bisect_right(self.first, last)
        low = k
        while low and self.last[low - 1] >= first:
            low -= 1
            first, last = min(first, self.first[low]), max(last, self.last[low])
        self.first[low:k], self.last[low:k] = [first], [last]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        self.words = [_WORD.findall(t.lower()) for _, t in templates]
        self.counts = [Counter(words) for words in self.words]
        self.memo = Memo(_hash, 200_000)
        index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            grams = gram_hashes(np.array([_hash(w) for w in words], np.uint64))
            for at in winnowed(grams):
                index[int(grams[at])].append((k, int(at)))
        self.index = dict(index)
        self.keys = np.array(sorted(index), np.uint64)

    def align(self, k: int, words: list[str], diagonal: int, more: int = 0) -> tuple[int, int, int, int] | None:
        """(score, matched, first, last word) of template k in words near a diagonal (text minus template position), or near those up to more above it."""
        want, width = self.words[k], 2 * BAND + 1 + more
        if diagonal >= 0 and words[diagonal : diagonal + len(want)] == want:  # nothing scores more or lies nearer
            return len(want), len(want), diagonal, diagonal + len(want) - 1
        there = Counter(words[max(0, diagonal - BAND) : max(0, diagonal + len(want) + BAND + more)])
        if sum(min(n, there[w]) for w, n in self.counts[k].items()) < COVERAGE * len(want):
            return None  # the band's words can't cover enough in any order
        # state: (score, matched, -distance of the first word from the diagonal, -first, last); row i ends with template word i, column c is text position i + diagonal + c - BAND
        before = [(0, 0, 0, 1, -1)] * width
        for i, w in enumerate(want):
            row = []
            for c in range(width):
                j = i + diagonal + c - BAND
                s, m, d, a, z = before[c]
                if 0 <= j < len(words) and words[j] == w:
                    best = (s + 1, m + 1, -max(diagonal - j, j - diagonal - more, 0), -j, j) if a > 0 else (s + 1, m + 1, d, a, j)
                else:
                    best = (s - 1, m, d, a, z)
                if c + 1 < width:  # a template word that the text lacks
                    s, m, d, a, z = before[c + 1]
                    best = max(best, (s - 1, m, d, a, z))
                if row:  # a text word that the template lacks; free before the first match
                    s, m, d, a, z = row[-1]
                    best = max(best, (s - (a <= 0), m, d, a, z))
                row.append(best)
            before = row
        score, matched, _, first, last = max(before)
        return (score, matched, -first, last) if matched >= COVERAGE * len(want) else None

    def chains(self, k: int, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """(least, greatest diagonal) of chains of hits (text, template position) of template k that rise in both, with gaps of a template's length at most."""
        hits, reach, low = sorted(hits), 2 * len(self.words[k]), 0
        length, before = [1] * len(hits), [-1] * len(hits)
        for i, (at, t) in enumerate(hits):
            while hits[low][0] < at - reach:
                low += 1
            for j in range(low, i):
                if hits[j][0] < at and hits[j][1] < t and length[j] + 1 >= length[i]:  # of equals the nearest
                    length[i], before[i] = length[j] + 1, j
        used: set[int] = set()
        for i in sorted(range(len(hits)), key=lambda i: -length[i]):
            if i not in used:
                chain = [i]
                while before[chain[-1]] >= 0:
                    chain.append(before[chain[-1]])
                used.update(chain)
                diagonals = [hits[j][0] - hits[j][1] for j in chain]
                yield min(diagonals), max(diagonals)

    def finds(self, words: list[str], hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
        """(template, matched, score, first, last) of non-overlapping finds; hits: (position, fingerprint)."""
        mine: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, f in hits:
            for k, t in self.index[f]:
                mine[k].append((at, t))
        found: set[tuple[int, int, str, int, int, int]] = set()

        def note(k: int, a: tuple[int, int, int, int] | None, covered: Spans) -> bool:
            if a:
                found.add((-a[0], a[1], self.names[k], k, a[2], a[3]))
                covered.add(a[2], a[3])
            return a is not None

        for k, own in mine.items():
            covered, tried, failed = Spans(), set(), []
            for at, t in own:
                diagonal = at - t
                if diagonal in tried or covered.meets(at, at):
                    continue
                tried.add(diagonal)
                near = bisect_right(failed, diagonal + BAND // 2) - 1
                if near >= 0 and failed[near] >= diagonal - BAND // 2:
                    continue
                if not note(k, self.align(k, words, diagonal), covered):
                    insort(failed, diagonal)
            # what no single band holds: runs of hits on several diagonals, as where words are put in or left out
            rest = [(at, t) for at, t in own if not covered.meets(at, at)]
            for low, high in sorted(set(self.chains(k, rest))):
                if high > low:
                    note(k, self.align(k, words, low, high - low), covered)
        out, taken = [], Spans()
        for score, matched, _, k, first, last in sorted(found, key=lambda x: (x[0], x[2], x[4], -x[5], x[3])):
            if not taken.meets(first, last):
                taken.add(first, last)
                out.append((k, matched, -score, first, last))
        return out

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, str, float, int, int, int]]:
        """(text number, license, coverage, matched words, start and end character) of each find."""
        held: list[tuple[int, int]] = []
        words: list[str] = []

        def flush() -> Iterator[tuple[int, str, float, int, int, int]]:
            h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
            at = 0
            for i, n in held:
                grams = gram_hashes(h[at : at + n])
                if len(grams):
                    where = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
                    if (self.keys[where] == grams).any():
                        some = winnowed(grams)
                        some = some[self.keys[where[some]] == grams[some]]
                        mine = words[at : at + n]
                        found = self.finds(mine, [(int(p), int(grams[p])) for p in some])
                        spans = list(_WORD.finditer(texts[i])) if found else []
                        if len(spans) != n:  # lower-casing changed the words' number
                            spans = list(_WORD.finditer(texts[i].lower())) if found else []
                        for k, matched, _, first, last in found:
                            yield i, self.names[k], matched / len(self.words[k]), matched, spans[first].start(), spans[last].end()
                at += n

        for i, text in enumerate(texts):
            mine = _WORD.findall(text.lower()) if text else []
            held.append((i, len(mine)))
            words += mine
            if len(words) >= CHUNK:
                yield from flush()
                held, words = [], []
        yield from flush()


@cache
def _scanner() -> Scanner:
    return Scanner(TEMPLATES)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license, coverage, matched_words, start_char and end_char of each find in docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates) if templates else _scanner()
        names = ["doc_id", "license", "coverage", "matched_words", "start_char", "end_char"]
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[i], *rest) for i, *rest in scanner.scan(batch.column(1).to_pylist())]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, coverage double, matched_words int, start_char long, end_char long")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
