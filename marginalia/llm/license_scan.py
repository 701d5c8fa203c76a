"""Operator 4: licence notices and whole licences in texts, by Dice coefficient over word bigrams.

Lines, paragraphs and whole documents are normalised to words and compared with templates. A template of
n bigrams can reach a coefficient of t only with units of n t / (2 - t) to n (2 - t) / t bigrams, so most
templates are never compared. A unit has as many bigrams as distinct words, but for one, and fewer than
words; where no template fits those two numbers, its words aren't paired.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import over_batches, texts

# Notices of public licences; whole texts are in the folder licences.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
        "under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "All-rights-reserved": ("All rights reserved.",),
}
#: Percent: Dice coefficient from which a unit matches.
THRESHOLD = 80
_WORD = re.compile(r"[^\W_]+")

SCHEMA = "doc_id long, n_matches long, licenses string, best_dice double, matches array<struct<license:string,unit:string,line:int,lines:int,dice:double>>"


@lru_cache(maxsize=1)
def library() -> dict[str, tuple[str, ...]]:
    """The notices of TEMPLATES and the whole texts of the folder licences, by licence."""
    found = dict(TEMPLATES)
    for file in sorted(resources.files(__package__).joinpath("licences").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            name = file.name[: -len(".txt")]
            found[name] = (*found.get(name, ()), file.read_text(encoding="utf-8"))
    return found


def normalise(text: str) -> list[str]:
    """Words of letters and digits, lower-cased."""
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    """Distinct pairs of neighbouring words."""
    return frozenset(zip(words, words[1:], strict=False))


class Templates:
    """Templates by their number of bigrams."""

    def __init__(self, texts_by_name: dict[str, tuple[str, ...]], threshold: int = THRESHOLD):
        self.threshold = threshold
        rows = [(len(g := bigrams(normalise(t))), name, g) for name, many in texts_by_name.items() for t in many]
        self.rows = sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1]))
        self.sizes = [r[0] for r in self.rows]
        self.most_words = max(self.sizes, default=0) * (200 - threshold) // threshold + 1

    def bounds(self, n: int) -> tuple[int, int]:
        """The templates that a unit of ``n`` bigrams can match: a range of ``rows``."""
        t = self.threshold
        return bisect_left(self.sizes, -(-n * t // (200 - t))), bisect_right(self.sizes, n * (200 - t) // t)

    def match(self, words: list[str]) -> tuple[float, str] | None:
        """The best coefficient and its licence, if it reaches the threshold; ties go to the first name."""
        if len(words) < 2 or self.bounds(len(set(words)) - 1)[0] >= self.bounds(len(words) - 1)[1]:
            return None
        grams = bigrams(words)
        lo, hi = self.bounds(len(grams))
        found = []
        for size, name, other in self.rows[lo:hi]:
            both = len(grams & other)
            if 200 * both >= self.threshold * (len(grams) + size):
                found.append((-2 * both / (len(grams) + size), name))
        if not found:
            return None
        score, name = min(found)
        return -score, name

    def scan(self, text: str) -> list[tuple[str, str, int, int, float]]:
        """(licence, unit, first line, lines, coefficient) of matching lines, paragraphs and whole text, by unit and place."""
        lines = text.split("\n")
        words = [normalise(x) for x in lines]
        out = []
        for i, w in enumerate(words):
            if len(w) <= self._limit(w) and (m := self.match(w)):
                out.append((m[1], "line", i, 1, m[0]))
        parts, at = [], 0
        while at < len(lines):
            if not words[at]:
                at += 1
                continue
            end = at
            while end < len(lines) and words[end]:
                end += 1
            parts.append((at, end))
            at = end
        units = [("paragraph", a, b) for a, b in parts if b - a > 1]
        if len(parts) > 1:
            units.append(("document", 0, len(lines)))
        for kind, a, b in units:
            if sum(map(len, words[a:b])) <= self._limit_of(words[a:b]):
                m = self.match([x for w in words[a:b] for x in w])
                if m:
                    out.append((m[1], kind, a, b - a, m[0]))
        return out

    def _limit(self, words: list[str]) -> int:
        """Words that a unit may have: repeats of a bigram count once, so a long unit of few distinct words may still match."""
        return len(words) if len(words) <= self.most_words or len(set(words)) <= self.most_words else -1

    def _limit_of(self, rows: list[list[str]]) -> int:
        n = sum(map(len, rows))
        if n <= self.most_words:
            return n
        seen: set[str] = set()
        for w in rows:
            seen.update(w)
            if len(seen) > self.most_words:
                return -1
        return n


@lru_cache(maxsize=2)
def _prepared(texts_by_name: tuple[tuple[str, tuple[str, ...]], ...], threshold: int) -> Templates:
    """Templates, made once in a worker."""
    return Templates(dict(texts_by_name), threshold)


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """Licences found in every document.

    Takes doc_id and text; other columns are ignored. A null or empty text matches nothing. One row for
    each input row: ``matches`` in order of units (lines, paragraphs, the document) and place, the sorted
    distinct ``licenses``, and the best coefficient (0 if none). ``templates`` (by default ``library()``)
    are texts by licence, a fixed table of some 300 KB sent with the task. A unit with more distinct words
    than a template of the upper size bound has is beyond all bounds. Repeated rows are scanned each; an
    empty table gives no rows.
    """
    sent = tuple((library() if templates is None else templates).items())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = _prepared(sent, threshold)
        found = [known.scan(t or "") for t in batch.column(1).to_pylist()]
        item = pa.struct([("license", pa.string()), ("unit", pa.string()), ("line", pa.int32()), ("lines", pa.int32()), ("dice", pa.float64())])
        cols = [
            batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(sorted({m[0] for m in f})) for f in found], pa.string()),
            pa.array([max((m[4] for m in f), default=0.0) for f in found], pa.float64()),
            pa.array([[dict(zip(("license", "unit", "line", "lines", "dice"), m, strict=True)) for m in f] for f in found], pa.list_(item)),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_matches", "licenses", "best_dice", "matches"])

    return over_batches(texts(docs), run, SCHEMA)
