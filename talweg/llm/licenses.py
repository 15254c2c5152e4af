"""License scans by a positional index of rare words.

Each template is a licence text (or a short name) that opens with a mandatory key phrase. How many documents hold each word
of the key phrases is counted over the whole corpus; the index holds each template under the rarest word of its key phrase
(highest inverse document frequency), with that word's position. A file's licence words are looked up from the rarest on;
each hit implies a start of the template by relative position, and the place counts if every word of the key phrase stands
there. Its score is the share of the template's words that stand at their positions after that start, by intersecting the
template's postings with the file's. A phrase can't stand anywhere without its rarest word, so none is missed.

Words are runs of ASCII letters and digits, after lower-casing A-Z, and of all other characters. Nulls and empty texts
have no words: zero counts, null places, empty labels, score 0. Repeated rows are scanned each; an empty table gives an
empty result. Other columns are ignored, whatever their names. Ties between rare words go to the earlier one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, slices, span_hash, text_buffer, word_spans

#: Fixed base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Further short names: words, how many leading words are the key phrase, label.
FURTHER = (
    ("gnu general public license version 2", 6, "gpl-2"),
    ("gnu general public license version 3", 6, "gpl-3"),
    ("gnu lesser general public license", 5, "lgpl"),
    ("gnu affero general public license", 5, "agpl"),
    ("apache license version 2 0", 5, "apache-2.0"),
    ("cc by nc", 3, "cc-by-nc"),
    ("cc by sa", 3, "cc-by-sa"),
    ("cc by nd", 3, "cc-by-nd"),
    ("creative commons attribution", 3, "cc-by"),
    ("mozilla public license", 3, "mpl"),
    ("eclipse public license", 3, "epl"),
    ("boost software license", 3, "bsl"),
    ("bsd license", 2, "bsd"),
    ("isc license", 2, "isc"),
)
#: Whole texts and notices of public licences (fixed values), how many leading words are the key phrase, label.
TEXTS = (
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
    files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
    modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
    is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
    included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
    EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
    NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
    IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
    DEALINGS IN THE SOFTWARE.""", 10, "mit"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
    provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
    THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
    FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
    WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
    ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", 9, "isc"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
    following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
    the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED
    BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""", 8, "bsd"),
    ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
    sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
    non-commercial, and by any means.""", 6, "unlicense"),
    ("""Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or
    organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
    reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to
    permit third-parties to whom the Software is furnished to do so.""", 6, "bsl-1.0"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
    any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
    including commercial applications, and to alter it and redistribute it freely.""", 11, "zlib"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
    License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
    or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
    CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
    limitations under the License.""", 8, "apache-2.0"),
    ("""This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
    published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program
    is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", 9, "gpl"),
    ("""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
    License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
    version.""", 9, "lgpl"),
    ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
    with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", 10, "mpl-2.0"),
)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TO_LOWER = {k: k + 32 for k in range(65, 91)}
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    key: int
    label: str
    base: bool


def split(text: str) -> tuple[str, ...]:
    """The words of a template."""
    return tuple(re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", text.translate(_TO_LOWER)))


def templates() -> list[Template]:
    base = [Template(split(p), len(split(p)), x, True) for p, x in BASE]
    return base + [Template(split(p), k, x, False) for p, k, x in (*FURTHER, *TEXTS)]


def _vocabulary(some: list[Template], key_only: bool = False) -> list[str]:
    return sorted({w for t in some for w in (t.words[: t.key] if key_only else t.words)})


def index(some: list[Template], df: dict[str, int]) -> list[tuple[str, list[tuple[int, int]]]]:
    """The rare words, rarest first, each with the templates (by number) that it leads to and its position in them."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for n, t in enumerate(some):
        at = min(range(t.key), key=lambda k: (df[t.words[k]], k))
        postings.setdefault(t.words[at], []).append((n, at))
    return sorted(postings.items(), key=lambda x: (df[x[0]], x[0]))


class _Words:
    """The words of a slice of texts, those of the vocabulary recognised."""

    def __init__(self, column: pa.Array, vocabulary: list[str]) -> None:
        raw, bounds = text_buffer(column)
        self.data = _LOWER[raw]
        self.start, self.end, self.count = word_spans(_WORD[self.data], bounds)
        self.first = np.cumsum(self.count) - self.count  # of each document, among all words
        coded = np.array([int(h) for w in vocabulary for h in span_hash(BYTE_VALUE[np.frombuffer(w.encode(), np.uint8)], np.array([0]), np.array([len(w.encode())]))], np.uint64)
        order = np.argsort(coded)
        size = np.unique([len(w) for w in vocabulary])
        some = np.flatnonzero(np.isin(self.end - self.start, size))
        h = span_hash(BYTE_VALUE[self.data], self.start[some], self.end[some])
        at = np.minimum(np.searchsorted(coded[order], h), len(coded) - 1)
        hit = coded[order][at] == h
        self.word = np.full(len(self.start), -1, np.int16)
        self.word[some[hit]] = order[at[hit]]

    def doc_of(self, k: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, k, "right") - 1


def document_frequency(docs: DataFrame, some: list[Template], text_col: str = "text") -> dict[str, int]:
    """In how many documents of the whole table each word of a key phrase stands."""
    vocabulary = _vocabulary(some, key_only=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for b in slices(batches, "_text"):
            w = _Words(b.column(0), vocabulary)
            at = np.flatnonzero(w.word >= 0)
            pairs = np.unique(w.doc_of(at) * len(vocabulary) + w.word[at])
            total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"word": pa.array(range(len(vocabulary)), pa.int32()), "n": total})

    counted = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counted.collect()}  # as many rows as the templates have words
    return {w: found.get(k, 0) for k, w in enumerate(vocabulary)}


def _places(w: _Words, hit: np.ndarray, t: Template, rare: int, code: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """First words of all places of a template whose rare word stands at the hits, in order, and the share of its words that stands there."""
    start, doc = hit - rare, w.doc_of(hit)
    ok = (start >= w.first[doc]) & (start + t.key <= w.first[doc] + w.count[doc])
    start, doc = start[ok], doc[ok]
    for k in range(t.key):
        ok = w.word[start + k] == code[t.words[k]]
        start, doc = start[ok], doc[ok]
    # What the hashes found is compared letter by letter; there are few places.
    letters = lambda s, k: w.data[w.start[s + k] : w.end[s + k]].tobytes() == t.words[k].encode()
    same = np.fromiter((all(letters(s, k) for k in range(t.key)) for s in start.tolist()), bool, len(start))
    start, doc = start[same], doc[same]
    stands = np.full(len(start), t.key, np.int64)
    for k in range(t.key, len(t.words)):
        inside = start + k < w.first[doc] + w.count[doc]
        stands += inside & (w.word[np.minimum(start + k, max(len(w.word) - 1, 0))] == code[t.words[k]])
    return start, stands / len(t.words)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a verified template's words that stands at one place (1 wherever a short name stands).
    """
    some = templates()
    df = document_frequency(docs, some, text_col)
    vocabulary = _vocabulary(some)
    code = {w: k for k, w in enumerate(vocabulary)}
    postings = index(some, df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            w = _Words(b.column(1), vocabulary)
            n = b.num_rows
            n_base, best = np.zeros(n, np.int64), np.zeros(n)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
            base: list[set[str]] = [set() for _ in range(n)]
            own: list[set[str]] = [set() for _ in range(n)]
            for word, leads in postings:
                hit = np.flatnonzero(w.word == code[word])
                for number, at in leads if len(hit) else ():
                    t = some[number]
                    start, share = _places(w, hit, t, at, code)
                    doc = w.doc_of(start)
                    np.maximum.at(best, doc, share)
                    if t.base:
                        n_base += np.bincount(doc, minlength=n)
                        np.minimum.at(first, doc, start - w.first[doc])
                        np.maximum.at(last, doc, start - w.first[doc])
                    for d in np.unique(doc).tolist():
                        own[d].add(t.label)
                        if t.base:
                            base[d].add(t.label)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(w.count, pa.int64()), pa.array(n_base), pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none), pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array([",".join(sorted(x)) for x in own], pa.string()), pa.array(best)],
                names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    source = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def sql() -> str:
    """The same rows in SQL: key phrases by search, scores by comparing words at each place of a longer template's key phrase."""
    pad = lambda words: " " + "  ".join(words) + " "  # noqa: E731  each word between blanks of its own
    some = templates()
    base = [t for t in some if t.base]
    count = " + ".join(f"(length(s) - length(replace(s, '{pad(t.words)}', ''))) // {len(pad(t.words))}" for t in base)
    before = lambda s: f"len(list_filter(string_split({s}, ' '), lambda x: x <> ''))"
    first = ", ".join(f"CASE WHEN contains(s, '{pad(t.words)}') THEN {before(f"substr(s, 1, strpos(s, '{pad(t.words)}') - 1)")} END" for t in base)
    last = ", ".join(f"CASE WHEN contains(s, '{pad(t.words)}') THEN n_words - {len(t.words)} - {before(f"substr(r, 1, strpos(r, '{pad(t.words)[::-1]}') - 1)")} END" for t in base)
    named = lambda which: "list_filter([" + ", ".join(f"CASE WHEN contains(s, '{pad(t.words[: t.key])}') THEN '{t.label}' END" for t in which) + "], lambda x: x IS NOT NULL)"
    joined = lambda which: f"array_to_string(list_sort(list_distinct({named(which)})), ',')"
    whole = " OR ".join(f"contains(s, '{pad(t.words)}')" for t in some if t.key == len(t.words))
    long = [t for t in some if t.key < len(t.words)]
    said = lambda words: "[" + ", ".join(f"'{x}'" for x in words) + "]"
    place = lambda t: f"list_filter(range(1, n_words + 1), lambda p: ws[p:p + {t.key - 1}] = {said(t.words[: t.key])})"
    stand = lambda t: f"list_max(list_transform({place(t)}, lambda p: len(list_filter(range(0, {len(t.words)}), lambda k: ws[p + k] = {said(t.words)}[k + 1])) / {len(t.words)}.0::DOUBLE))"
    shares = ", ".join(f"CASE WHEN contains(s, '{pad(t.words[: t.key])}') THEN {stand(t)} END" for t in long)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, len(ws) AS n_words, ' ' || array_to_string(ws, '  ') || ' ' AS s FROM w), q AS (SELECT *, reverse(s) AS r FROM p)
SELECT doc_id, n_words, ({count})::BIGINT AS n_base, least({first}) AS first_word, greatest({last}) AS last_word, {joined(base)} AS base_labels, {joined(some)} AS labels,
       CASE WHEN {whole} THEN 1.0::DOUBLE ELSE coalesce(greatest({shares}), 0.0)::DOUBLE END AS score
FROM q"""
