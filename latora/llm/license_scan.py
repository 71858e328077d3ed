"""License scans: winnowed template fingerprints, an inverted index, and banded alignment.

Templates are reduced to words, and their word k-grams winnowed: of every few grams in a row the
one of the least hash stands in the inverted index. A changed or missing word spoils ``K`` grams at
most, so a passage that covers enough of a template keeps a known number of its selected grams.
Of the windows up to ``WINDOW`` each template takes the widest for which that number is above
zero, which is one gram, all of them, for the shortest. All k-grams of a document are looked up;
those with a word that no template has can't be in the index. As many hits of one template on
nearby diagonals make a candidate, and a candidate is aligned to the template within ``BAND`` words
of its diagonal. A match covers at least ``COVERAGE`` of the template's words.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased.

Defined cases: a null, empty or wordless text matches nothing; a text of any length is read
whole, and passages of any number are reported; a passage that matches several templates
is reported for the one that covers most words (then by name); repeated rows are scanned
alike; empty tables give no rows; extra columns are ignored. Offsets are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latora.llm.common import map_batches, row_slices, utf8

K = 2
WINDOW = 3
BAND = 8
COVERAGE = 0.8
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = "doc_id long, matches array<struct<license:string,start:long,end:long,coverage:double>>"
_MATCHES = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

# Public notices, as licensors ask for them to be written.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Places of the selected hashes: the rightmost least one of each window."""
    if not hashes:
        return []
    out: list[int] = []
    for at in range(max(1, len(hashes) - window + 1)):
        part = hashes[at : at + window]
        place = at + max(k for k, h in enumerate(part) if h == min(part))
        if not out or out[-1] != place:
            out.append(place)
    return out


class Index:
    """The templates' words, and an inverted index from winnowed k-grams to (template, place)."""

    def __init__(self, templates: Mapping[str, str], coverage: float = COVERAGE):
        self.names = sorted(templates)
        self.vocabulary: dict[bytes, int] = {}
        self.words = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in WORD.findall(utf8(templates[n]).lower())] for n in self.names]
        self.base = len(self.vocabulary) + 1
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        #: hits that a passage of enough coverage has at least
        self.need: list[int] = []
        for t, words in enumerate(self.words):
            grams = [self._key(words[k : k + K]) for k in range(len(words) - K + 1)]
            hashes = [xxhash.xxh3_64_intdigest(g.to_bytes(16, "little")) for g in grams]
            spoilt = K * int((1 - coverage) * len(words) + 1e-9)
            for window in range(WINDOW, 0, -1):
                places = winnow(hashes, window)
                if len(places) > spoilt:
                    break
            self.need.append(max(1, len(places) - spoilt))
            for place in places:
                self.postings[grams[place]].append((t, place))
        self.keys = np.array(sorted(self.postings), np.int64)

    def _key(self, words: list[int]) -> int:
        key = 0
        for w in words:
            key = key * self.base + w
        return key

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, document word, template word) of each k-gram of a document in the index."""
        n = len(ids) - K + 1
        if n < 1 or not len(self.keys):
            return
        inside = ids > 0
        whole = inside[:n].copy()
        for k in range(1, K):
            whole &= inside[k : n + k]
        at = np.flatnonzero(whole)
        key = np.zeros(len(at), np.int64)
        for k in range(K):
            key = key * self.base + ids[at + k]
        where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[where] == key
        for place, k in zip(at[found].tolist(), key[found].tolist()):
            for t, own in self.postings[k]:
                yield t, place, own

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(template, diagonal) of runs of hits that could cover enough of a template."""
        by_template: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, place, own in self.hits(ids):
            by_template[t].append((place - own, own))
        for t, found in by_template.items():
            found.sort()
            group: list[tuple[int, int]] = []
            for diagonal, own in [*found, (1 << 60, 0)]:
                if group and diagonal - group[-1][0] > BAND:
                    if len({o for _, o in group}) >= self.need[t]:
                        yield from ((t, d) for d in sorted({d for d, _ in group}))
                    group = []
                group.append((diagonal, own))


def align(template: list[int], ids: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment near a diagonal: (words matched, first document word, end).

    A match scores 4, a mismatch or a gap -1, so that one matching word at an end counts though the
    next few were changed. Cells hold (score, matches, start).
    """
    width = 2 * band + 1
    none = (0, 0, -1)
    above = [none] * width
    best, best_end = none, -1
    for i, word in enumerate(template):
        row = [none] * width
        for b in range(width):
            j = i + diagonal - band + b
            if not 0 <= j < len(ids):
                continue
            same = ids[j] == word
            score, matches, start = above[b]
            options = [(score + 4, matches + 1, start if start >= 0 else j) if same else (score - 1, matches, start)]
            if b + 1 < width:
                options.append((above[b + 1][0] - 1, above[b + 1][1], above[b + 1][2]))
            if b:
                options.append((row[b - 1][0] - 1, row[b - 1][1], row[b - 1][2]))
            cell = max(options, key=lambda c: (c[0], c[1]))
            if cell[0] > 0:
                row[b] = cell
                if same and cell[0] > best[0]:
                    best, best_end = cell, j + 1
        above = row
    return best[1], best[2], best_end


def find(text: bytes, index: Index, coverage: float = COVERAGE) -> list[tuple[str, int, int, float]]:
    """(license, first word, end, coverage) of each match, in order and apart from each other."""
    get = index.vocabulary.get
    ids = np.array([get(w, 0) for w in WORD.findall(text.lower())], np.int64)
    found = set()
    for t, diagonal in index.candidates(ids):
        words = index.words[t]
        band = min(BAND, len(words) // 3)  # less than a short notice, which may be repeated at once
        low = max(0, diagonal - band)
        matched, start, end = align(words, ids[low : diagonal + len(words) + band + 1].tolist(), diagonal - low, band)
        if matched >= coverage * len(words):
            found.add((matched, index.names[t], start + low, end + low, matched / len(words)))
    out: list[tuple[int, int, str, float]] = []
    for matched, name, start, end, share in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        at = bisect_left(out, (start,))
        if (at == 0 or out[at - 1][1] <= start) and (at == len(out) or end <= out[at][0]):
            out.insert(at, (start, end, name, share))
    return [(name, start, end, share) for start, end, name, share in out]


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, matches: license, start, end, coverage) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, coverage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part in row_slices(batches):
            rows = []
            for text in part.column(1).to_pylist():
                raw = utf8(text)
                matches = find(raw, index, coverage)
                at = [m.span() for m in WORD.finditer(raw.lower())] if matches else []
                points = lambda byte: len(raw[:byte].decode("utf-8", "surrogatepass"))  # noqa: B023, E731
                rows.append([{"license": n, "start": points(at[s][0]), "end": points(at[e - 1][1]), "coverage": c} for n, s, e, c in matches])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _MATCHES)], names=["doc_id", "matches"])

    return map_batches(docs.select(F.col(id_col).cast("long"), text_col), run, FOUND)
