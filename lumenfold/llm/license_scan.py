"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies them.

A template of m word shingles (five words) is looked for with windows of W shingles, the least power of two
with W >= m + stride - 1, where neighbouring windows start stride = max(1, W / 4) shingles apart. So some
window holds any whole occurrence, and its Jaccard similarity with the template is at least 0.375; with
a fifth of the template changed, at least 0.28. A band is one MinHash row, and one equal band of ``BANDS`` =
24 makes a candidate, looked up among all templates at once in a table of bands: it is found with probability 1 - (1 - 0.28)^24 > 0.999. Candidates are verified on the
words themselves: ``containment`` is the share of the template's distinct shingles that are in the window and
the stride on both sides of it.

Defined cases: null, blank and wordless texts have no matches; a template of under five words is one shingle
of all its words; every occurrence counts, of those of one template that overlap the best, the first of equals; repeated rows give
repeated rows; other columns are ignored. Windows may run past a document's end, which only adds strangers to them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.sparkkit import map_arrow, read
from lumenfold.llm.textkit import ALNUM, LOWER, blocks, gram_hashes, sliding_min, word_hashes, words

SHINGLE = 5
BANDS = 24
SIMILARITY = 0.8

# Public license notices, by SPDX identifier.
TEMPLATES = [
    ("AGPL-3.0-or-later", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "disclaimer", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSL-1.0", "notice", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "long notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1-or-later", "header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "disclaimer", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]

_rng = np.random.default_rng(31)
_ODD = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCHEMA = "doc_id long, n_words long, matches array<struct<license:string,part:string,containment:double,lo:int,hi:int>>"


def window_of(m: int) -> tuple[int, int]:
    """(window, stride) in shingles for a template of m shingles."""
    w = 1
    while w < m + max(1, w // 4) - 1:
        w *= 2
    return w, max(1, w // 4)


def tokens(text: str) -> list[bytes]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end, _ = words(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def shingles(parts: list[bytes], k: int) -> list[tuple[bytes, ...]]:
    """The distinct shingles in the order in which they first occur."""
    return list(dict.fromkeys(tuple(parts[i : i + k]) for i in range(len(parts) - k + 1)))


class Template:
    def __init__(self, name: str, part: str, text: str, bands: int) -> None:
        self.name, self.part = name, part
        parts = tokens(text)
        self.k = min(SHINGLE, len(parts))
        self.exact = {x: n for n, x in reversed(list(enumerate(shingles(parts, self.k))))}
        self.window, self.stride = window_of(len(self.exact))
        data = LOWER[np.frombuffer(text.encode(), np.uint8)]
        start, end, _ = words(data, np.array([0, len(data)]), ALNUM)
        h = gram_hashes(word_hashes(data, start, end, ALNUM), self.k)
        self.least = [(h * _ODD[b]).min() for b in range(bands)]


    def occurrences(self, parts: list[bytes], similarity: float) -> list[tuple[float, int, int]]:
        """(containment, first word, end) of the occurrences within some words: stretches of the template's shingles that each begin anew."""
        hits = [(j, self.exact[x]) for j in range(len(parts) - self.k + 1) if (x := tuple(parts[j : j + self.k])) in self.exact]
        if not hits:
            return []
        cuts = [0, *(n for n in range(1, len(hits)) if hits[n][1] <= hits[n - 1][1]), len(hits)]
        pieces = [hits[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        measure = lambda piece: (len({x for _, x in piece}) / len(self.exact), piece[0][0], piece[-1][0] + self.k)
        good = [m for m in map(measure, pieces) if m[0] >= similarity]
        return good or [m for m in [measure(hits)] if m[0] >= similarity]


def apart(found: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Of occurrences that overlap the best, the first and shortest of equals, in order of place."""
    kept: list[tuple[float, int, int]] = []
    for share, lo, hi in sorted(set(found), key=lambda x: (-x[0], x[2] - x[1], x[1])):
        if all(hi <= a or lo >= b for _, a, b in kept):
            kept.append((share, lo, hi))
    return sorted(kept, key=lambda x: x[1])


class BandTable:
    """For each shingle size, window and band: the templates' values in order, so a window's value is looked up among all templates at once."""

    def __init__(self, known: list[Template], bands: int) -> None:
        self.bands = bands
        self.rows: dict[int, dict[int, list[tuple[np.ndarray, np.ndarray]]]] = defaultdict(dict)
        for k, w in {(t.k, t.window) for t in known}:
            own = np.array([i for i, t in enumerate(known) if (t.k, t.window) == (k, w)])
            for b in range(bands):
                values = np.array([known[i].least[b] for i in own], np.uint64)
                order = np.argsort(values, kind="stable")
                self.rows[k].setdefault(w, []).append((values[order], own[order]))

    def candidates(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(template, window start) of equal bands, over all words of a block."""
        out: set[tuple[int, int]] = set()
        for k, by_window in self.rows.items():
            grams = gram_hashes(h, k)
            if not len(grams):
                continue
            most = max(by_window)
            padded = np.concatenate([grams, np.zeros(most - 1, np.uint64)])
            for b in range(self.bands):
                low = padded * _ODD[b]
                low[len(grams) :] = np.iinfo(np.uint64).max
                span = 1
                while span <= most:
                    stride = max(1, span // 4)
                    if span in by_window:
                        values, own = by_window[span][b]
                        at = low[: len(grams) : stride]
                        left, right = np.searchsorted(values, at), np.searchsorted(values, at, side="right")
                        for p in np.flatnonzero(right > left).tolist():
                            out.update((int(i), p * stride) for i in own[left[p] : right[p]])
                    low = np.minimum(low[:-span], low[span:]) if len(low) > span else low
                    span *= 2
        return out


def license_scan(documents: DataFrame, templates: list[tuple[str, str, str]] | None = None, bands: int = BANDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document: doc_id, n_words and its matches (license, part, containment, lo, hi: words)."""
    known = [Template(*t, bands) for t in templates or TEMPLATES if tokens(t[2])]
    table = BandTable(known, bands)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, matches = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
        for begin, stop, data, offsets in blocks(batch["text"]):
            data = LOWER[data]
            start, end, first = words(data, offsets, ALNUM)
            counts[begin:stop] = np.diff(first)
            h = word_hashes(data, start, end, ALNUM)
            found: dict[tuple[int, int], list[tuple[float, int, int]]] = defaultdict(list)
            raw = None
            seen = set()
            for i, at in sorted(table.candidates(h)):
                t = known[i]
                raw = raw or data.tobytes()
                lo, hi = max(0, at - t.stride), min(len(start), at + t.window + t.stride + t.k - 1)
                for d in range(int(np.searchsorted(first, lo, side="right")) - 1, int(np.searchsorted(first, hi, side="left"))):
                    a, b = max(lo, int(first[d])), min(hi, int(first[d + 1]))
                    if b - a < t.k or (i, a, b) in seen:
                        continue
                    seen.add((i, a, b))
                    parts = [raw[x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
                    found[d, i] += [(share, a + x - int(first[d]), a + y - int(first[d])) for share, x, y in t.occurrences(parts, similarity)]
            for (d, i), all_ in sorted(found.items()):
                for share, lo, hi in apart(all_):
                    matches[begin + d].append({"license": known[i].name, "part": known[i].part, "containment": share, "lo": lo, "hi": hi})
        kind = pa.list_(pa.struct([("license", pa.string()), ("part", pa.string()), ("containment", pa.float64()), ("lo", pa.int32()), ("hi", pa.int32())]))
        yield pa.record_batch([batch["doc_id"], pa.array(counts), pa.array(matches, kind)], ["doc_id", "n_words", "matches"])

    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _SCHEMA)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    found = license_scan(read(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.array_max(F.transform("matches", lambda m: m["containment"])).alias("containment"))
