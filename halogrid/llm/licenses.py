"""License scans by patience alignment of a text's words with templates of license notices.

Words that occur once in the text and once in the template are anchors; the longest increasing subsequence of their
places aligns them, and the gaps between aligned words are aligned in the same way.  A gap without anchors is matched
from its two ends.  A template's coverage is the share of its words that the alignment meets; a license is found if
coverage and density (aligned words over the stretch of text that they span) reach their thresholds.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, table, utf8

COVERAGE, DENSITY = 0.8, 0.6

#: Notices of well-known public licenses, fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.-][a-z0-9\x80-\xff]+)*")


def word_list(text: bytes) -> list[bytes]:
    """A-Z-lower-cased runs of letters, digits and bytes over 127, with dots and hyphens between them."""
    return _WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first) whose second numbers increase, by patience piles."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = last[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            last.append(i)
        else:
            tops[k], last[k] = b, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            out.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.append((ah, bh))
        if al >= ah or bl >= bh:
            continue
        once: dict[bytes, int] = {}
        for j in range(bl, bh):
            once[b[j]] = -1 if b[j] in once else j
        seen: dict[bytes, int] = {}
        for i in range(al, ah):
            if once.get(a[i], -1) >= 0:
                seen[a[i]] = -1 if a[i] in seen else i
        anchors = increasing(sorted((i, once[w]) for w, i in seen.items() if i >= 0))
        at, bt = al, bl
        for i, j in anchors:
            out.append((i, j))
            todo.append((at, i, bt, j))
            at, bt = i + 1, j + 1
        if anchors:
            todo.append((at, ah, bt, bh))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, word_list(text.encode())
        self.vocabulary = set(self.words)

    def cover(self, words: list[bytes]) -> tuple[float, float, int, int]:
        """Coverage, density, first and one-past-last word of the best place of the template in the words.

        A long text may hold a template's words elsewhere too, so every place of the template's rarest word there is
        tried, with as many words around it as the template may take at the least density.
        """
        count = {w: 0 for w in self.vocabulary}
        places: dict[bytes, list[int]] = {w: [] for w in self.vocabulary}
        for i, w in enumerate(words):
            if w in count:
                count[w] += 1
                places[w].append(i)
        known = [w for w in self.vocabulary if count[w]]
        if sum(min(count[w], self.words.count(w)) for w in known) < COVERAGE * len(self.words):
            return 0.0, 0.0, 0, 0
        # One of the rarest words is aligned wherever coverage is reached: more are tried than may be missing.
        spare = len(self.words) - int(-(-COVERAGE * len(self.words) // 1)) + 1
        rare = sorted(known, key=lambda w: (count[w], w))[:spare]
        reach = int(len(self.words) / DENSITY) + 1
        best = (0.0, 0.0, 0, 0)
        for at in sorted({i for w in rare for i in places[w]}):
            lo, hi = max(0, at - reach), min(len(words), at + reach)
            got = self._cover(words[lo:hi])
            got = got[0], got[1], got[2] + lo, got[3] + lo
            best = max(best, got, key=lambda x: (x[0] >= COVERAGE and x[1] >= DENSITY, x[0], x[1], -x[2]))
            if best[0] == 1.0 and best[1] == 1.0:
                break
        return best

    def _cover(self, words: list[bytes]) -> tuple[float, float, int, int]:
        pairs = align(words, self.words)
        # Stray words far from the rest do not belong to it: drop ends while that makes it denser and coverage holds.
        while len(pairs) > COVERAGE * len(self.words) + 1 and len(pairs) < DENSITY * (pairs[-1][0] - pairs[0][0] + 1):
            pairs = pairs[1:] if pairs[1][0] - pairs[0][0] > pairs[-1][0] - pairs[-2][0] else pairs[:-1]
        if not pairs:
            return 0.0, 0.0, 0, 0
        first, last = pairs[0][0], pairs[-1][0] + 1
        return len(pairs) / len(self.words), len(pairs) / (last - first), first, last


def _scan(templates: dict[str, str]):
    def run(batches):
        known = [Template(k, v) for k, v in templates.items()]
        every = set().union(*(t.vocabulary for t in known)) if known else set()
        for b in batches:
            rows = []
            for d, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                words = word_list(text)
                some = every.intersection(words)
                found = []
                for t in known:
                    # Different words are fewer than words: a necessary condition for the coverage.
                    missing = sum(t.words.count(w) for w in t.vocabulary - some)
                    if missing <= (1 - COVERAGE) * len(t.words) + 1e-9:
                        c = t.cover(words)
                        if c[0] >= COVERAGE and c[1] >= DENSITY:
                            found.append({"license": t.name, "coverage": c[0], "density": c[1], "start_word": c[2], "end_word": c[3]})
                rows.append((d, sorted(found, key=lambda f: (-f["coverage"] * f["density"], f["start_word"], f["license"]))))
            kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("density", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32())]))
            yield pa.record_batch({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "found": pa.array([f for _, f in rows], kind)})

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, n_licenses, license (the best, or null), coverage, licenses (all, with density and place).

    Null, empty and blank texts have none.  Whole texts are read.  Ties go to the earlier place, then to the name.
    Null doc_ids and rows that repeat give a row each; other columns are ignored.
    """
    session(docs.sparkSession)
    kind = "array<struct<license:string,coverage:double,density:double,start_word:int,end_word:int>>"
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(templates), f"doc_id long, found {kind}")
    best = F.get("found", F.lit(0))
    return out.select("doc_id", F.size("found").cast("long").alias("n_licenses"), best["license"].alias("license"), F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), F.col("found").alias("licenses"))


def op3_license_scans(spark, sf_dir):
    """Every whole text of documents against all templates."""
    return scan_licenses(table(spark, sf_dir, "documents"))
