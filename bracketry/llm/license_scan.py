"""License scan: MinHash bands over overlapping windows retrieve license templates, exact shingle containment verifies them.

Templates of like size share windows half as long again as the largest of them, half its length apart, so each possible
place lies whole in some window. If a window holds 80 % of a template's shingles, their Jaccard similarity is at least
0.8 m / (L + 0.2 m) for m shingles of the template and L of the window, 0.32 or more within a size class; with BANDS
bands of one row a window misses it with a probability of 0.68 ** BANDS, 4e-11 for 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.llm.common import sliced, table, texts, tidy
from bracketry.llm.jaccard_join import Words, _mix

SHINGLE, CONTAINED, BANDS = 5, 0.8, 64

# fixed values: license names and the texts by which they are known
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c == 46 else 32 for c in range(256))
_words = Words()


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased; ASCII marks but inner dots part them."""
    return [s for w in text.translate(_TABLE).split() if (s := w.strip(b"."))]


def shingle_row(words: list[bytes]) -> np.ndarray:
    """One hash for each place; of fewer words than a shingle, one for all of them."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    m = min(SHINGLE, n)
    x = _mix(w[: n - m + 1] + np.uint64(m))
    for j in range(1, m):
        x = _mix((x ^ (x << np.uint64(1))) + w[j : n - m + 1 + j])
    return x


class Index:
    """The templates by size class: their shingle sets, and which template has which band value."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        self.sets = [np.unique(shingle_row(tokens(t.encode()))) for _, t in templates]
        self.turns = []  # of each shingle of a set, in its order: where it first comes in the template
        for (_, t), own in zip(templates, self.sets, strict=True):
            row = shingle_row(tokens(t.encode()))
            self.turns.append(np.array([int(np.flatnonzero(row == h)[0]) for h in own], np.int64))
        self.seeds = [np.uint64(int(_mix(np.array([k + 1], np.uint64))[0])) for k in range(BANDS)]
        self.all = np.unique(np.concatenate(self.sets)) if self.sets else np.empty(0, np.uint64)
        self.classes: dict[int, list[int]] = {}  # largest size of the class -> its templates
        for k, s in enumerate(self.sets):
            if len(s):
                self.classes.setdefault(1 << (len(s) - 1).bit_length(), []).append(k)

    def windows(self, n: int, m: int) -> tuple[np.ndarray, int]:
        """Starts and length of the windows over n places for templates of up to m shingles."""
        step = (m + 1) // 2
        return np.arange(0, max(1, n - m + step), step), m + step

    def find(self, text: bytes) -> list[dict]:
        """name, template, start, end (places of shingles), containment of each occurrence of each template; occurrences that follow each other are told apart."""
        x = shingle_row(tokens(text))
        if not len(x) or not len(self.all):
            return []
        # a window's least band value equals a template's only where a shingle of it is: other windows can't be retrieved
        known = self.all[np.minimum(np.searchsorted(self.all, x), len(self.all) - 1)] == x
        if not known.any():
            return []
        out = []
        for m, members in self.classes.items():
            starts, size = self.windows(len(x), m)
            total = np.concatenate([[0], np.cumsum(known)])
            ends = np.minimum(starts + size, len(x))
            live = np.flatnonzero(total[ends] > total[starts])
            hit: dict[int, list[tuple[int, int]]] = {}  # template -> stretches of windows that hold it
            for at in live:
                s, e = int(starts[at]), int(ends[at])
                window = np.unique(x[s:e])
                keys = [int(_mix(window ^ seed).min()) for seed in self.seeds]
                for k in members:
                    if any(a == b for a, b in zip(keys, self.keys(k), strict=True)) and len(np.intersect1d(self.sets[k], window, assume_unique=True)) >= CONTAINED * len(self.sets[k]):
                        got = hit.setdefault(k, [])
                        if got and s <= got[-1][1]:
                            got[-1] = (got[-1][0], e)
                        else:
                            got.append((s, e))
            out += [{"license": self.names[k], "template": k, "start": a, "end": b, "containment": c} for k, rs in hit.items() for s, e in rs for a, b, c in self.places(k, x, s, e)]
        return sorted(out, key=lambda r: (r["start"], r["template"]))

    def places(self, k: int, x: np.ndarray, s: int, e: int) -> list[tuple[int, int, float]]:
        """Start, end and containment of each occurrence of template k between s and e. One ends where the text goes back
        by half of the template or more, or is outside of it for its whole length."""
        own, turn = self.sets[k], self.turns[k]
        at = np.flatnonzero(own[np.minimum(np.searchsorted(own, x[s:e]), len(own) - 1)] == x[s:e]) + s
        to = turn[np.searchsorted(own, x[at])]
        half, runs, first, far = max(1, len(own) // 2), [], 0, -1
        for j in range(len(at)):
            if j > first and (to[j] <= far - half or at[j] - at[j - 1] > len(own)):
                runs.append((first, j))
                first, far = j, -1
            far = max(far, int(to[j]))
        runs.append((first, len(at)))
        out = []
        for a, b in runs:
            c = len(np.unique(to[a:b])) / len(own)
            if c >= CONTAINED:
                out.append((int(at[a]), int(at[b - 1]) + 1, c))
        if not out:  # the windows hold it, but not in this order: the whole stretch
            out.append((int(at[0]), int(at[-1]) + 1, len(np.unique(to)) / len(own)))
        return out

    def keys(self, k: int) -> list[int]:
        if not hasattr(self, "_keys"):
            self._keys = {}
        if k not in self._keys:
            self._keys[k] = [int(_mix(self.sets[k] ^ seed).min()) for seed in self.seeds]
        return self._keys[k]


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id and matches (license, template, start, end, containment) of every row; null and empty texts have none."""
    templates = TEMPLATES if templates is None else templates
    kind = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([index.find(t) for t in texts(batch)], kind)], names=["doc_id", "matches"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, matches array<struct<license:string,template:int,start:int,end:int,containment:double>>")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("containment"))
