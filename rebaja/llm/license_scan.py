"""License texts in documents: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

Windows of a size class hold twice the shingles of a template chunk of that
class and start every chunk length, so any chunk lies whole inside some window,
at a similarity of a third or more even when a fifth of its shingles differ.
With bands of one row, a pair at 0.33 shares one of 24 with probability
1 - 0.67^24 > 0.9999.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rebaja.llm.common import U64, light_slices, texts

WORDS, CONTAINED, BANDS = 5, 0.8, 24
#: Shingles of a template chunk, by size class: a template is cut into chunks of the largest class it fills.
CLASSES = (1, 4, 16)
WORD = re.compile("[a-z0-9]+")

# Public license notices and the lines that name a license.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "lgpl-notice": "under the terms of the GNU Lesser General Public License as published by",
    "agpl-notice": "under the terms of the GNU Affero General Public License as published by",
    "lgpl-line": "This work is licensed under the GNU Lesser General Public License.",
    "agpl-line": "This work is licensed under the GNU Affero General Public License.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-line": "Released under the CC0 1.0 Universal Public Domain Dedication.",
    "cc-by-nd-4.0-line": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "boost-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "boost-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl-3.0": "SPDX-License-Identifier: GPL-3.0",
    "spdx-bsd-3-clause": "SPDX-License-Identifier: BSD-3-Clause",
}
SCHEMA = "doc_id bigint, license string, containment double, first_word bigint, n_shingles bigint"


def words_of(text: str) -> list[str]:
    """Runs of a-z and 0-9 after A-Z have become lower case; nothing else is folded."""
    return WORD.findall(text.translate(_LOWER))


_LOWER = {c: c + 32 for c in range(65, 91)}


class Hasher:
    """Hashes of word shingles from hashes of words; the words' hashes are kept while they fit."""

    def __init__(self, limit: int = 500_000):
        import xxhash
        self.digest, self.limit, self.known = xxhash.xxh3_64_intdigest, limit, {}

    def shingles(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        for word in set(words) - known.keys():
            known[word] = self.digest(word)
        h = np.fromiter(map(known.__getitem__, words), U64, len(words))
        out = np.zeros(max(0, len(h) - WORDS + 1), U64)
        for k in range(WORDS):
            out = (out ^ h[k:k + len(out)]) * U64(0x9E3779B97F4A7C15)
            out ^= out >> U64(29)
        return out

    def of_texts(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of many texts in a row, and where those of each end."""
        words = [words_of(t) for t in texts_]
        sizes = np.array([len(w) for w in words])
        every = self.shingles([w for ws in words for w in ws])
        first = np.cumsum(sizes) - sizes
        inside = np.zeros(len(every) + 1, np.int64)  # +1 where a text's shingles begin, -1 where they end
        n = np.maximum(sizes - WORDS + 1, 0)
        np.add.at(inside, first[n > 0], 1)
        np.add.at(inside, (first + n)[n > 0], -1)
        return every[np.cumsum(inside[:-1]) > 0], np.cumsum(n)


class Templates:
    """Chunks of the templates by size class, and the bands of their MinHash."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS):
        rng = np.random.default_rng(3)
        self.mult = rng.integers(1, 1 << 63, bands, dtype=np.uint64) | U64(1)
        hasher = Hasher()
        self.names = list(templates)
        self.sets = [np.unique(hasher.shingles(words_of(t))) for t in templates.values()]
        self.bands: dict[int, list[dict[int, set[int]]]] = {c: [{} for _ in range(bands)] for c in CLASSES}
        for k, text in enumerate(templates.values()):
            s = hasher.shingles(words_of(text))
            if not len(s):
                raise ValueError(f"{self.names[k]} has fewer than {WORDS} words")
            size = max(c for c in CLASSES if c <= len(s))
            for at in range(0, len(s) - size + 1, size):
                for band, m in enumerate(self.mult):
                    self.bands[size][band].setdefault(int((s[at:at + size] * m).min()), set()).add(k)
        self.used = {c: [np.array(sorted(b), U64) for b in self.bands[c]] for c in CLASSES if any(self.bands[c])}  # keys in order

    def retrieve(self, s: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """(document, template) pairs that share a band in some window; ``ends``: where each document's shingles end in ``s``."""
        begins = np.r_[0, ends[:-1]]
        found: set[tuple[int, int]] = set()
        windows = {}
        for size in self.used:
            n = -(-(ends - begins) // size)
            doc = np.repeat(np.arange(len(ends)), n)
            starts = begins[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * size
            windows[size] = doc, starts, np.flatnonzero(doc[1:] == doc[:-1])
        for band, m in enumerate(self.mult):
            mixed = s * m
            for size, keys in self.used.items():
                doc, starts, on = windows[size]
                low = mixed if size == 1 else np.minimum.reduceat(mixed, starts)
                wide = low.copy()
                wide[on] = np.minimum(low[on], low[on + 1])  # two chunk lengths, every chunk length
                near = np.flatnonzero(wide <= keys[band][-1])
                at = np.searchsorted(keys[band], wide[near])
                near = near[keys[band][at] == wide[near]]
                for k, key in zip(doc[near].tolist(), wide[near].tolist()):
                    found.update((k, t) for t in self.bands[size][band][key])
        return sorted(found)

    def verify(self, s: np.ndarray, k: int) -> tuple[float, int, int]:
        """Share of the template's shingles that the document holds, the word where the first stands, and how many."""
        own = self.sets[k]
        at = np.flatnonzero(np.isin(s, own))
        held = len(np.unique(s[at]))
        return held / len(own), int(at[0]) if len(at) else -1, held


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document and license found in it: containment, first word, shingles shared.

    A license is found when the document holds at least ``CONTAINED`` of the
    different 5-word shingles of its template. Documents with fewer than five
    words, null or empty ones have none. Rows with one doc_id or one text are
    separate rows of the result; other columns are left behind, so names cannot
    clash. Whole texts are read, once, without a shuffle, some megabytes at a
    time or one longer text; the templates are a parameter of fixed size.
    """
    templates = templates or TEMPLATES

    def scan(batches):
        known, hasher = Templates(templates), Hasher()
        for batch in light_slices(batches, 1):
            s, ends = hasher.of_texts(batch.column(1).to_pylist())
            ids, begins, rows = batch.column(0).to_pylist(), np.r_[0, ends[:-1]], []
            for doc, k in known.retrieve(s, ends) if len(s) else ():
                share, first, held = known.verify(s[begins[doc]:ends[doc]], k)
                if share >= CONTAINED:
                    rows.append((ids[doc], known.names[k], share, first, held))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return texts(docs).mapInArrow(scan, SCHEMA)


def _sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    shingle = "[array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]"
    fold = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    return f"""WITH t AS (SELECT license, unnest(list_distinct({shingle})) AS s FROM (SELECT license, {fold.format('text')} AS w FROM (VALUES {rows}) AS v(license, text))),
    n AS (SELECT license, count(*) AS n FROM t GROUP BY license),
    d AS (SELECT row_number() OVER () AS r, doc_id, {fold.format("coalesce(text, '')")} AS w FROM documents),
    s AS (SELECT r, doc_id, unnest({shingle}) AS s, unnest(range(0, greatest(len(w) - 4, 0))) AS pos FROM d)
    SELECT any_value(doc_id) AS doc_id, license, count(DISTINCT s.s) / any_value(n.n)::DOUBLE AS containment, min(pos) AS first_word, count(DISTINCT s.s) AS n_shingles
    FROM s JOIN t USING (s) JOIN n USING (license) GROUP BY r, license HAVING count(DISTINCT s.s) >= {CONTAINED} * any_value(n.n)"""


SQL = _sql()
