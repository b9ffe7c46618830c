"""License scans by conditional compression.

Candidate blocks lie around every three words in a row that some template has: a notice that keeps nine tenths of
a template's words keeps such a run, so nothing is overlooked. A block is compressed with each template whose
words it holds as a raw zstandard dictionary; by the reduction in size the templates are ranked, and confirmed by
the exact differences in wording, which must leave the terms as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import ngram_hashes, small_batches, text_slices, word_hashes

#: Wordings of public licences and notices, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
    "LicenseRef-All-Rights-Reserved": ("All rights reserved.",),
}
#: Words that change the terms; a difference in one of them, or in a number, is never accepted.
TERM_WORDS = frozenset("nc nd sa noncommercial noderivatives sharealike lesser affero not no mit bsd isc apache mozilla gnu cc cc0 neither nor".split())
#: Share of a template's words that may be missing, and words inside the match that may be added.
MISSING, EXTRA = 0.1, 0.1
#: Words of a seed. With so few words missing and added, a run of three stays: 0.9 n words in at most 0.2 n + 1 runs.
SEED_WORDS = 3
#: Bytes of text hashed at once (a longer text alone), and rows.
HASH_BYTES, HASH_ROWS = 500_000, 1000
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: A list number at a line's start; added ones change no terms.
_ITEM = re.compile(r"\s*\(?(\d{1,2})[.)](?=\s)")


class Finding(NamedTuple):
    first_line: int
    last_line: int
    license: str
    reduction: float
    n_missing: int
    n_extra: int


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _fixed(word: str) -> bool:
    """Whether a difference in this word is never accepted."""
    return word in TERM_WORDS or any(c.isdigit() for c in word)


class Scanner:
    """Templates as dictionaries of compressors; verdicts of repeated blocks are remembered (bounded)."""

    def __init__(self) -> None:
        import zstandard as z

        self.templates = [(name, _words(t)) for name, forms in TEMPLATES.items() for t in forms]
        options = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = z.ZstdCompressor(**options)
        self.with_dict = [
            z.ZstdCompressor(dict_data=z.ZstdCompressionDict((" ".join(w) + " ").encode(), dict_type=z.DICT_TYPE_RAWCONTENT), **options)
            for _, w in self.templates
        ]
        self.seeds = {tuple(w[k : k + SEED_WORDS]) for _, w in self.templates for k in range(len(w) - SEED_WORDS + 1)}
        self.counts = [Counter(w) for _, w in self.templates]
        self.terms = [Counter({w: n for w, n in c.items() if _fixed(w)}) for c in self.counts]
        self.reach = math.ceil((1 + EXTRA) * max(len(w) for _, w in self.templates))
        self.judge = lru_cache(maxsize=2_000)(self._judge)

    def reduction(self, k: int, block: tuple[str, ...]) -> float:
        """Share of a block's compressed size that a template saves."""
        data = (" ".join(block) + " ").encode()
        return 1 - len(self.with_dict[k].compress(data)) / len(self.plain.compress(data))

    def _judge(self, block: tuple[str, ...], items: frozenset[int]) -> list[tuple[int, int, str, float, int, int]]:
        """(first word, last word, licence, reduction, missing, added) of the notices in a block, in order.

        Of passages that overlap, the one that covers most words of its template counts.
        """
        found = []
        have = Counter(block)
        for k, (name, words) in enumerate(self.templates):
            if any(have[w] < n for w, n in self.terms[k].items()) or sum(min(n, have[w]) for w, n in self.counts[k].items()) < (1 - MISSING) * len(words):
                continue
            slack = math.ceil(EXTRA * len(words)) + len(items)
            matcher = SequenceMatcher(None, block, words, autojunk=False)
            open_ = [(0, len(block))]
            while open_:
                lo, hi = open_.pop()
                if hi - lo < (1 - MISSING) * len(words):
                    continue
                m = matcher.find_longest_match(lo, hi, 0, len(words))
                if not m.size:
                    continue
                a, b = max(lo, m.a - m.b - slack), min(hi, m.a - m.b + len(words) + slack)
                own = differences(words, block[a:b], frozenset(x - a for x in items if a <= x < b))
                if own and (saved := self.reduction(k, block[a + own[2] : a + own[3]])) > 0:
                    found.append((-(len(words) - own[0] - own[1]), -saved, k, a + own[2], a + own[3], name, saved, own[0], own[1]))
                    open_ += [(lo, a + own[2]), (a + own[3], hi)]
                else:
                    open_ += [(lo, m.a), (m.a + m.size, hi)]
        taken: list[tuple[int, int, str, float, int, int]] = []
        used = bytearray(len(block))
        for *_, a, b, name, saved, missing, extra in sorted(found):
            if not any(used[a:b]):
                used[a:b] = b"\1" * (b - a)
                taken.append((a, b - 1, name, saved, missing, extra))
        return sorted(taken)

    def scan(self, text: str | None) -> list[Finding]:
        words: list[str] = []
        line_of: list[int] = []
        items: list[int] = []
        blocks: list[list[int]] = []
        for k, line in enumerate((text or "").split("\n")):
            own = _words(line)
            if own and _ITEM.match(line):
                items.append(len(words))
            words += own
            line_of += [k] * len(own)
        numbers = set(items)
        place = [k for k in range(len(words)) if k not in numbers]
        bare = [words[k] for k in place]
        for k, seed in enumerate(zip(bare, bare[1:], bare[2:])):
            if seed in self.seeds:
                lo, hi = max(0, place[k] - self.reach), place[k] + SEED_WORDS + self.reach
                if blocks and lo <= blocks[-1][1]:
                    blocks[-1][1] = hi
                else:
                    blocks.append([lo, hi])
        out: list[Finding] = []
        for lo, hi in blocks:
            found = self.judge(tuple(words[lo:hi]), frozenset(x - lo for x in items if lo <= x < hi))
            out.extend(Finding(line_of[lo + a], line_of[lo + b], *rest) for a, b, *rest in found)
        return out


def differences(template: list[str], block: Sequence[str], items: frozenset[int] = frozenset()) -> tuple[int, int, int, int] | None:
    """(template words missing, words added inside the match, first and end word), or None if the wording differs too much.

    items: places of list numbers, which may be added.
    """
    parts = [m for m in SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks() if m.size]
    if not parts:
        return None
    first, end = parts[0].a, parts[-1].a + parts[-1].size
    hit = {k for m in parts for k in range(m.b, m.b + m.size)}
    hit_a = {k for m in parts for k in range(m.a, m.a + m.size)}
    missing = [w for k, w in enumerate(template) if k not in hit]
    extra = [block[k] for k in range(first, end) if k not in hit_a and k not in items]
    if len(missing) > MISSING * len(template) or len(extra) > EXTRA * len(template) or any(map(_fixed, missing + extra)):
        return None
    return len(missing), len(extra), first, end


def seed_hashes() -> np.ndarray:
    """Hashes of all seeds, sorted, of words without case and ASCII punctuation: a quick look at whole batches."""
    texts = [t for forms in TEMPLATES.values() for t in forms]
    hashes, _, _, counts = word_hashes(texts, plain=True)
    return np.unique(np.concatenate([ngram_hashes(w, SEED_WORDS) for w in np.split(hashes, np.cumsum(counts)[:-1])]))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence notices of every document: doc_id, first_line, last_line (from 0), license, reduction, n_missing,
    n_extra, exact. One row per notice; documents without notices, null and empty texts give none. Of templates
    that fit the same words the one that covers most of its own counts, on a tie the one that saves more, then
    the first. Whole texts are read, very long ones by themselves. Repeated rows give their findings each; an
    empty table gives an empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    kinds = {"first_line": pa.int64(), "last_line": pa.int64(), "license": pa.string(), "reduction": pa.float64(), "n_missing": pa.int64(), "n_extra": pa.int64()}
    own = [T.LongType(), T.LongType(), T.StringType(), T.DoubleType(), T.LongType(), T.LongType()]
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)] + [T.StructField(n, t) for n, t in zip(kinds, own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, seeds = Scanner(), seed_hashes()
        for piece, raw in text_slices(batches, HASH_BYTES, HASH_ROWS):
            hashes, _, _, counts = word_hashes(raw, plain=True)
            found = ngram_hashes(hashes, SEED_WORDS)
            at = np.searchsorted(seeds, found)
            at[at == len(seeds)] = 0
            seen = np.unique(np.searchsorted(np.cumsum(counts), np.flatnonzero(seeds[at] == found), side="right"))
            rows = [(int(k), *f) for k in seen for f in scanner.scan(raw[k].decode())]
            columns = [piece.column(0).take(pa.array([r[0] for r in rows], pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds.values())], names=["doc_id", *kinds])

    return source.mapInArrow(run, schema).withColumn("exact", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))
