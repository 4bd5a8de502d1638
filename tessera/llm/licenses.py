"""License notices by conditional compression: a block of text that a template explains shrinks when the template is the
zstd dictionary. Templates are ranked by how much they shrink a block, and the best ones confirmed word by word."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices by SPDX identifier, as their publishers word them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.",),
}
_TOKEN = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def tokens(text: str) -> list[str]:
    """Words for the wording check: case, punctuation and spacing aside; 2.0 and BY-NC are one word each."""
    return [w.lower() for w in _TOKEN.findall(text)]


class Cues:
    """Words by which texts that may hold a notice are found. Of a template in which t words may differ, t + 1 different words are cues:
    t edits leave one of them, so no notice within the tolerance is missed. The longest words are taken, which are the rarest."""

    def __init__(self, templates: dict[str, tuple[str, ...]], tolerance: float):
        self.words: set[str] = set()
        longest, widest = 1, 1
        for ts in templates.values():
            for t in ts:
                own = tokens(t)
                self.words.update(sorted(set(own), key=lambda w: (-len(w), w))[: int(tolerance * len(own) + 1e-9) + 1])
                longest, widest = max(longest, len(own)), max(widest, len(t))
        self.around = max(60, int(longest * (1 + tolerance)) + 2)
        self.chars = max(40 * self.around, 2 * widest)
        self.found = ahocorasick.Automaton()
        for w in self.words:
            self.found.add_word(w, len(w))
        if self.words:
            self.found.make_automaton()

    def places(self, text: str) -> list[tuple[int, int]]:
        """Where cues start and end, in order. A text whose lower case has another length is lowered character by character, where that keeps it."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        return sorted({(end + 1 - n, end + 1) for end, n in self.found.iter(low)}) if self.words else []


def blocks(text: str, cues: Cues, gap: int = 25) -> list[tuple[int, int]]:
    """Candidate spans: as many words to each side of every cue as the longest template can have, across line ends, spans less than `gap`
    characters apart joined. Only texts with a cue are looked at; they are looked at whole."""
    spans: list[list[int]] = []
    around = cues.around
    for start, end in cues.places(text):
        # so many characters at most, so that a line of a megabyte isn't split for each cue
        inside = spans and start < spans[-1][1]
        left = [] if inside else [w.start() for w in _TOKEN.finditer(text, max(0, start - cues.chars), start)]
        right = [w.end() for w in _TOKEN.finditer(text, end, min(len(text), end + cues.chars))] if not inside or end + cues.chars > spans[-1][1] else []
        a = left[-around] if len(left) > around else left[0] if left else start
        b = right[around] if len(right) > around else right[-1] if right else end
        if spans and a - spans[-1][1] < gap:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans if b > a]


def wording(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """Least word edits that turn some run of the block into the template, and where that run starts and ends (the shortest such run)."""
    n = len(block)
    ids: dict[str, int] = {}
    b = np.array([ids.setdefault(w, len(ids)) for w in block], np.int64)
    at = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), at.copy()
    for k, w in enumerate(template, 1):
        diagonal = cost[:-1] + (b != ids.get(w, -1))
        new, origin = cost + 1, start.copy()
        better = (diagonal < new[1:]) | ((diagonal == new[1:]) & (start[:-1] > origin[1:]))
        new[1:][better], origin[1:][better] = diagonal[better], start[:-1][better]
        # insertions run along the row: the least of new[j] - j so far, the latest of equals
        key = new - at
        least = np.minimum.accumulate(key)
        source = np.maximum.accumulate(np.where(key == least, at, 0))
        cost, start = least + at, origin[source]
    end = int(np.lexsort((at - start, cost))[0])
    return int(cost[end]), int(start[end]), end


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], level: int, top: int, tolerance: float, least_reduction: float):
        self.names = [(k, t) for k, ts in templates.items() for t in ts]
        self.words = [tokens(t) for _, t in self.names]
        self.counted = [Counter(ws) for ws in self.words]
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.primed = []
        for _, t in self.names:
            d = zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.primed.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))
        self.top, self.tolerance, self.least = top, tolerance, least_reduction

    def match(self, block: str) -> list[tuple]:
        """(license, template number, reduction, word edits, words of the template) of each confirmed notice, in their order.
        The best one's wording is taken out, and what is left before and after it is matched again."""
        out, parts = [], [(0, len(block))]
        while parts:
            a, b = parts.pop()
            if found := self.best(block[a:b]):
                best, start, end = found
                out.append((a + start, best))
                parts += [(a, a + start), (a + end, b)]
        return [best for _, best in sorted(out)]

    def best(self, block: str) -> tuple[tuple, int, int] | None:
        """The confirmed winner and where its wording starts and ends, or None."""
        spans = [m.span() for m in _TOKEN.finditer(block)]
        own = [block[a:b].lower() for a, b in spans]
        counts = Counter(own)
        # words of a template that the block lacks are an edit each, at least
        able = [k for k, ws in enumerate(self.counted) if (ws - counts).total() <= self.tolerance * len(self.words[k])]
        if not able:
            return None
        data = block.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(data))
        saving = {k: alone - len(self.primed[k].compress(data)) for k in able}
        # templates that save alike are all confirmed, so that the ranking never breaks a tie by chance
        floor = sorted(saving.values(), reverse=True)[min(self.top, len(able)) - 1]
        confirmed = []
        for k in able:
            if saving[k] < floor or saving[k] <= 0 or saving[k] < self.least * min(alone, len(self.names[k][1])):
                continue
            edits, start, end = wording(self.words[k], own)
            if edits <= self.tolerance * len(self.words[k]):
                confirmed.append(((edits / len(self.words[k]), -len(self.words[k]), -saving[k], k), edits, start, end))
        if not confirmed:
            return None
        (_, _, _, k), edits, start, end = min(confirmed)
        best = (self.names[k][0], int(k), float(saving[k] / alone), edits, len(self.words[k]))
        # longer wordings of the same license around it are the same notice
        same = [(s, e) for (_, _, _, j), _, s, e in confirmed if self.names[j][0] == best[0] and s < end and e > start]
        start, end = min(s for s, _ in same), max(e for _, e in same)
        return best, spans[start][0], spans[end - 1][1]


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, level: int = 9, top: int = 6, tolerance: float = 0.1, least_reduction: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each notice of a block that a template explains: id, license, start and end of the block (code points), reduction
    (share that the template saves of the compressed size of the block, or of what other notices leave of it), n_edits (words that differ from the template's wording),
    n_words (of the template), exact.

    Each notice that is confirmed is taken out and the rest matched again, so a block with several gives a row for each. A
    template is confirmed where at most `tolerance` of its words differ; among the `top` templates by saving (and all that
    tie with the last of them) the one with the least differences wins, then the longest. Texts are looked at around the
    templates' own cue words (see Cues), so any templates work; a template without a word is never found. Null and empty texts and texts
    without a notice give no row; repeated rows give theirs each; empty tables give an empty one; other columns are not
    read. A map, no shuffle.
    """
    templates = templates or TEMPLATES
    schema = "id long, license string, start long, end long, reduction double, n_edits long, n_words long, exact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, cues = Scanner(templates, level, top, tolerance, least_reduction), Cues(templates, tolerance)
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    for a, b in blocks(text, cues):
                        for m in scanner.match(text[a:b]):
                            rows.append((batch.column(0)[k].as_py(), m[0], a, b, m[2], m[3], m[4], m[3] == 0))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()))], names=["id", "license", "start", "end", "reduction", "n_edits", "n_words", "exact"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
