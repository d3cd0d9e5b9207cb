"""License scans by conditional compression.

Each license template is the raw-content dictionary of a Zstandard compressor. A candidate block that holds
a template shrinks far more with it than without. The templates are ranked by that reduction; those that save
too little for a copy of theirs are out, the others are confirmed in the order of the ranking by the exact words
in which block and template differ, and the first one confirmed is the block's. Of matches of several blocks
that overlap, the largest reduction wins.

Blocks are found by cue words that the templates themselves give, and do no more than say where to look. A match
within ``d`` differing words has all but ``d`` of a template's words, so it holds one of its ``d`` + 1 longest,
and no match is lost by cutting blocks only around those. What a template has to save is half of the least that
copies of it save with as many words changed as are allowed; tests measure the recall against comparing all.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words

#: License notices as their publishers word them, by SPDX identifier and form.
TEMPLATES = {
    "MIT:notice": "Released under the MIT License.",
    "Apache-2.0:notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0:notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0:notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0:notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0:notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0:header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT:text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "Apache-2.0:header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-or-later:header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause:text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC:text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


class Scanner:
    """Finds every place where a template stands with at most ``max_diff_pct`` of its words, one at least, differing."""

    def __init__(self, templates: dict[str, str] | None = None, max_diff_pct: int = 10, level: int = 3):
        templates = TEMPLATES if templates is None else templates
        self.words = {k: alnum_words(v.encode()) for k, v in sorted(templates.items())}
        self.words = {k: v for k, v in self.words.items() if v}
        self.most = {k: max(1, len(v) * max_diff_pct // 100) for k, v in self.words.items()}
        #: word -> templates that it is a cue of, and its places in each
        self.cues: dict[bytes, dict[str, list[int]]] = {}
        for k, v in self.words.items():
            for w in sorted(set(v), key=lambda w: (-len(w), w))[: self.most[k] + 1]:
                self.cues.setdefault(w, {})[k] = [i for i, x in enumerate(v) if x == w]
        make = zstandard.ZstdCompressor
        self.plain = make(level=level, write_content_size=False)
        self.given = {
            k: make(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(b" ".join(v), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for k, v in self.words.items()
        }
        self.least = {k: self._least(k) for k in self.words}

    def _least(self, name: str) -> int:
        """Bytes that a block has to save to be compared: half of what the worst changed copies save."""
        words, most = self.words[name], self.most[name]
        step = max(1, len(words) // most)
        copies = [
            b" ".join(x for i, w in enumerate(words) for x in (own if i % step == at and i // step < most else [w]))
            for at in range(step) for own in ([], [b"#~"])
        ]
        return min(self.saving(c, name) for c in copies) // 2

    def rank(self, words: list[bytes], cue: int) -> list[tuple[int, str, int]]:
        """(bytes saved, template, place) of the blocks that a cue word gives, largest saving first, without those
        that save too little: a block is where a template would stand if the cue were its word at that place."""
        plain: dict[tuple, tuple] = {}
        ranked = []
        for name, places in self.cues[words[cue]].items():
            size, most = len(self.words[name]), self.most[name]
            for at in places:
                ends = max(0, cue - at - most), cue - at + size + most
                if ends not in plain:
                    block = b" ".join(words[ends[0] : ends[1]])
                    plain[ends] = block, len(self.plain.compress(block))
                block, alone = plain[ends]
                saved = alone - len(self.given[name].compress(block))
                if saved >= self.least[name]:
                    ranked.append((saved, name, at))
        return sorted(ranked, key=lambda x: (-x[0], x[1], x[2]))

    def saving(self, data: bytes, name: str) -> int:
        return len(self.plain.compress(data)) - len(self.given[name].compress(data))

    def difference(self, name: str, words: list[bytes], cue: int, at: int):
        """(start, end, template words missing, words added) of the match with the template's word ``at`` on the cue, or None."""
        want, most = self.words[name], self.most[name]
        right = _extend(want[at + 1 :], words[cue + 1 : cue + 1 + len(want) + most], most)
        if right is None:
            return None
        left = _extend(want[:at][::-1], words[max(0, cue - len(want) - most) : cue][::-1], most - right[0])
        return left and (cue - left[1], cue + 1 + right[1], left[2][::-1] + right[2], left[3][::-1] + right[3])

    def scan(self, text: bytes | None):
        """Confirmed matches in text order: (first word, words, template, bytes saved, missing, added).

        Of matches that overlap, the one with the largest saving stays; ties go to fewer differences, then to
        the template's name.
        """
        words = alnum_words(text)
        found = []
        for cue, word in enumerate(words):
            for _, name, at in self.rank(words, cue) if word in self.cues else ():
                d = self.difference(name, words, cue, at)
                if d:
                    # Of the block's saving, what the words of the match themselves account for.
                    found.append((d[0], d[1], name, self.saving(b" ".join(words[d[0] : d[1]]), name), d[2], d[3]))
                    break
        out: list[tuple] = []
        for m in sorted(found, key=lambda m: (-m[3], len(m[4]) + len(m[5]), m[2], m[0])):
            if all(m[1] <= o[0] or o[1] <= m[0] for o in out):
                out.append(m)
        return [(a, b - a, *rest) for a, b, *rest in sorted(out)]


def _extend(want: list[bytes], have: list[bytes], most: int):
    """(differences, words of ``have`` used, missing, added) that lead through all of ``want`` with the fewest, or None.

    ``have`` may go on after the match. Furthest points are kept for each number of differences and each
    diagonal, so the work grows with the differences allowed and not with the product of the lengths.
    """
    def slide(i: int, j: int) -> int:
        while i < len(want) and j < len(have) and want[i] == have[j]:
            i, j = i + 1, j + 1
        return i

    front = {0: (slide(0, 0), None)}  # words of have less words of want -> words of want done, the step before
    for d in range(most + 1):
        ends = [(k, step) for k, step in front.items() if step[0] == len(want)]
        if ends:
            k, step = min(ends, key=lambda x: x[0])
            missing, added, used = [], [], len(want) + k
            while step[1] is not None:
                is_missing, word, step = step[1]
                (missing if is_missing else added).append(word)
            return d, used, missing[::-1], added[::-1]
        after: dict[int, tuple] = {}
        for k, step in sorted(front.items()):
            i, j = step[0], step[0] + k
            if i < len(want):
                after[k - 1] = max(after.get(k - 1, (-1, None)), (slide(i + 1, j), (True, want[i], step)), key=lambda x: x[0])
            if j < len(have):
                after[k + 1] = max(after.get(k + 1, (-1, None)), (slide(i, j + 1), (False, have[j], step)), key=lambda x: x[0])
        front = after
    return None


def load_templates(templates: DataFrame, most_bytes: int = 8 << 20) -> dict[str, str]:
    """``templates(name, text)`` as a mapping for ``scan_licenses``; names read ``license:form``.

    The texts go to every task, so more than ``most_bytes`` of them are an error. Null names and texts are ignored.
    """
    rows = templates.where("name is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of templates, at most {most_bytes}")
    return {r["name"]: r["text"] for r in rows.select("name", "text").orderBy("name", "text").collect()}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", max_diff_pct: int = 10) -> DataFrame:
    """(id_col, start_word, n_words, license, form, bytes_saved, missing, added, exact), one row for each notice found.

    Words are the lower-cased runs of letters and digits. A block reaches as far as its template would around
    the cue word, and by the words allowed to differ on either side, in whole texts. Null, empty and cueless texts give no rows, and an empty table
    none; other columns are ignored; repeated rows and ids repeat their matches, null ids keep theirs.
    ``missing`` and ``added`` are the template's words that the text lacks and those it has besides. The
    built-in templates are short notices and headers; give whole license texts by ``load_templates``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns = [("start_word", pa.int64()), ("n_words", pa.int64()), ("name", pa.string()), ("bytes_saved", pa.int64()), ("missing", pa.string()), ("added", pa.string())]

    def run(batches):
        scanner = Scanner(templates, max_diff_pct)
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for m in scanner.scan(text):
                    rows.append((*m[:4], b" ".join(m[4]).decode(), b" ".join(m[5]).decode()))
                    at.append(i)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            cols = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=["id", *(n for n, _ in columns)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(run, f"id {kind}, start_word long, n_words long, name string, bytes_saved long, missing string, added string")
    return found.select(
        F.col("id").alias(id_col), "start_word", "n_words",
        F.substring_index("name", ":", 1).alias("license"), F.substring_index("name", ":", -1).alias("form"),
        "bytes_saved", "missing", "added", ((F.col("missing") == "") & (F.col("added") == "")).alias("exact"),
    )
