"""License scans by conditional compression: which template makes a block of text cheapest to write."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import read

#: Public license notices and statements, (license, wording).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: A line with one of these is a cue. What lies around cues, as far as the longest notice reaches, is searched.
CUE = r"(?i)licen[cs]e|copyright|permission is hereby|permission notice|redistribut|warrant(?:y|ies)|public domain|creative commons|\bcc0?[ -]by|spdx"
#: Words of a block, besides what it shares with the next one so that no notice is cut.
BLOCK = 400
#: Words of a run by which a notice is found; templates whose wording is compared where none is confirmed,
#: best first; words that may differ: this share of the template's.
RUN, WINNERS, DIFFER = 3, 3, 0.1
#: Runs of matching words at either end that may be left out of a notice.
EDGES = 4
#: Templates of a table that go to every task at most.
MOST_TEMPLATES = 5_000
_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def reach(templates) -> int:
    """Words that the longest notice may have."""
    return max((int((1 + DIFFER) * len(words(t))) + 1 for _, t in templates), default=0)


def blocks(text: str, far: int):
    """``(words, places, begin, within, cues)`` of the parts of a text within ``far`` words of a cue.

    ``places`` are the words' offsets in the text. A part is dealt to blocks of BLOCK words, from ``begin``
    to before ``within``, with the ``far`` words that follow and the share of those that may differ before
    them: a notice is whole in the block in which it begins, and too short to be confirmed in the next.
    ``cues`` are the offsets of a block's lines with cues. So the work on a text grows with its length alone.
    """
    lines, at = text.split("\n"), 0
    cue, spans = re.compile(CUE), []
    starts = []
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    for i, line in enumerate(lines):
        if not cue.search(line):
            continue
        if spans and i <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], i)
            spans[-1][2].append(i)
        else:
            spans.append([i, i, [i]])
    grown: list[list] = []
    for a, z, cued in spans:
        for step, end in ((-1, -1), (1, len(lines))):
            n, i = 0, a if step < 0 else z
            while i + step != end and n < far:
                i += step
                n += len(lines[i].split())
            a, z = (i, z) if step < 0 else (a, i)
        if grown and a <= grown[-1][1]:
            grown[-1][1] = max(z, grown[-1][1])
            grown[-1][2] += cued
        else:
            grown.append([a, z, cued])
    for a, z, cued in grown:
        found = list(_WORD.finditer(text, starts[a], starts[z] + len(lines[z])))
        own, places = [m[0].lower() for m in found], [m.span() for m in found]
        begins, cue_starts = [p[0] for p in places], [starts[i] for i in cued]
        for k in range(0, max(len(own), 1), BLOCK):
            last = k + BLOCK + far >= len(own)
            low = starts[cued[0]] if k == 0 else begins[k]
            high = starts[cued[-1]] + 1 if last else begins[k + BLOCK]
            lead = min(k, int(DIFFER * far) + 1)
            yield own[k - lead : k + BLOCK + far], places[k - lead : k + BLOCK + far], lead, lead + (len(own) - k if last else BLOCK), cue_starts[bisect_left(cue_starts, low) : bisect_left(cue_starts, high)]
            if last:
                break


def aligned(block: list[str], template: list[str]) -> tuple[int, int, int, int]:
    """``(missing, added, first, last)``: words of the template that the block lacks, words it has between those that match,
    and where these begin and end. A few words that match far outside the rest are left out if that differs less."""
    same = [m for m in SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return len(template), 0, 0, 0
    best = None
    for i in range(min(EDGES, len(same))):
        for j in range(len(same), max(i, len(same) - EDGES), -1):
            matched, first, last = sum(m.size for m in same[i:j]), same[i].a, same[j - 1].a + same[j - 1].size
            missing, added = len(template) - matched, last - first - matched
            found = (max(missing, added), missing + added, missing, added, first, last)
            best = min(best, found) if best else found
    return best[2:]


def wording(block: list[str], template: list[str]) -> tuple[int, int]:
    """Missing and added words of ``aligned``."""
    return aligned(block, template)[:2]


class Templates:
    """Templates, their words, and where each run of RUN words (all words of a shorter one) stands in them."""

    def __init__(self, templates):
        self.texts = [t for _, t in templates]
        self.names = [n for n, _ in templates]
        self.words = [words(t) for t in self.texts]
        self.runs: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for k, w in enumerate(self.words):
            n = min(RUN, len(w))
            for i in range(len(w) - n + 1 if w else 0):
                self.runs[tuple(w[i : i + n])].append((k, i))
        self.sizes = sorted({min(RUN, len(w)) for w in self.words if w})

    def places(self, own: list[str]) -> dict[int, list[int]]:
        """For each template the starts, in order, at which enough of its runs say that it may stand in ``own``.

        Each different word breaks RUN runs at most, and moves those behind it by one; so starts are
        counted together if no more apart than words may differ.
        """
        starts = defaultdict(list)
        for n in self.sizes:
            for i in range(len(own) - n + 1):
                for k, j in self.runs.get(tuple(own[i : i + n]), ()):
                    starts[k].append(i - j)
        out = {}
        for k, at in starts.items():
            m = len(self.words[k])
            slack = int(DIFFER * m)
            enough = max(1, m - min(RUN, m) + 1 - 2 * RUN * slack)
            at.sort()
            places, i = [], 0
            while i < len(at):
                j = bisect_right(at, at[i] + 2 * slack, i)
                if j - i >= enough:
                    places.append(at[i:j][(j - i) // 2])
                    i = j
                else:
                    i += 1
            if places:
                out[k] = places
        return out


def confirmed(own: list[str], known: Templates, size_of: dict[int, int], begin: int, within: int) -> list[tuple[int, int, int, int, int]]:
    """``(template, missing, added, first, last)`` of the templates in ``size_of`` whose wording stands in a block, words ``first``
    to before ``last``, once each, where it begins at one of the block's own words, from ``begin`` to before ``within``.

    Of matches that overlap the one with the smallest share of differences stands, then the smallest size.
    """
    found = []
    for k, places in known.places(own).items():
        if k not in size_of:
            continue
        template = known.words[k]
        m, slack = len(template), int(DIFFER * len(template))
        for s in places:
            if 0 <= s and own[s : s + m] == template:
                found.append((0.0, size_of[k], k, s, s + m, 0, 0))
                continue
            a, z = max(0, s - slack), max(0, s) + m + 2 * slack
            missing, added, first, last = aligned(own[a:z], template)
            if last and max(missing, added) <= DIFFER * m:
                found.append(((missing + added) / m, size_of[k], k, a + first, a + last, missing, added))
    taken: list[tuple[int, int]] = []
    out: dict[int, tuple] = {}
    for _, _, k, first, last, missing, added in sorted(found):
        i = bisect_left(taken, (first, last))
        if (i and taken[i - 1][1] > first) or (i < len(taken) and taken[i][0] < last):
            continue
        taken.insert(i, (first, last))
        if begin <= first < within and (k not in out or first < out[k][3]):
            out[k] = (k, missing, added, first, last)
    return sorted(out.values(), key=lambda x: x[3])


def templates_of(table: DataFrame, most: int = MOST_TEMPLATES) -> tuple[tuple[str, str], ...]:
    """Templates from a table ``(license, text)``, in order; more than ``most`` raise an error, as all go to every task."""
    rows = table.where("text IS NOT NULL").select("license", "text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    return tuple(sorted((r["license"], r.text) for r in rows))


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row ``(doc_id, first_line, last_line, license, template, plain_bytes, given_bytes, missing, added, confirmed, block)``
    for each template confirmed in a block around cues; a block with cues and none of them has one row, with its best template.

    ``templates`` are pairs of license and wording, or a table of them. A block is written as its words, so
    wrapping, comment marks and case do not matter; ``plain_bytes`` is that compressed alone,
    ``given_bytes`` with the template's words as raw dictionary. The templates with any reduction are
    compared word by word where their runs of words stand; one is confirmed if missing and added words
    are at most a tenth of its words. Where several fit the same words, the one with the fewest
    differences stands (the larger reduction among equals). Of a block that confirms none, the WINNERS
    largest reductions are compared. Lines and ``block`` are those of the notice, or of the block's
    words from its first line with a cue to its last. A notice that repeats within a block has one row. Texts without a cue, empty or null,
    give no row; documents without cues never leave the JVM. Repeated rows repeat theirs; extra columns
    take no part. The work grows with the length of a text.
    """
    templates = templates_of(templates) if isinstance(templates, DataFrame) else tuple(templates)

    def run(batches):
        import zstandard as zs

        known, far = Templates(templates), reach(templates)
        plain = zs.ZstdCompressor(level=6, write_content_size=False)
        given = [zs.ZstdCompressor(level=6, write_content_size=False, dict_data=zs.ZstdCompressionDict(" ".join(w).encode(), dict_type=zs.DICT_TYPE_RAWCONTENT)) if w else plain for w in known.words]
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                breaks = [m.start() for m in re.finditer("\n", text)]
                at = lambda first, end, text=text, breaks=breaks: (bisect_left(breaks, first), bisect_left(breaks, end - 1), text[first:end])  # noqa: E731  line numbers and text of a stretch

                for own, places, begin, within, cues in blocks(text, far):
                    raw = " ".join(own).encode("utf-8", "surrogatepass")
                    size = len(plain.compress(raw))
                    sizes = [len(c.compress(raw)) for c in given]
                    sure = confirmed(own, known, {k: n for k, n in enumerate(sizes) if n < size}, begin, within)
                    for k, missing, added, first, last in sure:
                        a, z, notice = at(places[first][0], places[last - 1][1])
                        out.append((doc_id, a, z, templates[k][0], k, size, sizes[k], missing, added, True, notice))
                    if sure or not cues or not known.sizes:
                        continue
                    ranked = sorted((k for k, w in enumerate(known.words) if w), key=lambda k: (sizes[k], k))[:WINNERS]
                    differ = {k: wording(own, known.words[k]) for k in ranked}
                    best = min(ranked, key=lambda k: (sum(differ[k]) / len(known.words[k]), sizes[k], k))
                    end = text.find("\n", cues[-1])
                    a, z, part = at(max(cues[0], places[begin][0]), max(min(end if end >= 0 else len(text), places[within - 1][1]), places[begin][1])) if own else at(cues[0], cues[0] + 1)
                    out.append((doc_id, a, z, templates[best][0], best, size, sizes[best], *differ[best], False, part))
                if len(out) >= 1000:
                    yield rows(out)
                    out = []
            yield rows(out)

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("license", pa.string()), ("template", pa.int32()), ("plain_bytes", pa.int32()), ("given_bytes", pa.int32()), ("missing", pa.int32()), ("added", pa.int32()), ("confirmed", pa.bool_()), ("block", pa.string())])
    cued = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("text").rlike(CUE))
    return cued.mapInArrow(run, "doc_id long, first_line int, last_line int, license string, template int, plain_bytes int, given_bytes int, missing int, added int, confirmed boolean, block string")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices in all ``documents``; see ``scan_licenses``."""
    return scan_licenses(read(spark, sf_dir, "documents")).withColumn("block_sha256", F.sha2("block", 256)).drop("block")
