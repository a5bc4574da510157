"""License scans by conditional compression.

Documents fall into paragraphs, up to blank lines; those with a cue (a word that
every template has one of) in a line are candidate blocks. Equal blocks are
scanned once. In a block, the windows that have most of a template's words in
order are compressed with the template as raw zstandard dictionary, and ranked
by the bytes that this saves. The best is a notice if its exact wording says so:
of the words that it lacks and adds, none may tell licenses apart (names and
versions: mit, gpl, by-nc, 3.0) or deny (not), be it in the window or right before
it. The scan goes on with the words that are left until nothing is confirmed, so
all notices of a block are reported, each with the template's words that it lacks
and those that it adds. A window whose wording differs in such a word, and that no
template confirms, is reported as ``unknown``. Lines of SPDX name all their licenses.

Cases: null and empty texts have no block; a block can be as long as its text;
equal rows report alike; notices that save alike go to the one with fewer
differences, then to the first by name; an empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialise

UNKNOWN = "unknown"
#: Notices by the name of their license.
TEMPLATES = {
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "ISC": "Released under the ISC License.",
    "MIT": "Released under the MIT License.",
    "Proprietary": "All rights reserved.",
    **{f"Apache-{v}": f"Licensed under the Apache License, Version {v}." for v in ("2.0", "1.1")},
    **{f"EPL-{v}": f"Licensed under the Eclipse Public License, Version {v}." for v in ("2.0", "1.0")},
    **{f"MPL-{v}": f"This work is licensed under the Mozilla Public License, version {v}." for v in ("2.0", "1.1")},
    **{f"{name}-{v}": f"This work is licensed under the GNU {kind}General Public License, version {v}."
       for name, kind, versions in (("AGPL", "Affero ", ("3.0",)), ("GPL", "", ("3.0", "2.0")), ("LGPL", "Lesser ", ("3.0", "2.1"))) for v in versions},
    **{f"CC-{kind}-{v}": f"Licensed under CC {kind} {v}."
       for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for v in ("4.0", "3.0", "2.5", "2.0")},
}
_LONG = {"BY": "Attribution", "SA": "ShareAlike", "ND": "NoDerivatives", "NC": "NonCommercial"}
#: Paragraphs of full texts and of the headers of files, and other forms, by license.
MORE = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
                   "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("BSD-3-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
                     "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
                     "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
            "the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
            "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
            "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *((name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as "
             "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
      for name, kind in (("AGPL-3.0", "Affero "), ("GPL-3.0", ""), ("LGPL-3.0", "Lesser "))),
    *((name, f"This work is licensed under a Creative Commons {'-'.join(_LONG[k] for k in name.split('-')[1:-1])} {name.rsplit('-', 1)[1]} International License.")
      for name in TEMPLATES if name.startswith("CC-")),
]
#: Words that tell licenses apart, beside versions: one that is missing or added makes it another one.
NAMES = frozenset(
    "affero agpl apache artistic bsd boost by-nc by-nc-nd by-nc-sa by-nd by-sa cc cc0 cddl eclipse epl eupl gpl isc lesser lgpl library mit mozilla mpl "
    "unlicense wtfpl zlib attribution sharealike noderivatives noncommercial never no non not".split())
VERSION = re.compile(r"\d{1,2}(?:\.\d+)*")
#: Words before a notice, in its sentence, that may deny it.
BEFORE, DENIALS = 8, frozenset("never no non not without".split())
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)", re.I)
CUE = r"(?i)licen[cs]e|copyright|all rights reserved|public domain|redistribution|spdx|creative commons|warrant(?:y|ies)|permission notice"
#: Share of the template's words that a confirmed window has in order, and words that it may have besides (half the template's, at least these).
COVERED, SLACK = 0.8, 8
LEVEL = 3
TOKEN = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")


def blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start (number of the first line), block: paragraphs, up to blank lines, in which a line has a cue."""
    rows = docs.where(F.coalesce(F.col(text).rlike(CUE), F.lit(False))).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("block", T.StringType())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cue = re.compile(CUE)
        for batch in batches:
            at, starts, found = [], [], []
            for i, value in enumerate(batch.column(1)):
                run: list[str] = []
                opened = False
                for k, line in enumerate([*value.as_py().split("\n"), ""]):
                    if line.strip():
                        run.append(line)
                        opened = opened or cue.search(line) is not None
                        continue
                    if opened:
                        at.append(i)
                        starts.append(k - len(run))
                        found.append("\n".join(run))
                    run, opened = [], False
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(found, pa.string())],
                names=[f.name for f in schema.fields])

    return rows.mapInArrow(runs, schema)


def word(token: str) -> str:
    """A token in lower case; versions are told by their numbers: v2.0 and 2 are one word."""
    token = token.lower()
    number = token[1:] if token[:1] == "v" and token[1:2].isdigit() else token
    if VERSION.fullmatch(number):
        while number.endswith(".0"):
            number = number[:-2]
        return number
    return token


def words_of(text: str) -> list[str]:
    return [word(w) for w in TOKEN.findall(text)]


def marks(words) -> set[str]:
    """Those of the words that tell licenses apart, or deny."""
    parts = {p for w in words for p in (w, *(w.split("-") if w not in NAMES else ()))}
    return {w for w in parts if w in NAMES or VERSION.fullmatch(w)}


class Template:
    def __init__(self, name: str, text: str):
        import zstandard

        data = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.name, self.words = name, words_of(text)
        self.known, self.marks = frozenset(self.words), marks(self.words)
        # Templates of one or two words are matched whole.
        self.slack = max(SLACK, len(self.words) // 2) if len(self.words) > 2 else 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)
        #: The wording without what tells licenses apart: templates with the same are variants of one notice.
        self.shape = tuple(w for w in self.words if not marks([w]))


class Window(NamedTuple):
    """Words ``first`` to ``last`` of a block beside a template."""

    first: int
    last: int
    missing: list[str]
    added: list[str]
    template: Template


class Scanner:
    """Ranks the windows of a block by the bytes that templates save, and confirms them by their wording."""

    def __init__(self, templates: list[tuple[str, str]]):
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = [Template(name, text) for name, text in sorted(templates)]
        shapes: dict[tuple, Template] = {}
        for t in self.given:
            shapes.setdefault(t.shape, t)
        self.shapes = list(shapes.values())
        self.ids = {name.lower(): name for name, _ in templates}

    def windows(self, has: list[str | None], template: Template) -> Iterator[Window]:
        """Windows that have most of the template's words in order and nothing that is taken."""
        words, slack = template.words, template.slack
        ours = np.fromiter((w in template.known for w in has), "int64", len(has))
        if ours.sum() < COVERED * len(words):
            return
        sums = np.r_[0, np.cumsum(ours)]
        width = len(words) + slack
        starts = np.arange(len(has))
        enough = np.flatnonzero(sums[np.minimum(starts + width, len(has))] - sums[starts] >= COVERED * len(words))
        # A window that begins with a word of the template, so that its alignment has all the slack behind it.
        for start in enough[ours[enough] > 0].tolist():
            window = has[start:start + width]
            same = [m for m in SequenceMatcher(None, words, window, autojunk=False).get_matching_blocks() if m.size]
            matched = sum(m.size for m in same)
            if not matched or matched < COVERED * len(words):
                continue
            first, last = same[0].b, same[-1].b + same[-1].size
            inside = {k for m in same for k in range(m.b, m.b + m.size)}
            taken = {k for m in same for k in range(m.a, m.a + m.size)}
            added = [window[k] for k in range(first, last) if k not in inside]
            if None not in added:
                yield Window(start + first, start + last, [w for k, w in enumerate(words) if k not in taken], added, template)

    @staticmethod
    def confirmed(window: Window, before: list[str]) -> bool:
        """Whether the wording differs in nothing that tells licenses apart; ``before``: the words before it in its sentence."""
        return not marks(window.missing) and not marks(window.added) and DENIALS.isdisjoint(before)

    def scan(self, block: str) -> list[tuple[int, str, int, float, list[str], list[str]]]:
        """Line, name, bytes saved, share of the template's words, missing and added words of every notice in ``block``."""
        tokens = list(TOKEN.finditer(block))
        places = [(m.start(), m.end()) for m in tokens]
        breaks = np.array([k for k, c in enumerate(block) if c == "\n"], "int64")
        line = np.searchsorted(breaks, [a for a, _ in places]).tolist()
        has: list[str | None] = [word(m.group()) for m in tokens]
        text, out = list(has), self._spdx(block, places, line, has)
        notices: list[tuple[Window, str]] = []

        def before(at: int) -> list[str]:
            low = at
            while low and at - low < BEFORE and not set(".;:!?") & set(block[places[low - 1][1]:places[low][0]]):
                low -= 1
            return text[low:at]

        def ranked(templates: list[Template]) -> list[Window]:
            found = [w for t in templates for w in self.windows(has, t)]
            saved = {id(w): self._saved(block[places[w.first][0]:places[w.last - 1][1]], w.template) for w in found}
            return sorted(found, key=lambda w: (-saved[id(w)], len(w.missing) + len(w.added), w.template.name, w.first, w.last))

        def take(window: Window, name: str) -> None:
            notices.append((window, name))
            has[window.first:window.last] = [None] * (window.last - window.first)

        taken = -1
        while taken < len(notices):
            taken = len(notices)
            here = marks(w for w in has if w is not None)
            # A template with a mark that the block lacks cannot be confirmed.
            for window in ranked([t for t in self.given if t.marks <= here]):
                if None not in has[window.first:window.last] and self.confirmed(window, before(window.first)):
                    take(window, window.template.name)
        for window in ranked(self.shapes):
            if None not in has[window.first:window.last] and DENIALS.isdisjoint(before(window.first)):
                take(window, UNKNOWN)
        for window, name in notices:
            # Other words of the lines it stands on, within the slack and outside of other notices.
            low, high, slack = window.first, window.last, window.template.slack
            while low and window.first - low < slack and line[low - 1] == line[window.first] and has[low - 1] is not None:
                low -= 1
            while high < len(has) and high - window.last < slack and line[high] == line[window.last - 1] and has[high] is not None:
                high += 1
            saved = self._saved(block[places[low][0]:places[high - 1][1]], window.template)
            out.append((line[window.first], name, saved, 1 - len(window.missing) / len(window.template.words), window.missing,
                        text[low:window.first] + window.added + text[window.last:high]))
        return sorted(out, key=lambda x: x[:2])

    def _spdx(self, block: str, places: list[tuple[int, int]], line: list[int], has: list[str | None]) -> list[tuple]:
        """A row per license of each SPDX line; its words are taken out of ``has``."""
        out = []
        for found in SPDX.finditer(block):
            inside = [k for k, (a, _) in enumerate(places) if found.start() <= a < found.end()]
            for name in TOKEN.findall(re.sub(r"(?i)\bwith\s+\S+", " ", found.group(1))):
                if name.lower() in ("or", "and"):
                    continue
                plain = re.sub(r"(?i)(-only|-or-later)$", "", name).lower()
                known = self.ids.get(plain, UNKNOWN)
                template = Template(known, f"SPDX-License-Identifier: {known}")
                out.append((line[inside[0]], known, self._saved(found.group().strip(), template), 1.0, [], [] if known != UNKNOWN else [name.lower()]))
            for k in inside:
                has[k] = None
        return out

    def _saved(self, window: str, template: Template) -> int:
        data = window.encode("utf-8", "replace")
        return len(self.plain.compress(data)) - len(template.compressor.compress(data))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, block, license, saved, covered, missing, added: one row per confirmed notice; start is its first line."""
    found = materialise(blocks(docs, doc_id, text).withColumn("block_key", F.md5("block")), "license-blocks")
    schema = "block_key string, line long, license string, saved long, covered double, missing array<string>, added array<string>"
    given = [*TEMPLATES.items(), *MORE] if templates is None else list(templates.items())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given)
        for batch in batches:
            rows = [(k.as_py(), *s) for k, b in zip(batch.column(0), batch.column(1)) for s in scanner.scan(b.as_py())]
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["block_key", "line", "license", "saved", "covered", "missing", "added"])

    distinct = found.groupBy("block_key").agg(F.first("block").alias("block"))
    judged = materialise(distinct.mapInArrow(judge, schema), "license-judged")
    return found.join(judged, "block_key").withColumn("start", F.col("start") + F.col("line")).drop("block_key", "line")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "start", "license", "saved", F.round("covered", 6).alias("covered"),
                        F.array_join("missing", " ").alias("missing"), F.array_join("added", " ").alias("added"))
