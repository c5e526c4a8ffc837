"""Licence scan: TF-IDF cosine to templates, then inheritance along paths.

Every line, sentence and paragraph of every text, and licence files as a whole,
is a sparse TF-IDF vector that is compared with licence templates. A paragraph
ends at a line without a word, so a header comment that is wrapped over lines
is seen whole. Document frequencies are those of the template collection, and
a word that no template holds weighs as the rarest, so a result depends on the
file alone. A file without a licence of its own takes that of the nearest
ancestor directory that holds a licence file.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, bounded_batches, chunks, trim
from quern.llm.decontaminate import tokens
from quern.plans.materialize import materialize

#: Cosine from which a unit of text has a template's licence.
COSINE = 0.6
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"

# Licence identifiers, and the words of licences and of the notices that stand in
# file headers. The third entry names words that must be there: they tell a licence from its siblings.
_GNU_HEADER = (
    "This program is free software{mark} you can redistribute it and/or modify it under the terms of the {name} "
    "as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."
)
_GNU_REST = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program."
)
_AS_IS = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THREE = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
)
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_END = (
    " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
    "either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_END = (
    " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any means."
)
_GNU = (
    ("GPL-2.0", "GNU General Public License", "2", ";", "June 1991", ("general",)),
    ("GPL-3.0", "GNU General Public License", "3", ":", "29 June 2007", ("general",)),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", ";", "February 1999", ("lesser",)),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", ":", "29 June 2007", ("lesser",)),
    ("AGPL-3.0", "GNU Affero General Public License", "3", ":", "19 November 2007", ("affero",)),
)
_CREATIVE = (
    ("CC-BY-4.0", "CC BY 4.0", "Attribution 4.0 International", ("by",)),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Attribution-ShareAlike 4.0 International", ("sa",)),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Attribution-NonCommercial 4.0 International", ("nc",)),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0", "Attribution-NoDerivatives 4.0 International", ("nd",)),
)
_NAMED = (
    ("MIT", "MIT License", ("mit",)),
    ("Apache-2.0", "Apache License, Version 2.0", ("apache", "2.0")),
    ("BSD-2-Clause", "BSD 2-Clause License", ("bsd", "2")),
    ("BSD-3-Clause", "BSD 3-Clause License", ("bsd", "3")),
    ("MPL-2.0", "Mozilla Public License, version 2.0", ("mozilla", "2.0")),
    ("ISC", "ISC License", ("isc",)),
    ("Zlib", "zlib License", ("zlib",)),
    ("BSL-1.0", "Boost Software License, Version 1.0", ("boost", "1.0")),
)
_TEXTS = (
    ("MIT", _MIT_GRANT, ()),
    ("MIT", _MIT_GRANT + _MIT_NOTICE, ()),
    ("MIT", _MIT_GRANT + _MIT_NOTICE + _AS_IS, ()),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_TWO, ()),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_TWO + _BSD_END, ()),
    ("BSD-3-Clause", _BSD_THREE, ("endorse",)),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_TWO + _BSD_THREE, ("endorse",)),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_TWO + _BSD_THREE + _BSD_END, ("endorse",)),
    ("ISC", _ISC, ()),
    ("Apache-2.0", _APACHE, ("apache", "2.0")),
    ("Apache-2.0", _APACHE + _APACHE_END, ("apache", "2.0")),
    ("MPL-2.0", _MPL, ("mozilla", "2.0")),
    ("MPL-2.0", _MPL + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("mozilla", "2.0")),
    ("Unlicense", _UNLICENSE, ("unencumbered",)),
    ("Unlicense", _UNLICENSE + _UNLICENSE_END, ("unencumbered",)),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal.", ("cc", "0")),
    ("CC0-1.0", "CC0 1.0 Universal", ("cc", "0")),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", ("apache", "2.0")),
)


def _templates() -> tuple[tuple[str, str, tuple[str, ...]], ...]:
    out = list(_TEXTS)
    for name, title, needs in _NAMED:
        out += [(name, x.format(title), (*needs, "license")) for x in ("{}", "The {}", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.")]
    for name, title, version, mark, date, needs in _GNU:
        needs = (*needs, version, "license")
        out += [(name, x.format(title, version), needs) for x in ("Licensed under the {}, version {}.", "This work is licensed under the {}, version {}.", "Released under the {}, version {}.", "{} version {}")]
        out += [(name, f"{title} Version {version}, {date}", needs)]
        for comma in ("; ", ","):
            head = _GNU_HEADER.format(name=title, version=version, mark=mark, comma=comma)
            out += [(name, head, needs), (name, head + _GNU_REST.format(name=title), needs)]
    for name, short, long, needs in _CREATIVE:
        out += [(name, x.format(short), (*needs, "4.0", "cc")) for x in ("{}", "Licensed under {}.", "This work is licensed under {}.")]
        out += [(name, f"This work is licensed under a Creative Commons {long} License.", tuple(long.lower().replace("-", " ").split()[:-1]))]
        out += [(name, f"Creative Commons {long} Public License", tuple(long.lower().replace("-", " ").split()[:-1]))]
    names = sorted({x[0] for x in out})
    gnu = {x[0] for x in _GNU}
    for name in names:
        for tail in ("", "-only", "-or-later") if name in gnu else ("",):
            out.append((name, f"SPDX-License-Identifier: {name}{tail}", ("spdx", *_words(name))))
    return tuple(out)


def _words(text: str) -> list[str]:
    """The tokens of a text as words."""
    raw = text.encode()
    _, _, _, first = tokens([raw])
    ends = [*first[1:].tolist(), len(raw)]
    return [raw[a:b].decode().strip(" -(),;:./\"").lower() for a, b in zip(first.tolist(), ends)]


class Matcher:
    """Templates as unit TF-IDF vectors over their own vocabulary."""

    def __init__(self, templates: tuple[tuple[str, str, tuple[str, ...]], ...]):
        # the first of equal cosines wins, so names ascend
        templates = tuple(sorted(templates, key=lambda x: x[0]))
        self.names = [x[0] for x in templates]
        counts = [Counter(tokens([text.encode()])[0].tolist()) for _, text, _ in templates]
        self.vocabulary = np.array(sorted({h for c in counts for h in c}), np.uint64)
        at = {h: k for k, h in enumerate(self.vocabulary.tolist())}
        df = np.zeros(len(at))
        for c in counts:
            df[[at[h] for h in c]] += 1
        self.idf = np.log((1 + len(templates)) / (1 + df)) + 1
        self.rare = math.log(1 + len(templates)) + 1
        self.weights = np.zeros((len(at), len(templates)))
        self.needs = np.zeros((len(at), len(templates)), np.int64)
        for k, (c, (_, _, needs)) in enumerate(zip(counts, templates)):
            for h, n in c.items():
                self.weights[at[h], k] = (1 + math.log(n)) * self.idf[at[h]]
            for word in needs:
                self.needs[at[int(tokens([word.encode()])[0][0])], k] = 1
        self.weights /= np.maximum(np.sqrt((self.weights**2).sum(0)), 1e-12)
        self.needed = self.needs.sum(0)

    def score(self, h: np.ndarray, unit: np.ndarray, cosine: float) -> Iterator[tuple[int, float, int]]:
        """(unit, cosine, template) of units of tokens that reach ``cosine``; ``unit`` ascends."""
        if not len(h):
            return
        _, code = np.unique(h, return_inverse=True)
        pair, count = np.unique(unit * (int(code.max()) + 1) + code, return_counts=True)
        own = pair // (int(code.max()) + 1)
        word = np.zeros(int(code.max()) + 1, np.uint64)
        word[code] = h
        word = word[pair % (int(code.max()) + 1)]
        at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == word
        x = (1 + np.log(count)) * np.where(known, self.idf[at], self.rare)
        whole, inside = np.bincount(own, x * x), np.bincount(own[known], (x * x)[known], int(own[-1]) + 1)
        # no cosine is greater than the share of the length that lies in the vocabulary
        near = np.flatnonzero((inside > 0) & (inside >= cosine * cosine * whole * (1 - 1e-9)))
        keep = np.flatnonzero(known & np.isin(own, near))
        cut = np.concatenate([[0], np.flatnonzero(np.diff(own[keep])) + 1]) if len(keep) else keep
        for k in range(0, len(near), 256):  # a bounded matrix at once
            a, b = cut[k], cut[k + 256] if k + 256 < len(cut) else len(keep)
            rows = keep[a:b]
            dots = np.add.reduceat(x[rows, None] * self.weights[at[rows]], cut[k : k + 256] - a) / np.sqrt(whole[near[k : k + 256], None])
            dots[np.add.reduceat(self.needs[at[rows]], cut[k : k + 256] - a) < self.needed] = 0
            best = dots.argmax(1)
            for u, t, c in zip(near[k : k + 256].tolist(), best.tolist(), dots[np.arange(len(best)), best].tolist()):
                if c >= cosine:
                    yield u, min(c, 1.0), t


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Token hashes, the text of each, and the number of its line, sentence and paragraph.

    A line without a token ends a paragraph; a sentence ends there and at a mark before white space.
    """
    h, _, own, first = tokens(texts)
    b = np.frombuffer(b"\n".join(texts) + b"\n\n", np.uint8)
    line = np.cumsum(b == 10)[first]
    mark = np.isin(b[:-1], [33, 46, 58, 59, 63]) & np.isin(b[1:], [9, 10, 11, 12, 13, 32])
    stop = np.cumsum(mark)[first]
    other = np.concatenate([[0], np.diff(own) != 0]).astype(bool)
    paragraph = np.cumsum(np.concatenate([[0], np.diff(line) > 1]).astype(bool) | other)
    sentence = np.cumsum(np.concatenate([[0], np.diff(stop) != 0]).astype(bool) | np.concatenate([[0], np.diff(paragraph) != 0]).astype(bool))
    return h, own, {"line": np.cumsum(np.concatenate([[0], np.diff(line) != 0])), "sentence": sentence, "paragraph": paragraph}


def best_licenses(matcher: Matcher, texts: list[bytes], whole: np.ndarray, cosine: float) -> tuple[list[str | None], np.ndarray]:
    """Licence of each text and its cosine; ties go to the smaller name. ``whole`` marks texts compared as a whole, too."""
    names: list[str | None] = [None] * len(texts)
    scores = np.zeros(len(texts))
    for i, j in chunks(texts):
        h, own, kinds = units(texts[i:j])
        if not len(h):
            continue
        if whole[i:j].any():
            kinds["text"] = np.where(whole[i:j][own], own, -1)
        for unit in kinds.values():
            some = unit >= 0
            text = np.zeros(int(unit.max()) + 2, np.int64)
            text[unit[some]] = own[some]
            for u, c, t in matcher.score(h[some], unit[some], cosine):
                k, name = i + int(text[u]), matcher.names[t]
                if c > scores[k] or c == scores[k] and name < (names[k] or name + "~"):
                    scores[k], names[k] = c, name
    return names, scores


def _scan(matcher: Matcher, cosine: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.array(batch.column("is_file").to_pylist(), bool)
            own, score = best_licenses(matcher, as_bytes(batch.column("text")), whole, cosine)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("path"), batch.column("is_file"), pa.array(own, pa.string()), pa.array(score)], ["id", "path", "is_file", "own", "cosine"])
        trim()

    return of


TEMPLATES = _templates()


def scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", *, templates: tuple[tuple[str, str, tuple[str, ...]], ...] = TEMPLATES, cosine: float = COSINE, is_file: Column | None = None) -> DataFrame:
    """Licence of each file: (id, path, license, origin, cosine, license_dir).

    origin is ``own`` where a line, sentence or paragraph (or the text of a
    licence file) has a cosine to a template of at least ``cosine`` and holds
    the words that the template needs, ``inherited`` where the nearest
    directory at or above the file with a licence file gives one, else
    ``none``. The template with the largest cosine counts, then the smaller
    name; cosine is 0 where none is reached. Licence files are told by their
    name, or by ``is_file``. Of several licence files in one directory the
    largest cosine counts, then the smaller name.

    Null and empty texts have no licence of their own; a null path inherits
    none. Repeated rows get equal results. Whole texts are scanned, however
    long. Other columns are ignored. An empty table gives an empty result.
    """
    bounded_batches(files.sparkSession)
    matcher = Matcher(templates)
    named = F.coalesce(F.element_at(F.split(path, "/"), -1).rlike(LICENSE_FILE), F.lit(False))
    marked = named if is_file is None else named | F.coalesce(is_file, F.lit(False))
    src = files.select(F.col(id_col).cast("long").alias("id"), path.alias("path"), marked.alias("is_file"), F.col(text_col).cast("string").alias("text"))
    own = materialize(src.mapInArrow(_scan(matcher, cosine), "id long, path string, is_file boolean, own string, cosine double"), "licenses")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    own = own.withColumn("dir", folder)
    held = own.where("is_file and own is not null and dir is not null").groupBy("dir").agg(F.min_by("own", F.struct(-F.col("cosine"), F.col("own"))).alias("dir_license"))
    # each directory meets its ancestors once, however many files it has
    part = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(part)), lambda k: F.array_join(F.slice(part, 1, k), "/"))
    dirs = own.where("own is null and dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("up"))
    near = dirs.join(held.select(F.col("dir").alias("up"), "dir_license"), "up")
    near = near.groupBy("dir").agg(F.max_by("dir_license", F.length("up")).alias("dir_license"), F.max_by("up", F.length("up")).alias("license_dir"))
    out = own.join(near, "dir", "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return out.select(F.col("id").alias(id_col), "path", F.coalesce("own", "dir_license").alias("license"), origin.alias("origin"), "cosine", F.when(F.col("own").isNull(), F.col("license_dir")).alias("license_dir"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents, each a file in its source's tree.

    The table has no paths: a document lies in a folder of its source for each
    hundred ids, and counts as that folder's licence file where its text is
    little more than a notice.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    notice = F.col("text").rlike(r"(?i)licen[sc]|copyright|public domain") & (F.length("text") < 400)
    return scan(docs, path, is_file=notice)
