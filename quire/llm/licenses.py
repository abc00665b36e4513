"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Templates are short notices, headers of several lines and titles, and the full texts in
``license_texts``. A text with a marker word is compared with all of them as a whole. Besides,
every run of its lines and sentences that holds a marker and is about as long as a template is
compared with that one, full texts up to ``SHORT`` words included. Vectors are sparse TF-IDF
over word tokens, the inverse document frequency taken over the templates of a kind, tokens outside
them at the highest weight. A template is left out where the words around a marker can't reach the
threshold, which is an exact bound. The best run at ``line_at`` or more is the file's own license
(``header``; a reservation of all rights only where nothing else is found); a whole text at
``file_at`` or more is a license file (``file``) and speaks for its directory.
A file without a license of its own takes that of the nearest ancestor directory with a
license file (``inherited``). Directories are joined by path: distinct directories are
expanded to their ancestors, so the join's size follows directories, not files; a directory
with over a thousandth of all files meets a broadcast and is in no one task.

Cases: a null or empty text has no license of its own. Null paths inherit nothing. Of several
license files in a directory the best score counts, then the first by license and path. Equal
scores within a text go to the first template by name. Repeated rows are each returned. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from importlib.resources import files as resources

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import join_counted, materialise

MARKERS = ("licen", "copyright", "rights reserved", "spdx", "public domain")
# fixed values: short public license notices
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"
    ],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"
    ],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
    "public-domain": ["This work is released into the public domain.", "Licensed under CC0 1.0 Universal."],
}
_GNU = (
    "This {it} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {version}, or (at your option) any later version.",
    " This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.",
    " You should have received a copy of the GNU {name} along with this {it}. If not, see <https://www.gnu.org/licenses/>.",
)


def _gnu(name: str, version: str, it: str = "program") -> list[str]:
    """The whole header, and its first paragraph alone."""
    return [text.format(it=it, colon=":", name=name, version=version) for text in ("".join(_GNU), _GNU[0])]


# fixed values: the standard headers and titles
HEADERS = {
    "AGPL-3.0": [
        *_gnu("Affero General Public License", "either version 3 of the License"),
        "GNU Affero General Public License Version 3, 19 November 2007"
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Apache License Version 2.0, January 2004",
        "Apache License, Version 2.0",
    ],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "BSD 3-Clause License"
    ],
    "GPL-2.0": [
        *_gnu("General Public License", "either version 2 of the License"), "GNU General Public License Version 2, June 1991"
    ],
    "GPL-3.0": [
        *_gnu("General Public License", "either version 3 of the License"), "GNU General Public License Version 3, 29 June 2007"
    ],
    "LGPL-2.1": [
        *_gnu("Lesser General Public License", "either version 2.1 of the License", "library"),
        "GNU Lesser General Public License Version 2.1, February 1999"
    ],
    "LGPL-3.0": [
        *_gnu("Lesser General Public License", "either version 3 of the License"),
        *_gnu("Lesser General Public License", "either version 3 of the License", "library"),
        "GNU Lesser General Public License Version 3, 29 June 2007"
    ],
    "MIT": [
        "The MIT License (MIT)",
        "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree."
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0"
    ],
}
SHORT = 300  # words of a full text that may also stand above code
RESERVED = "proprietary"
_SEGMENT = re.compile(r"\n|(?<=[.;])[ \t]+(?=[A-Z(])")
_TOKEN = re.compile(r"[^\W_]+(?:\.\d+)*")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Matcher:
    def __init__(self, templates: dict[str, list[str]] | None = None):
        self.notices = [(name, tokens(t)) for name, texts in sorted((templates or TEMPLATES).items()) for t in texts]
        df = Counter(w for _, ws in self.notices for w in set(ws))
        n = len(self.notices)
        self.idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
        self.top = math.log(1 + n) + 1
        self.vectors = [(name, self.vector(Counter(ws))) for name, ws in self.notices]

    def vector(self, counts: Counter) -> dict[str, float]:
        v = {w: c * self.idf.get(w, self.top) for w, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    def best(self, counts: Counter) -> tuple[str | None, float]:
        if not counts:
            return None, 0.0
        v = self.vector(counts)
        found, score = None, 0.0
        for name, t in self.vectors:
            s = sum(x * v[w] for w, x in t.items() if w in v)
            if s > score + 1e-12:
                found, score = name, s
        return found, score


class Scanner:
    def __init__(self):
        texts = {
            f.name.removesuffix(".txt"): [f.read_text()] for f in resources("quire.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")
        }
        self.kinds = [Matcher(), Matcher(HEADERS), Matcher(texts)]
        self.runs = [
            (m, name, v, len(ws)) for m in self.kinds for (name, v), (_, ws) in zip(m.vectors, m.notices) if len(ws) <= SHORT
        ]

    def runs_of(self, text: str, at_least: float) -> Iterator[tuple[str, float]]:
        """License and score of the runs that reach the threshold."""
        segments, marked = [], []
        for part in _SEGMENT.split(text):
            low = part.lower()
            if own := tokens(low):
                if any(m in low for m in MARKERS):
                    marked.append(len(segments))
                segments.append(own)
        ends = [0]
        for own in segments:
            ends.append(ends[-1] + len(own))
        seen = set()
        for m in marked:
            first = bisect_left(ends, ends[m] - 2 * SHORT)
            around = {w for own in segments[first : bisect_left(ends, ends[m + 1] + 2 * SHORT) + 1] for w in own}
            for k, (matcher, name, vector, length) in enumerate(self.runs):
                # what the words around can reach at most
                if sum(x * x for w, x in vector.items() if w in around) < (at_least - 1e-9) ** 2:
                    continue
                for s in range(m, -1, -1):
                    if s < m and ends[m + 1] - ends[s] > 1.5 * length:
                        break
                    e = bisect_left(ends, ends[s] + length)
                    for e in {min(max(e + d, m + 1), len(segments)) for d in (-1, 0)}:
                        if (k, s, e) not in seen:
                            seen.add((k, s, e))
                            v = matcher.vector(Counter(w for own in segments[s:e] for w in own))
                            score = sum(x * v[w] for w, x in vector.items() if w in v)
                            if score >= at_least:
                                yield name, score

    def scan(self, text: str | None, line_at: float, file_at: float) -> tuple[str | None, float, bool]:
        """license, score, and whether the whole text is a license file."""
        low = (text or "").lower()
        if not any(m in low for m in MARKERS):
            return None, 0.0, False
        counts, found = Counter(tokens(low)), (None, 0.0)
        for matcher in self.kinds:
            got = matcher.best(counts)
            found = got if got[1] > found[1] + 1e-12 else found
        if found[1] >= file_at:
            return *found, True
        lines = [self.kinds[0].best(Counter(tokens(x))) for x in low.split("\n") if any(m in x for m in MARKERS)]
        runs = [*self.runs_of(text, line_at), *[x for x in lines if x[1] >= line_at]]
        if not runs:
            return None, max((x[1] for x in lines), default=0.0), False
        name, score = min(runs, key=lambda r: (r[0] == RESERVED, -round(r[1], 12), r[0]))
        return name, score, False


def scan(files: DataFrame, id_col: str, path: Column, text_col: str, line_at: float = 0.8, file_at: float = 0.8) -> DataFrame:
    """id, path, own, score, is_file."""
    rows = files.select(F.col(id_col).alias("id"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for pdf in batches:
            got = [scanner.scan(t, line_at, file_at) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "id": pdf["id"], "path": pdf["path"], "own": [g[0] for g in got], "score": [g[1] for g in got],
                    "is_file": [g[2] for g in got]
                }
            )

    return rows.mapInPandas(run, f"id {kind}, path string, own string, score double, is_file boolean")


def directory(path: Column) -> Column:
    """Without the last segment; empty for one at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def ancestors(folder: Column) -> Column:
    """The directory, its parents and the top (empty)."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    )


def license_scan(
    files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", line_at: float = 0.8, file_at: float = 0.8
) -> DataFrame:
    """id, path, license, origin (header, file, inherited or null), score, license_dir."""
    found = materialise(
        scan(files, id_col, path, text_col, line_at, file_at).withColumn("folder", directory(F.col("path"))), "licenses"
    )
    speaking = found.where("is_file and folder is not null").groupBy(F.col("folder").alias("above")).agg(
        F.min(F.struct((-F.col("score")).alias("s"), "own", "path"))["own"].alias("dir_license")
    )
    folders = materialise(found.where("folder is not null").groupBy("folder").agg(F.count(F.lit(1)).alias("files")), "folders")
    ways = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("above"))
    nearest = ways.join(speaking, "above").groupBy("folder").agg(F.max(F.struct(F.length("above").alias("n"), "above", "dir_license")).alias("x")).select(
        "folder", F.col("x.above").alias("above"), F.col("x.dir_license").alias("dir_license")
    )
    nearest = materialise(folders.join(nearest, "folder", "left"), "nearest")
    out = join_counted(found, nearest, ["folder"], "files").unionByName(found.where("folder is null"), allowMissingColumns=True)
    origin = F.when(F.col("is_file"), "file").when(F.col("own").isNotNull(), "header").when(
        F.col("dir_license").isNotNull(), "inherited"
    )
    return out.select(
        F.col("id").alias(id_col), "path", F.coalesce("own", "dir_license").alias("license"), origin.alias("origin"), "score",
        F.when(origin == "inherited", F.col("above")).alias("license_dir")
    )
