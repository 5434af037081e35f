"""Licences of files by sparse TF-IDF cosine to templates, inherited along directories (operator 1).

A file's edge lines are compared with notices, its whole text with notices and licence texts, and its
first line with titles, as sparse vectors joined on their terms.  A licence file -- one that as a whole is little but a licence -- stands for its directory.
Files without a licence of their own take that of the nearest directory above that has one, found by
joining every directory's ancestors to the licensed ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.llm.common import slices, small, stored

# Notices, titles and texts of licences, as files carry them.

#: Per licence the notices that files bear, each a line or a passage; templates are a parameter, and
#: these are the ones of the registered query.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License",
        "licensed under the MIT License. See LICENSE for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "ISC": ("Licensed under the ISC License", "SPDX-License-Identifier: ISC"),
    "Zlib": ("Licensed under the zlib License", "SPDX-License-Identifier: Zlib"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "CC-BY": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0": ("Dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("All rights reserved", "Confidential and proprietary"),
}

_NO_WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
#: Per licence the texts that whole files are compared with.
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        'that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "BSD": (
        _BSD + _NO_WARRANTY_BSD,
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission. " + _NO_WARRANTY_BSD,
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
        "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
        "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
        "altered from any source distribution.",
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
}
#: Lines that a licence's own text begins with.  Long texts are known by them, wherever the rest leads.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "Apache-2.0": ("Apache License", "Apache License Version 2.0, January 2004"),
    "GPL": ("GNU GENERAL PUBLIC LICENSE",),
    "LGPL": ("GNU LESSER GENERAL PUBLIC LICENSE",),
    "AGPL": ("GNU AFFERO GENERAL PUBLIC LICENSE",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
    "BSD": ("BSD 2-Clause License", "BSD 3-Clause License"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0": ("CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"),
    "CC-BY": ("Creative Commons Attribution 4.0 International Public License", "Attribution 4.0 International"),
    "CC-BY-NC": ("Creative Commons Attribution-NonCommercial 4.0 International Public License", "Attribution-NonCommercial 4.0 International"),
    "CC-BY-SA": ("Creative Commons Attribution-ShareAlike 4.0 International Public License", "Attribution-ShareAlike 4.0 International"),
}
TERM = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
#: Lines of a header, and as many at a text's end, where some put the notice; and the cosine from
#: which a line or a whole file matches.
HEADER_LINES = 5
LINE_COSINE, FILE_COSINE, TITLE_COSINE = 0.6, 0.5, 0.9
Templates = Mapping[str, Sequence[str]]


def terms(text: str) -> Counter:
    """Words and neighbouring pairs of words, lower-cased."""
    words = TERM.findall(text.lower())
    return Counter([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])


def template_vectors(templates: Templates) -> dict[str, dict[tuple[str, int], float]]:
    """term -> {(name, number): weight}: normalised TF-IDF over the given templates."""
    bags = {(name, k): terms(t) for name, texts in templates.items() for k, t in enumerate(texts)}
    spread = Counter(t for bag in bags.values() for t in bag)
    out: dict[str, dict[tuple[str, int], float]] = {}
    for template, bag in bags.items():
        weights = {t: n * idf(len(bags), spread[t]) for t, n in bag.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        for t, w in weights.items():
            out.setdefault(t, {})[template] = w / norm
    return out


def idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


Profile = tuple[Counter, Counter, float]


def profile(text: str) -> Profile:
    """Words, neighbouring pairs and the sum of their squared counts."""
    words = TERM.findall(text.lower())
    bag, pairs = Counter(words), Counter(zip(words, words[1:]))
    return bag, pairs, sum(math.sumprod(x, x) for x in (list(bag.values()), list(pairs.values())))


def best_match(text: str, vectors: Mapping[str, Mapping], n: int) -> tuple[str | None, float]:
    return nearest(profile(text), vectors, n)


def nearest(of: Profile, vectors: Mapping[str, Mapping], n: int) -> tuple[str | None, float]:
    """The licence of the template of greatest cosine among ``n``; the name decides ties.

    A sparse product: only terms that templates have are visited.  All others weigh as much as one
    that is in no template, so that their part of the norm is a sum over counts.
    """
    (bag, pairs, squares), rare, dots = of, idf(n, 0), Counter()
    norm = rare * rare * squares

    def visit(t: str, k: int) -> float:
        held = vectors[t]
        w = k * idf(n, len(held))
        for template, v in held.items():
            dots[template] += w * v
        return w * w - k * k * rare * rare

    known = [t for t in bag if t in vectors]
    if not known:
        return None, 0.0
    norm += sum(visit(t, bag[t]) for t in known)
    # a pair of a template has words of templates
    if len(known) > 1 or bag[known[0]] > 1:
        norm += sum(visit(t, k) for (a, b), k in pairs.items() if a in vectors and b in vectors and (t := f"{a} {b}") in vectors)
    if not dots:
        return None, 0.0
    best = min(dots, key=lambda x: (-dots[x], x))
    return best[0], dots[best] / math.sqrt(norm)


def notice_lines(text: str) -> list[str]:
    """The first and the last lines of a text, each once; a text of few lines is taken whole."""
    head = text.split("\n", HEADER_LINES)
    if len(head) <= HEADER_LINES:
        return head
    return head[:HEADER_LINES] + head[HEADER_LINES].rsplit("\n", HEADER_LINES)[-HEADER_LINES:]


def first_line(text: str) -> str:
    """The first line that is not blank; a title may be broken in two after the name of a licence."""
    return next((line for line in text.split("\n") if line.strip()), "")


def scanned(
    files: DataFrame, templates: Templates = TEMPLATES, texts: Templates = TEXTS, titles: Templates = TITLES
) -> DataFrame:
    """``path``, own licence and its cosine, and whether the file is a licence file, of every file.

    Every line at the head and the end is compared with the notices by itself, so that prose does not
    dilute one.  A licence file is one whose whole text is near a notice or a licence's text, whatever
    its lines gave, or whose first line is a licence's title.  Null and empty texts match nothing.
    """
    spaces = [(template_vectors(t), sum(map(len, t.values()))) for t in (templates, texts, titles)]
    (vectors, n), longer, heads = spaces

    def judge(text: str) -> tuple[str | None, float, bool]:
        best: tuple[str | None, float] = (None, 0.0)
        for line in notice_lines(text):
            found = best_match(line, vectors, n)
            if found[1] > best[1]:
                best = found
        own = best[0] if best[1] >= LINE_COSINE else None
        of = profile(text)
        whole = max(nearest(of, vectors, n), nearest(of, *longer), key=lambda x: x[1])
        if whole[1] >= FILE_COSINE:
            return whole[0], whole[1], True
        title = best_match(first_line(text), *heads)
        if title[1] >= TITLE_COSINE:
            return title[0], title[1], True
        return own, best[1], False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000, 4 << 20):
            own, score, is_file = zip(*(judge(t or "") for t in batch["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["path"], pa.array(own, pa.string()), pa.array(score, pa.float64()), pa.array(is_file, pa.bool_())],
                names=["doc_id", "path", "own", "cosine", "licence_file"],
            )

    return files.select(F.col("doc_id").cast("bigint"), "path", "text").mapInArrow(
        run, "doc_id bigint, path string, own string, cosine double, licence_file boolean"
    )


def parent(path: str):
    """The directory of a path: what stands before its last slash; empty at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def inherited(found: DataFrame) -> DataFrame:
    """doc_id, path, licence, cosine, origin (own, directory or none), from_dir of every file.

    A directory's licence is that of its best licence file (greatest cosine, then path).  Joined are
    distinct directories, not files: each one's ancestors meet the licensed directories, the deepest
    stays, and files get the answer of their directory.  One directory may hold a third of all files.
    """
    found = stored(found.withColumn("dir", parent("path")))
    licensed = (
        found.filter("licence_file")
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "own")).alias("best"))
        .select(F.col("dir").alias("above"), F.col("best.own").alias("dir_licence"))
    )
    parts = F.split("dir", "/")
    ancestors = (
        found.select("dir")
        .filter("dir IS NOT NULL")
        .distinct()
        .select("dir", F.posexplode(F.sequence(F.lit(0), F.size(parts))).alias("depth", "k"))
        .select("dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("k")), "/").alias("above"))
        .distinct()
    )
    nearest = (
        ancestors.join(licensed, "above")
        .groupBy("dir")
        .agg(F.max_by(F.struct("above", "dir_licence"), "depth").alias("up"))
        .select("dir", F.col("up.above").alias("above"), F.col("up.dir_licence").alias("dir_licence"))
    )
    joined = found.join(small(stored(nearest), 256), "dir", "left")
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("own", "dir_licence").alias("licence"),
        "cosine",
        F.when(F.col("own").isNotNull(), "own")
        .when(F.col("dir_licence").isNotNull(), "directory")
        .otherwise("none")
        .alias("origin"),
        F.when(F.col("own").isNull(), F.col("above")).alias("from_dir"),
    )


def licences(files: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """Licences of ``files`` (doc_id, path, text).  A null path inherits nothing."""
    return inherited(scanned(files, templates))
