"""Licence scan: Dice coefficient over word bigrams between texts and licence templates.

A text is looked at by lines, by paragraphs (lines up to one without words), as a whole and, so
that notices inside other words count, by runs of words that start and end where a template's
bigrams occur. Each unit is normalised to lower-case words of letters and digits; its distinct word bigrams are
compared with those of each template. A coefficient 2|A & B| / (|A| + |B|) of at least d
bounds the sizes: |A| lies between d / (2 - d) |B| and (2 - d) / d |B|, so only templates
of such sizes are compared. A line with a licence identifier of the SPDX form names its
licences itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
WORD = re.compile(r"[^\W_]+")
#: A machine-readable identifier: one licence or several joined by AND, OR, WITH.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(?((?:[A-Za-z0-9.+-]+)(?:[ \t)]+(?:AND|OR|WITH)[ \t(]+[A-Za-z0-9.+-]+)*)")

BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

# Customary wordings of licence notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("all-rights-reserved", "All rights reserved."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("MIT", MIT + MIT_AS_IS),
    ("ISC", ISC + ISC_AS_IS),
    ("BSD-2-Clause", BSD + BSD_AS_IS),
    ("BSD-3-Clause", BSD + BSD_NAMES + BSD_AS_IS),
)


def whole_texts() -> tuple[tuple[str, str], ...]:
    """Whole licences, by their SPDX names. Only the driver reads the files."""
    return tuple((f.stem, f.read_text()) for f in sorted(Path(__file__).with_name("licence_texts").glob("*.txt")))


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(words, words[1:], strict=False))


class Matcher:
    """Templates by number of bigrams, with the size bounds of a Dice coefficient."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        self.least = least
        rows = sorted(((g, n, k) for k, (n, text) in enumerate(templates) if (g := bigrams(WORD.findall(text.lower())))), key=lambda r: (len(r[0]), r[2]))
        self.grams, self.names = [r[0] for r in rows], [r[1] for r in rows]
        self.sizes = [len(g) for g in self.grams]
        self.any = frozenset().union(*self.grams)
        self.lo = least / (2 - least)
        self.most = max(self.sizes, default=0) / self.lo
        self.having: dict[tuple[str, str], list[int]] = {}
        for k, template in enumerate(self.grams):
            for g in template:
                self.having.setdefault(g, []).append(k)

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """The highest coefficient of at least `least` and its licence; ties by name."""
        # A text of w distinct words has w - 1 distinct bigrams at least.
        if len(words) > self.most and len(set(words)) - 1 > self.most:
            return None
        grams = bigrams(words)
        if not grams or self.any.isdisjoint(grams):
            return None
        n, found = len(grams), None
        for k in range(bisect_left(self.sizes, self.lo * n - 1e-9), bisect_right(self.sizes, n / self.lo + 1e-9)):
            dice = 2 * len(grams & self.grams[k]) / (n + self.sizes[k])
            if dice >= self.least and (found is None or (-dice, self.names[k]) < (-found[0], found[1])):
                found = (dice, self.names[k])
        return found

    def runs(self, words: list[str], best: dict[str, float]) -> None:
        """Raise best (by licence) to the coefficients of runs of words.

        A run of the highest coefficient for a template starts and ends with one of its
        bigrams: without another one at an end the coefficient is no lower. Runs go from each
        place of such a bigram to later ones while its distinct bigrams keep the size bounds.

        Without its first j words a run has at most j distinct bigrams less and none more of the
        template's. So if no run from one place exceeds the coefficient d, none from less than
        size * (1 - d / wanted) words later reaches a wanted one, and those places are passed by.
        Runs are followed half a template beyond the bounds for that.
        """
        found = Counter(k for g in self.any.intersection(zip(words, words[1:], strict=False)) for k in self.having[g])
        # A run of at least `least` shares at least lo * size of the template's bigrams.
        likely = sorted(k for k, n in found.items() if n >= self.lo * self.sizes[k] - 1e-9)
        grams = list(zip(words, words[1:], strict=False)) if likely else []
        for k in likely:
            template, size, name = self.grams[k], self.sizes[k], self.names[k]
            slack = size / 2
            bound = size / self.lo + slack
            at = [i for i, g in enumerate(grams) if g in template]
            useful = 0.0
            for a, first in enumerate(at):
                if best.get(name, 0) >= 1:
                    break
                if first < useful - 1e-6:
                    continue
                seen: set[tuple[str, str]] = set()
                shared, past, highest, b = 0, first, 0.0, a
                while b < len(at) and shared < found[k] and len(seen) <= bound:
                    for i in range(past, at[b] + 1):
                        g = grams[i]
                        if g not in seen:
                            seen.add(g)
                            shared += g in template
                            if len(seen) > bound:
                                break
                    else:
                        past = at[b] + 1
                        highest = max(highest, 2 * shared / (len(seen) + size))
                        b += 1
                if highest >= self.least and highest > best.get(name, 0):
                    best[name] = highest
                useful = first + min(slack, size * (1 - highest / max(self.least, best.get(name, 0))))

    def scan(self, text: str | None) -> list[tuple[str, float]]:
        """(licence, highest coefficient) of a text, by licence."""
        best: dict[str, float] = {}

        def look(words: list[str]) -> None:
            if 2 <= len(words) and (hit := self.best(words)) and hit[0] > best.get(hit[1], 0):
                best[hit[1]] = hit[0]

        every: list[str] = []
        paragraph: list[str] = []
        in_paragraph = in_text = 0
        for line in [*(text or "").split("\n"), ""]:
            words = WORD.findall(line.lower())
            if words:
                look(words)
                paragraph += words
                in_paragraph += 1
            elif paragraph:
                if in_paragraph > 1:
                    look(paragraph)
                every += paragraph
                in_text += in_paragraph
                paragraph, in_paragraph = [], 0
        if in_text > 1:
            look(every)
        self.runs(every, best)
        for stated in SPDX.findall(text or ""):
            best.update((name.rstrip("."), 1.0) for name in re.split(r"[ \t()]+(?:AND|OR|WITH)[ \t()]+", stated))
        return sorted(best.items())


def scan_licences(docs: DataFrame, templates: tuple[tuple[str, str], ...] | None = None, least: float = LEAST) -> DataFrame:
    """Licences found in each document: doc_id, licences (array<struct<licence, dice>>), n_licences, best_licence, best_dice.

    docs: doc_id, text and any others, which are ignored. templates: TEMPLATES and the whole
    texts, if not given. Licences that differ in a few words (the GNU Affero licence from the
    general one) are found as each other. Documents without a match, null
    and empty texts have an empty array, 0 and nulls. Ties for the best go to the first
    name. Null and repeated ids give rows of their own. An empty table gives no rows.
    """
    matcher = Matcher(TEMPLATES + whole_texts() if templates is None else templates, least)
    id_type = dict(docs.dtypes)["doc_id"]
    kind = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"licence": n, "dice": d} for n, d in matcher.scan(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "licences"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, licences array<struct<licence:string,dice:double>>")
    top = F.get(F.array_sort(F.transform("licences", lambda x: F.struct((-x["dice"]).alias("d"), x["licence"].alias("l")))), 0)
    return out.withColumn("_top", top).select("doc_id", "licences", F.size("licences").cast("bigint").alias("n_licences"), F.col("_top.l").alias("best_licence"), (-F.col("_top.d")).alias("best_dice"))
