"""License scan: units of a text against licence templates.

A unit is a line, a sentence of a line that has several, a paragraph (several
lines without a blank one) or the whole text (several paragraphs). Units and
templates are normalised to lower case words; likeness is the Dice coefficient
of their sets of word bigrams, and of the templates that reach the threshold
the closest names the unit. Templates are whole short licences and each of
their paragraphs, the standard notices of long licences, one-line statements
and SPDX tags.
For a likeness of at least ``t`` the larger set has at most ``(2 - t) / t``
times the bigrams of the smaller one, so templates outside those size bounds
are never compared, nor are units of which too few bigrams are in any template. Built-in functions only, and map-only: the templates are
a constant of the expression and documents stay where they are.

Defined results: null, empty or one-word texts match nothing. A tie for the
closest template, of a unit or of a text, goes to the licence that sorts first. Repeated rows are scanned
alike; other columns pass through untouched.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import isolate, restore

THRESHOLD = 0.8

# Whole texts of short licences, by paragraph.
DISCLAIMER_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
BSD_OPENING = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
               "following conditions are met:")
BSD_SOURCE = ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
              "disclaimer.")
BSD_BINARY = ("2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
              "disclaimer in the documentation and/or other materials provided with the distribution.")
BSD_NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission.")
WITHOUT_WARRANTY_ISC = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
WHOLE: dict[str, list[str]] = {
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        WITHOUT_WARRANTY_ISC],
    "BSD-2-Clause": [BSD_OPENING, BSD_SOURCE, BSD_BINARY, DISCLAIMER_BSD],
    "BSD-3-Clause": [BSD_OPENING, BSD_SOURCE, BSD_BINARY, BSD_NAMES, DISCLAIMER_BSD],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following:",
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction "
        "and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative "
        "works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
        "generated by a source language processor."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.", WITHOUT_WARRANTY_ISC],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
        "a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of "
        "all present and future rights to this software under copyright law."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions:",
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you "
        "use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "3. This notice may not be removed or altered from any source distribution."],
}
# Standard notices and one-line statements, (licence, text).
GNU_NOTICE = ("This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published "
              "by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.")
GNU_WARRANTY = ("This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
                "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.")
GNU = [("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"),
       ("LGPL-2.1", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "Lesser General Public License", "3"),
       ("AGPL-3.0", "program", "Affero General Public License", "3")]
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License "
                   "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
                   "or implied. See the License for the specific language governing permissions and limitations under "
                   "the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
                "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved."),
]
SPDX = ["0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
        "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib"]


def _templates() -> list[tuple[str, str]]:
    """Every template, each text once: statements, tags, notices, whole
    licences, and their paragraphs (one that several share names the last)."""
    out = list(NOTICES)
    for name in SPDX:
        out.append((name, f"SPDX-License-Identifier: {name}"))
        if "GPL" in name:
            out += [(name, f"SPDX-License-Identifier: {name}-{which}") for which in ("only", "or-later")]
    for name, what, long_name, version in GNU:
        old = version.startswith("2")
        out.append((name, GNU_NOTICE.format(what=what, name=long_name, version=version, colon=";" if old else ":", comma=";" if old else ",")))
    out += [("GPL-3.0", GNU_WARRANTY.format(what="program", name="General Public License")),
            ("LGPL-3.0", GNU_WARRANTY.format(what="library", name="Lesser General Public License")),
            ("AGPL-3.0", GNU_WARRANTY.format(what="program", name="Affero General Public License"))]
    out += [(name, "\n\n".join(paragraphs)) for name, paragraphs in WHOLE.items()]
    single = {p: name for name, paragraphs in WHOLE.items() for p in reversed(paragraphs)}
    return out + [(name, p) for p, name in single.items()]


TEMPLATES = _templates()


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^0-9a-z]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and greatest number of bigrams that can reach ``threshold``
    against ``n`` bigrams (one more on either side, against rounding)."""
    return max(1, int(n * threshold / (2 - threshold)) - 1), int(n * (2 - threshold) / threshold) + 1


def _words(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " ")), " ")


def _sentences(line: Column) -> Column:
    """The sentences of a line that has several, else none."""
    cut = F.split(F.regexp_replace(line, r"([.!?:;])[ \t\r]+", "$1\n"), "\n")
    return F.transform(F.array(cut), lambda s: F.when(F.size(s) > 1, s).otherwise(F.array().cast("array<string>")))[0]


def _bigrams(words: Column) -> Column:
    n = F.size(words)
    return F.array_distinct(F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1),
                                       lambda a, b: F.concat(a, F.lit(" "), b)))


def scan(docs: DataFrame, text_col: str = "text", out: str = "license_hits", threshold: float = THRESHOLD,
         templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``docs`` with ``out``: array of (license, dice, unit, number), where
    unit is ``line``, ``sentence``, ``paragraph`` or ``text`` and number counts from 0."""
    sets = [(name, template_bigrams(text)) for name, text in templates]
    bounds = [size_bounds(len(b), threshold) for _, b in sets]
    least, most = min(lo for lo, _ in bounds), max(hi for _, hi in bounds)
    known = F.array(*[
        F.struct(F.lit(name).alias("license"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
                 F.array(*[F.lit(x) for x in grams]).alias("grams"))
        for (name, grams), (lo, hi) in zip(sets, bounds, strict=True)])

    def numbered(units: Column, kind: str) -> Column:
        return F.transform(units, lambda u, i: F.struct(F.lit(kind).alias("unit"), i.alias("number"),
                                                        _words(u).alias("words")))

    rows = isolate(docs, text=text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    paragraphs = F.split(text, r"\n[ \t\r]*\n")
    units = F.concat(
        numbered(F.split(text, "\n"), "line"),
        numbered(F.flatten(F.transform(F.split(text, "\n"), _sentences)), "sentence"),
        F.filter(numbered(F.transform(paragraphs, lambda p: F.when(F.contains(p, F.lit("\n")), p).otherwise("")),
                          "paragraph"), lambda u: F.size(u["words"]) > 1),
        numbered(F.when(F.size(paragraphs) > 1, F.array(text)).otherwise(F.array().cast("array<string>")), "text"))
    sized = F.filter(units, lambda u: F.size(u["words"]).between(least + 1, F.lit(1 << 30)))
    grams = F.filter(
        F.transform(sized, lambda u: F.struct(u["unit"].alias("unit"), u["number"].alias("number"),
                                              _bigrams(u["words"]).alias("grams"))),
        lambda u: F.size(u["grams"]).between(least, most))

    # d of n bigrams in any template: at most d are common, so 2d / (n + d) is the most that a template can reach
    anywhere = sorted({x for _, grams in sets for x in grams})
    share = threshold / (2 - threshold)

    def hopeful(u: Column) -> Column:
        return F.size(F.filter(u["grams"], lambda g: g.isin(anywhere))) >= share * F.size(u["grams"]) - 1e-9

    def against(u: Column) -> Column:
        n = F.size(u["grams"])
        near = F.filter(F.col("templates"), lambda t: n.between(t["lo"], t["hi"]))
        closest = F.array_min(F.transform(near, lambda t: F.struct(
            (-2 * F.size(F.array_intersect(u["grams"], t["grams"])) / (n + F.size(t["grams"]))).alias("far"),
            t["license"].alias("license"))))
        return F.transform(F.array(closest), lambda c: F.struct(
            c["license"].alias("license"), (-c["far"]).alias("dice"), u["unit"].alias("unit"), u["number"].alias("number")))

    hits = F.filter(F.flatten(F.transform(F.col("grams"), against)), lambda h: h["dice"] >= threshold)
    done = rows.withColumn("templates", known).withColumn("grams", F.filter(grams, hopeful))
    return restore(done, docs, {"text": text_col}, **{out: hits})


def summarize(scanned: DataFrame, keep: list[str], hits_col: str = "license_hits") -> DataFrame:
    """Per row: number of hits, licences (sorted, joined by commas), and the best match."""
    hits = F.col(hits_col)
    best = F.array_min(F.transform(hits, lambda h: F.struct((-h["dice"]).alias("d"), h["license"].alias("l"))))
    return scanned.select(
        *keep, F.size(hits).cast("long").alias("n_hits"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["license"]))), ",").alias("licenses"),
        best["l"].alias("best_license"), F.coalesce(-best["d"], F.lit(0.0)).alias("best_dice"))
