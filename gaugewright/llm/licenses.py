"""License scans with DataFrame functions: Dice coefficient over word bigrams.

A document's units are its whole text, its paragraphs (between blank lines), its lines and its
sentences (which may run over several lines, or be a part of one). A unit and a template are compared
by their normalised words' bigrams, counted with repetition, so that a unit's size is known from its
word count: a coefficient of t needs sizes within (2 - t) / t of each other, and units that no
template's bounds admit are dropped before any bigram is made. The same bounds say how many of a
template's bigrams a match can lack, so that it must have one of a few words; texts and units with
none of them are left out by a plain search.

Every row is judged by its own text where it is read: bigrams are numbered by their occurrence, so
that counts with repetition become an intersection of sets, and nothing is joined or shuffled.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Wordings of license notices and short licenses.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "See the License for the specific language governing permissions and limitations under the License.",
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
)
_BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'
_MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")
_CC0 = ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal.", "Licensed under CC0 1.0.")
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GNU = [("GPL", "GNU General Public License", "2"), ("GPL", "GNU General Public License", "3"), ("LGPL", "GNU Lesser General Public License", "2.1"), ("LGPL", "GNU Lesser General Public License", "3"), ("AGPL", "GNU Affero General Public License", "3")]


def _templates() -> dict[str, list[str]]:
    """The wordings of each license: its notices, its paragraphs, and those together."""
    together = " ".join
    found = {
        "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", *_APACHE, together(_APACHE)],
        "BSD-2-Clause": ["Released under the BSD License.", *_BSD[:1], together(_BSD[:3] + _BSD[4:])],
        "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", _BSD[3], together(_BSD)],
        "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", _BOOST],
        "CC0-1.0": list(_CC0),
        "ISC": ["Licensed under the ISC License.", *_ISC, together(_ISC)],
        "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", *_MIT, _AS_IS, together((*_MIT, _AS_IS))],
        "MPL-2.0": [*_MPL, together(_MPL)],
        "Unlicense": [*_UNLICENSE, together((*_UNLICENSE, _AS_IS))],
        "Zlib": [*_ZLIB, together(_ZLIB)],
    }
    for code, name in _CC.items():
        found[f"CC-{code}-4.0"] = [f"This work is licensed under the Creative Commons {name} 4.0 International License.", f"Licensed under CC {code} 4.0."]
    for code, name, version in _GNU:
        found[f"{code}-{version if '.' in version else version + '.0'}"] = [
            f"This work is licensed under the {name}, version {version}.",
            f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        ]
    return found


TEMPLATES: dict[str, list[str]] = _templates()


def template_rows(templates: dict[str, list[str]]) -> list[tuple[str, str, str, int, int]]:
    """license, wording (its name and number), bigram, the bigram's count and the wording's bigrams."""
    rows = []
    for name, wordings in sorted(templates.items()):
        for k, text in enumerate(wordings):
            words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
            pairs = Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
            rows += [(name, f"{name}#{k}", pair, n, len(words) - 1) for pair, n in sorted(pairs.items())]
    return rows


# Words of the templates that much other prose has too; others are searched for first.
_COMMON = set(
    "without including following general public published provided source specific related possible particular performance products version conditions subject included universal connection "
    "commercial express clause released applications language personal charge interest present future united states either author authors action written person rights anyone available".split()
)


@lru_cache(maxsize=4)
def required_words(rows: tuple[tuple[str, str, str, int, int], ...], threshold: float, least: int = 6) -> tuple[list[str], list[str]]:
    """Words and bigrams of which every match has at least one, for template rows.

    A match has at least t / (2 - t) of a wording's bigrams. So of any set of bigrams that is larger
    than the rest it has one. Words of ``least`` letters are chosen, rare and long ones first, until
    the bigrams that hold them are such a set; where they are too few, bigrams complete it.
    """
    single: set[str] = set()
    double: set[str] = set()
    sizes = {r[1]: r[4] for r in rows}
    for wording in sorted(sizes, key=lambda w: (sizes[w], w)):
        pairs = Counter({r[2]: r[3] for r in rows if r[1] == wording})
        need = math.floor(sizes[wording] - sizes[wording] * threshold / (2 - threshold) + 1e-9) + 1
        open_ = {p: n for p, n in pairs.items() if p not in double and not single & set(p.split(" "))}
        need -= sizes[wording] - sum(open_.values())
        while need > 0 and open_:
            gain: Counter = Counter()
            for p, n in open_.items():
                for w in set(p.split(" ")):
                    if len(w) >= least and w not in _COMMON:
                        gain[w] += n
            if gain:
                best = max(gain, key=lambda w: (gain[w] * len(w) ** 3, w))
                single.add(best)
                taken = [p for p in open_ if best in p.split(" ")]
            else:
                taken = [max(open_, key=lambda p: (len(p), p))]
                double.update(taken)
            need -= sum(open_.pop(p) for p in taken)
    return sorted(single), sorted(double)


def _has_word(norm: Column, words: tuple[list[str], list[str]]) -> Column:
    """Whether a lambda's normalised text has a required word or bigram."""
    single, double = words
    found = F.arrays_overlap(F.split(norm, " "), _constant(single, "array<string>"))
    framed = F.concat(F.lit(" "), norm, F.lit(" "))
    return found | F.exists(_constant([f" {p} " for p in double], "array<string>"), lambda p: F.contains(framed, p))


def _with(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _plain(text: Column) -> Column:
    """Lower-case ASCII words and numbers between single spaces."""
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _constant(value, schema: str) -> Column:
    """A value as one constant, whatever its size."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {schema}")["v"]


def _units(lower: Column, norm: Column, words: tuple[list[str], list[str]]) -> Column:
    """kind, pos and norm of a text's units that have a required word; parts only where there are several."""

    def parts(kind: str, pattern: str) -> Column:
        def cut(found: Column) -> Column:
            placed = F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), _plain(x).alias("norm")))
            return F.filter(placed, lambda u: (F.size(found) > 1) & _has_word(u["norm"], words))

        return _with(F.split(lower, pattern), cut)

    whole = F.array(F.struct(F.lit("text").alias("kind"), F.lit(0).alias("pos"), norm.alias("norm")))
    return F.concat(whole, parts("paragraph", r"\n[ \t\r]*\n"), parts("line", "\n"), parts("sentence", r"[.!?;:][ \t\r\n]+|\n[ \t\r]*\n"))


def _numbered(norm: Column) -> Column:
    """A unit's bigrams, each with its number among those equal to it."""

    def pairs(words: Column) -> Column:
        n = F.size(words) - 1
        return F.array_sort(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))

    def number(found: Column) -> Column:
        return F.transform(found, lambda x, i: F.concat(x, F.lit(" "), (i + 1 - F.array_position(found, x)).cast("string")))

    return _with(_with(F.split(norm, " "), pairs), number)


def _best(norm: Column, rows: Sequence[tuple[str, str, str, int, int]], threshold: float) -> Column:
    """The license of a unit's highest coefficient (ties to the smaller name) as dice, negated, and license; null below the threshold."""
    wordings: dict[tuple[str, str, int], list[str]] = {}
    for name, wording, pair, count, size in rows:
        wordings.setdefault((name, wording, size), []).extend(f"{pair} {k}" for k in range(count))
    known = _constant([{"license": name, "m": size, "pairs": pairs} for (name, _, size), pairs in wordings.items()], "array<struct<license:string,m:int,pairs:array<string>>>")

    def judged(n: Column) -> Column:
        def compare(near: Column) -> Column:
            def each(own: Column) -> Column:
                return F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect(own, t["pairs"])) / (n + t["m"])).alias("d"), t["license"].alias("license")))

            return F.when(F.size(near) > 0, F.array_min(F.filter(_with(_numbered(norm), each), lambda x: x["d"] <= -threshold)))

        return F.when(n.between(*_reach(rows, threshold)), _with(F.filter(known, lambda t: _bounds(n, t["m"], threshold)), compare))

    return _with(_spaces(norm), judged)


def _bounds(n: Column, m: Column, threshold: float) -> Column:
    """Sizes that can reach the threshold; the rounding of the products is allowed for."""
    return (n > 0) & (n * (2 - threshold) + 1e-9 >= m * threshold) & (m * (2 - threshold) + 1e-9 >= n * threshold)


def _reach(rows: Sequence[tuple[str, str, str, int, int]], threshold: float) -> tuple[int, int]:
    """The least and the greatest size of a unit that any wording's bounds admit."""
    sizes = [r[4] for r in rows] or [0]
    return math.floor(min(sizes) * threshold / (2 - threshold)), math.ceil(max(sizes) * (2 - threshold) / threshold)


def _matches(text: Column, templates: dict[str, list[str]] | None, threshold: float) -> Column:
    """kind, pos, license and dice of the units that match; null for a text without a required word."""
    rows = tuple(template_rows(TEMPLATES if templates is None else templates))
    words = required_words(rows, threshold)

    def found(lower: Column, norm: Column) -> Column:
        judged = F.transform(_units(lower, norm, words), lambda u: F.struct(u["kind"].alias("kind"), u["pos"].alias("pos"), _best(u["norm"], rows, threshold).alias("best")))
        matched = F.filter(judged, lambda u: u["best"].isNotNull())
        return F.transform(matched, lambda u: F.struct(u["kind"].alias("kind"), u["pos"].alias("pos"), u["best"]["license"].alias("license"), (-u["best"]["d"]).alias("dice")))

    return _with(F.lower(text), lambda lower: _with(_plain(lower), lambda norm: F.when(_has_word(norm, words), found(lower, norm))))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Matches: doc_id, kind, pos, license and dice (at least the threshold), one row for each unit that matches.

    A unit names the license of its highest coefficient, on ties the one of the smaller name. ``docs``
    has doc_id and text; other columns are ignored. Words are runs of ASCII letters and digits of the
    lower-case text. A null or empty text, and a unit of fewer than two words, matches nothing. Every
    row is judged by itself: repeated rows give their matches each, rows of one doc_id never meet, and
    a null doc_id stays null.
    """
    found = docs.select("doc_id", F.explode(_matches(F.col("text"), templates, threshold)).alias("m"))
    return found.select("doc_id", "m.kind", "m.pos", "m.license", "m.dice")


def license_of_documents(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, license (of the highest coefficient, ties to the smaller name; else null), dice (0 if none) and n_licenses (distinct ones)."""
    found = docs.select("doc_id", F.coalesce(_matches(F.col("text"), templates, threshold), F.array().cast("array<struct<kind:string,pos:int,license:string,dice:double>>")).alias("m"))
    best = F.array_min(F.transform("m", lambda x: F.struct((-x["dice"]).alias("d"), x["license"].alias("license"))))
    found = found.select("doc_id", best.alias("best"), F.size(F.array_distinct(F.transform("m", lambda x: x["license"]))).cast("long").alias("n_licenses"))
    return found.select("doc_id", F.col("best.license").alias("license"), F.coalesce(-F.col("best.d"), F.lit(0.0)).alias("dice"), "n_licenses")
