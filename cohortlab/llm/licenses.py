"""License scans by patience alignment.

A text's region and a license template are aligned by patience: words that occur once in
each are anchors, the longest increasing run of anchors is kept, and the gaps between them
are aligned in the same way; gaps without anchors are aligned word by word. Coverage is
the share of the template's words that the alignment matches, so years and holders that
stand in between cost nothing.

Which regions can reach the coverage is known beforehand: of any set of template words
that is larger than the allowed loss, one must be there. Texts without such a word are
passed over in the JVM; in the others only stretches around such words are aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.arrow import map_batches

#: Notices and headers of common licenses.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of "
        "the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
}
#: Words too common to look for.
COMMON = frozenset("a all an and any are as at be by can for free from in is it may of on one or that the this to under use used was with without you your not work above following version".split())
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Template:
    license: str
    words: tuple[str, ...]
    keys: frozenset[str]


def templates(texts: dict[str, tuple[str, ...]], coverage: float) -> list[Template]:
    """Templates with words of which each match of that coverage holds one at least."""
    out = []
    for name, versions in texts.items():
        for text in versions:
            words = tuple(WORD.findall(text.lower()))
            lost, keys = int((1 - coverage) * len(words) + 1e-9), []
            for w in sorted(set(words), key=lambda w: (w in COMMON, -len(w), w)):
                keys.append(w)
                if sum(words.count(k) for k in keys) > lost:
                    break
            if words:
                out.append(Template(name, words, frozenset(keys)))
    return out


def rising(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tops, ends, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_words(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as places in a and b.

    A row holds, one bit a word of b, where the length does not grow; each row follows from
    the one before it by a sum of whole numbers.
    """
    where: dict[str, int] = {}
    for j, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << j
    every = (1 << len(b)) - 1
    rows = [every]
    for w in a:
        met = rows[-1] & where.get(w, 0)
        rows.append((rows[-1] + met | rows[-1] - met) & every)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        at_a, at_b = {}, {}
        for at, words, lo, hi in ((at_a, a, a0, a1), (at_b, b, b0, b1)):
            for i in range(lo, hi):
                at[words[i]] = -1 if words[i] in at else i
        unique = [(i, at_b[w]) for w, i in at_a.items() if i >= 0 and at_b.get(w, -1) >= 0]
        unique.sort()
        if unique:
            anchors = [unique[k] for k in rising([j for _, j in unique])]
            out += anchors
            for (i, j), (k, l) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
                todo.append((i + 1, k, j + 1, l))
        else:
            out += [(a0 + i, b0 + j) for i, j in common_words(a[a0:a1], b[b0:b1])]
    return sorted(out)


def regions(places: list[list[int]], n: int, words: int) -> list[tuple[int, int]]:
    """Stretches of the text that can hold a match around its key words.

    places: for each key word's place in the template, where it stands in the text.
    """
    slack = max(6, n // 2)
    spans = sorted((max(0, p - n - slack), min(words, p + n + slack)) for p in sorted({p for ps in places for p in ps}))
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        if out and lo <= out[-1][1] and hi - out[-1][0] <= 4 * (n + slack):
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def windows(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """Overlapping pieces of n and a half words, an eighth of n apart."""
    step, size = max(1, n // 8), n + n // 2
    return [(i, min(i + size, hi)) for i in range(lo, max(hi - size, lo) + step, step) if i < hi]


def dense(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Of the matched words, the run inside a stretch of twice the template that has most."""
    best, lo = (0, 0), 0
    for hi in range(len(pairs)):
        while pairs[hi][0] - pairs[lo][0] > 2 * n + 8:
            lo += 1
        if hi + 1 - lo > best[1] - best[0]:
            best = lo, hi + 1
    return pairs[best[0] : best[1]]


def tight(pairs: list[tuple[int, int]], a: list[str]) -> list[tuple[int, int]]:
    """The same match with equal words of the text chosen as near to one another as they stand."""
    at = [i for i, _ in pairs]
    for k in range(len(at) - 2, -1, -1):
        at[k] = next(i for i in range(at[k + 1] - 1, at[k] - 1, -1) if a[i] == a[at[k]])
    for k in range(1, len(at)):
        at[k] = next(i for i in range(at[k - 1] + 1, at[k] + 1) if a[i] == a[at[k]])
    return [(i, j) for i, (_, j) in zip(at, pairs, strict=True)]


def scan(text: str, known: list[Template], coverage: float) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, start, end) of each place where a license stands.

    Of matches that overlap, the one with most matched words is kept.
    """
    spans, words = [], []
    for m in WORD.finditer(text):  # lower case may be longer
        spans.append(m.span())
        words.append(m.group().lower())
    where: dict[str, list[int]] = {}
    keys = frozenset().union(*(t.keys for t in known)) if known else frozenset()
    for i, w in enumerate(words):
        if w in keys:
            where.setdefault(w, []).append(i)
    found = []
    for t in known:
        n, own = len(t.words), frozenset(t.words)
        for lo, hi in regions([where[k] for k in t.keys if k in where], n, len(words)):
            todo = [(lo, hi)]
            while todo:  # several matches may stand in one stretch
                lo, hi = todo.pop()
                here = words[lo:hi]
                pairs = dense(patience(here, list(t.words)), n)
                if len(pairs) < coverage * n - 1e-9:
                    # copies near one another leave no unique words
                    if len(here) > n + n // 2 and sum(map(own.__contains__, here)) >= coverage * n - 1e-9:
                        todo += windows(lo, hi, n)
                    continue
                pairs = tight(pairs, here)
                first, last = lo + pairs[0][0], lo + pairs[-1][0]
                found.append((len(pairs), t.license, len(pairs) / n, first, last))
                todo += [(lo, first), (last + 1, hi)]
    out, taken = [], []
    for matched, name, share, first, last in sorted(found, key=lambda f: (-f[0], -f[2], f[4] - f[3], f[1], f[3])):
        if all(last < lo or first > hi for lo, hi in taken):
            taken.append((first, last))
            out.append((name, share, matched, spans[first][0], spans[last][1]))
    return sorted(out, key=lambda f: (f[3], f[0]))


def find_licenses(docs: DataFrame, *, texts: dict[str, tuple[str, ...]] | None = None, coverage: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per license notice: id, license, coverage, matched, start, end, passage.

    start and end are character offsets in the text as it stands, whatever its case. Null and
    empty texts have none;
    repeated rows give repeated rows; only the named columns are read.
    """
    known = templates(TEMPLATES if texts is None else texts, coverage)
    keys = sorted(frozenset().union(*(t.keys for t in known))) if known else []
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # what counts as a letter outside ASCII differs between the JVM and Python: words end there too
    d = d.where(F.lower("text").rlike(r"(?<![a-z0-9_])(?:" + "|".join(map(re.escape, keys)) + r")(?![a-z0-9_])") if keys else F.lit(False))
    kind = d.schema["id"].dataType.simpleString()

    def run(cols: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {k: [] for k in ("id", "license", "coverage", "matched", "start", "end", "passage")}
        for i, text in zip(cols["id"], cols["text"], strict=True):
            for name, share, matched, start, end in scan(text, known, coverage):
                for k, v in zip(out, (i, name, share, matched, start, end, text[start:end]), strict=True):
                    out[k].append(v)
        return out

    return map_batches(d, run, f"id {kind}, license string, coverage double, matched int, start int, end int, passage string").withColumnRenamed("id", id_col)
