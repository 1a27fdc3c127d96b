"""Licence scans: units of a text against licence templates by the Dice coefficient over word bigrams.

The units of a text are its lines, its paragraphs (runs of lines that are not blank) and the whole.
A unit whose number of bigrams cannot reach the threshold with a template's is never compared with
it: 2 min(a, b) / (a + b) bounds the coefficient, which leaves b within a factor (2 - t) / t of a.
Windows slide over the whole text as well, so that a licence in the midst of a line, or over several
paragraphs of a longer text, is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
# Licence notices and short licence texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal public domain dedication."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
)
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words, lower-cased, without punctuation."""
    return _WORD.findall(text.lower())


def bigrams(found: list[str]) -> set[str]:
    """Pairs of neighbouring words; a single word is one."""
    return set(map(" ".join, zip(found, found[1:]))) if len(found) > 1 else set(found)


def dice(a: set[str], b: set[str]) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


@dataclass
class Scanner:
    """Templates in order of size; ``threshold`` is in (0, 1]."""

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    threshold: float = THRESHOLD

    def __post_init__(self) -> None:
        sets = [(name, bigrams(words(text))) for name, text in self.templates]
        self.sets = sorted(((len(s), n, s) for (n, s), (_, text) in zip(sets, self.templates) if len(words(text)) > 1), key=lambda x: x[:2])
        factor = (2 - self.threshold) / self.threshold
        self.bounds = [(size / factor - 1e-9, size * factor + 1e-9) for size, _, _ in self.sets]
        self.every = set().union(*[s for _, _, s in self.sets])
        # A match shares at least threshold / 2 of both sizes, of which the smaller is a bound's.
        self.least = min((self.threshold / 2 * (size + low) for (size, _, _), (low, _) in zip(self.sets, self.bounds)), default=0) - 1e-6

    def best(self, s: set[str]) -> tuple[float, str] | None:
        """The highest coefficient that reaches the threshold, and its licence; ties go to the first name."""
        found = None
        for (_, name, t), (low, high) in zip(self.sets, self.bounds):
            if low <= len(s) <= high:
                d = dice(s, t)
                if d >= self.threshold and (found is None or (-d, name) < (-found[0], found[1])):
                    found = (d, name)
        return found

    def windows(self, each: list[list[str]], whole: set[str]) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first line, lines) of the best windows of words that match and don't overlap.

        The best window starts and ends with a bigram of the template, and the first one is not there
        again: a shorter window has a higher coefficient or the same bigrams. So no others are tried.
        """
        flat = [w for x in each for w in x]
        line = [i for i, x in enumerate(each) for _ in x]
        pairs = list(map(" ".join, zip(flat, flat[1:])))
        found = []
        for (size, name, t), (low, high) in zip(self.sets, self.bounds):
            if len(whole & t) < self.threshold / 2 * (size + low) - 1e-6:
                continue
            at = [i for i, p in enumerate(pairs) if p in t]
            for start in at:
                seen: set[str] = set()
                shared, best = 0, None
                for end in range(start, len(pairs)):
                    p = pairs[end]
                    if p in seen:
                        if p == pairs[start]:
                            break
                        continue
                    seen.add(p)
                    if len(seen) > high:
                        break
                    if p in t:
                        shared += 1
                        d = 2 * shared / (len(seen) + size)
                        if d >= self.threshold and (best is None or d > best[0]):
                            best = (d, end)
                if best:
                    found.append((-best[0], name, start, best[1]))
        taken: list[tuple[int, int]] = []
        out = []
        for d, name, start, end in sorted(found):
            # Windows hold the words from start to end + 1.
            if all(end + 1 < a or b + 1 < start for a, b in taken):
                taken.append((start, end))
                out.append((name, -d, line[start], line[end + 1] - line[start] + 1))
        return out

    def scan(self, text: str | None, windows: bool = False) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first line, lines) of every unit that matches, and of windows that no unit stands for."""
        lines = (text or "").split("\n")
        each = [words(x) for x in lines]
        # The whole's bigrams hold those of every unit.
        whole = bigrams([w for x in each for w in x])
        if len(whole & self.every) < self.least:
            return []
        units = [(i, 1) for i in range(len(lines))]
        start = None
        for i, line in enumerate([*lines, ""]):
            if line.strip() and start is None:
                start = i
            elif not line.strip() and start is not None:
                units.append((start, i - start))
                start = None
        units.append((0, len(lines)))
        out = []
        for first, n in dict.fromkeys(units):
            if sum(map(len, each[first : first + n])) < 2:
                continue
            s = bigrams(each[first]) if n == 1 else bigrams([w for x in each[first : first + n] for w in x])
            found = self.best(s)
            if found:
                out.append((found[1], found[0], first, n))
        if windows:
            covers = lambda u, m: u[0] == m[0] and u[1] >= m[1] and u[2] <= m[2] and m[2] + m[3] <= u[2] + u[3]
            out += [m for m in self.windows(each, whole) if not any(covers(u, m) for u in out)]
        return sorted(out, key=lambda m: (m[2], m[3]))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, windows: bool = False) -> DataFrame:
    """doc_id, license, dice, n_matches and matches (license, dice, first_line, lines) of every document.

    ``license`` is that of the highest coefficient, ties going to the first unit. With ``windows`` (as
    in op9_license_scan) any run of words is compared too. Defined cases:
    null and empty texts, and texts without a match, have a null license, dice 0 and no matches; a
    template of fewer than two words is left out; a text of any length is compared whole;
    repeated ids give repeated rows; an empty table gives no rows; further columns are never read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, threshold)
        for b in batches:
            found = [scanner.scan(t if isinstance(t, str) else None, windows) for t in b["__text"]]
            top = [max(m, key=lambda x: x[1]) if m else (None, 0.0) for m in found]
            yield pd.DataFrame({"doc_id": b["doc_id"], "license": [t[0] for t in top], "dice": [t[1] for t in top], "n_matches": [len(m) for m in found], "matches": found})

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text"))
    return ids.mapInPandas(run, "doc_id long, license string, dice double, n_matches long, matches array<struct<license:string,dice:double,first_line:long,lines:long>>")
