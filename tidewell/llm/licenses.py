"""Licence scan: stretches of a text compared to licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised to lower-case words of letters, digits and dots. Stretches are the whole text, its
paragraphs and lines, and every run of as many bigrams as a template has, so a notice is found wherever it stands. A
template of n bigrams can only reach a coefficient of c with a stretch of c / (2 - c) * n to (2 - c) / c * n bigrams, so
templates are sorted by size and a stretch meets only those within the bounds. A stretch that reaches c also holds
c / (2 - c) * n of the template's bigrams, so one of any set of more than the rest: each template has such a set of
telling bigrams with long words, and a text with none of a template's telling words isn't compared to it. Hashes of all
words sort such texts out a block at a time, before a text is split in Python.

A text may hold several licences: stretches are taken best first, and each further one must not overlap those taken.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_limits
from .words import Words, blocks

LEAST = 0.8

# Well-known public licence notices and short licence statements. What follows # tells templates of one
# licence apart.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT#statement": "Released under the MIT License.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0#statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0#statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "CC-BY-NC-4.0#statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.""",
    "BSD-2-Clause#clauses": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause#clauses": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}

# Licence identifiers, and the names that short statements give them.
NAMES = {
    "MIT": ("MIT", "MIT License"),
    "Apache-2.0": ("Apache-2.0", "Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0"),
    "GPL-2.0": ("GPL-2.0", "GPLv2", "GNU GPL v2", "GNU General Public License v2.0"),
    "GPL-3.0": ("GPL-3.0", "GPLv3", "GNU GPL v3", "GNU General Public License v3.0"),
    "LGPL-2.1": ("LGPL-2.1", "LGPLv2.1", "GNU Lesser General Public License v2.1"),
    "LGPL-3.0": ("LGPL-3.0", "LGPLv3", "GNU Lesser General Public License v3.0"),
    "AGPL-3.0": ("AGPL-3.0", "AGPLv3", "GNU Affero General Public License v3.0"),
    "BSD-2-Clause": ("BSD-2-Clause", "BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD-3-Clause", "BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC", "ISC License"),
    "MPL-2.0": ("MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("EPL-2.0", "Eclipse Public License 2.0"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "CC0-1.0": ("CC0-1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC-BY-4.0", "CC BY 4.0"),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
}
STATEMENTS = ("License: {}", "Licensed under {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}")


def statements() -> dict[str, str]:
    """Templates of short statements: the identifier tags, and each way of naming each licence."""
    tags = {f"{id}#tag{suffix}": f"SPDX-License-Identifier: {id}{suffix}" for id in NAMES for suffix in ("", "-only", "-or-later") if not suffix or "GPL" in id}
    return tags | {f"{id}#{form.format(name)}": form.format(name) for id, names in NAMES.items() for name in names for form in STATEMENTS}


_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")


def normalised(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def pairs(words: list[str]) -> list[tuple[str, str]]:
    """Neighbouring words; a single word makes a bigram with nothing."""
    return list(zip(words, words[1:])) if len(words) > 1 else [(w, "") for w in words]


def bigrams(words: list[str]) -> Counter:
    return Counter(pairs(words))


def dice(a: Counter, b: Counter) -> float:
    """Twice the shared bigrams over all of both; 0 without any."""
    both = a.total() + b.total()
    return 2 * (a & b).total() / both if both else 0.0


#: Letters that Unicode lower-cases to ASCII ones.
_TO_ASCII = ("\u212a".encode(), "\u0130".encode())
_ASCII = np.zeros(256, bool)
_ASCII[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


class Found(NamedTuple):
    license: str
    dice: float
    first: int
    words: int


FOUND = "array<struct<license:string,dice:double,first:int,words:int>>"


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.grams = {name: g for name, t in templates.items() if (g := bigrams(normalised(t)))}
        self.total = {name: g.total() for name, g in self.grams.items()}
        self.by_size = sorted((n, name) for name, n in self.total.items())
        self.sizes = [n for n, _ in self.by_size]
        #: Word -> templates; a text that reaches the coefficient with a template has one of its words.
        self.telling: dict[str, set[str]] = {}
        for name in self.grams:
            for word in self.telling_words(name):
                self.telling.setdefault(word, set()).add(name)
        first = [w.split(".")[0] for w in self.telling]
        self.every_text = not all(w.isascii() for w in first)
        told = Words(pa.array([" ".join(first)]), _ASCII)
        self.told = np.unique(told.hashes(lower=True))

    def telling_words(self, name: str) -> set[str]:
        """The longer words of bigrams that make up more of the template than a stretch may lack."""
        lacked = self.total[name] - ceil(self.total[name] * self.least / (2 - self.least) - 1e-9)
        out, n = set(), 0
        for gram, times in sorted(self.grams[name].items(), key=lambda x: (-max(map(len, x[0])), x[0])):
            if n > lacked:
                break
            out.add(max(gram, key=len))
            n += times
        return out

    def worth_scanning(self, block: pa.Array) -> np.ndarray:
        """Which texts of a block may have a telling word: one of their runs of ASCII letters and digits is (the beginning
        of) one, or Unicode's lower case might make one."""
        if self.every_text or not self.told.size:
            return np.full(len(block), self.every_text)
        w = Words(block, _ASCII)
        h = w.hashes(lower=True)
        at = np.searchsorted(self.told, h).clip(max=self.told.size - 1)
        sums = np.concatenate([[0], np.cumsum(self.told[at] == h)])
        out = np.diff(sums[w.of]) > 0
        data = w.data.tobytes()
        if any(x in data for x in _TO_ASCII):
            out |= [any(x in data[a:b] for x in _TO_ASCII) for a, b in zip(w.texts, w.texts[1:])]
        return out

    def bounds(self, n: int) -> tuple[float, float]:
        """The template sizes that a stretch of n bigrams can reach the coefficient with."""
        return n * self.least / (2 - self.least), n * (2 - self.least) / self.least

    def candidates(self, n: int) -> list[str]:
        low, high = self.bounds(n)
        return [name for _, name in self.by_size[bisect_left(self.sizes, low - 1e-9) : bisect_right(self.sizes, high + 1e-9)]]

    def runs(self, grams: list[tuple[str, str]], name: str) -> Iterator[tuple[int, int, int]]:
        """(shared bigrams, place, size) of the runs of the template's size that begin at one of its bigrams and reach
        the coefficient. The shared count is kept as bigrams enter and leave."""
        wanted, size = self.grams[name], self.total[name]
        hits = [i for i, g in enumerate(grams) if g in wanted]
        inside, shared, end = Counter(), 0, 0
        for i in hits:
            while end < len(hits) and hits[end] < i + size:
                g = grams[hits[end]]
                inside[g] += 1
                shared += inside[g] <= wanted[g]
                end += 1
            own = min(size, len(grams) - i)
            if 2 * shared >= self.least * (size + own) - 1e-9:
                yield shared, i, own
            shared -= inside[grams[i]] <= wanted[grams[i]]
            inside[grams[i]] -= 1

    def parts(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """First word and words of the whole text, its paragraphs and their lines."""
        yield 0, normalised(text)
        at = 0
        for paragraph in text.split("\n\n"):
            lines = [normalised(line) for line in paragraph.split("\n")]
            yield at, [w for line in lines for w in line]
            for line in lines:
                yield at, line
                at += len(line)

    def scan(self, text: str) -> list[Found]:
        """The licences of a text, best first: on the stretch that shares most bigrams with a template, of equal ones the
        higher coefficient, then the first by name and place; then the best of the stretches that don't overlap it, and
        so on."""
        words = normalised(text)
        names = set().union(*(self.telling[w] for w in self.telling.keys() & set(words)))
        if not names:
            return []
        found: set[tuple[int, float, str, int, int]] = set()
        grams = pairs(words)
        for name in names:
            for shared, at, size in self.runs(grams, name):
                found.add((-shared, -2 * shared / (self.total[name] + size), name, at, size + (len(words) > 1)))
        for first, part in self.parts(text):
            near = [n for n in self.candidates(len(pairs(part))) if n in names]
            own = bigrams(part) if near else None
            for name in near:
                shared = (own & self.grams[name]).total()
                if 2 * shared >= self.least * (own.total() + self.total[name]) - 1e-9:
                    found.add((-shared, -2 * shared / (own.total() + self.total[name]), name, first, len(part)))
        out: list[Found] = []
        taken: list[tuple[int, int]] = []
        for _, d, name, first, n in sorted(found):
            k = bisect_left(taken, (first, first))
            if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or first + n <= taken[k][0]):
                taken.insert(k, (first, first + n))
                out.append(Found(name.split("#")[0], -d, first, n))
        return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, license, dice, found: one row per input row; license is null and dice 0 where no template reaches ``least``.

    found: license, dice, first word and number of words of each stretch, best first, none overlapping another; license
    and dice: those of the best. Best: the stretch that shares most bigrams with a template, of equal ones that of the
    higher coefficient, then the first template by name, then the first place. A template of several names (the part
    before #) may be found several times. Null and empty texts have none. Null keys and repeated rows are rows like
    others. Empty input: no rows. Further columns aren't read.
    """
    arrow_limits(docs.sparkSession)
    templates = TEMPLATES | statements() if templates is None else templates
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first", pa.int32()), ("words", pa.int32())]))

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(templates, least)
        for texts in batches:
            got: list[list[dict]] = [[] for _ in range(len(texts))]
            for first, block in blocks(texts):
                for k in np.flatnonzero(scanner.worth_scanning(block)).tolist():
                    got[first + k] = [f._asdict() for f in scanner.scan(block[k].as_py() or "")]
            yield pa.array(got, kind)

    found = docs.select(F.col(key).alias("doc_id"), F.arrow_udf(scan, FOUND)(F.col(text)).alias("found"))
    best = F.try_element_at("found", F.lit(1))
    return found.select("doc_id", best["license"].alias("license"), F.coalesce(best["dice"], F.lit(0.0)).alias("dice"), "found")
