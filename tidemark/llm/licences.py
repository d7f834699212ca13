"""License scans by patience alignment.

Each text is aligned with license notices: words unique to both are anchors, the longest increasing subsequence of anchors stays
in order, and the gaps between them are aligned again in the same way; where no unique word is left, equal words
at a gap's ends count. A notice is found where aligned words cover enough of it.

A text is looked at closely only around its gate words: of each notice so many of its rarest words that no text without
any of them could reach the coverage. So nothing is missed.

The result has a row for each notice found in a text: texts without one aren't in it. Null text counts as empty; doc_id is
carried, null and repeated ones too; other columns are ignored; rows don't move, so long texts and hot sources cost their
own partitions alone. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import arrow_map, texts

#: Least part of a notice's words that are aligned, and of the words between the first and last aligned one that belong to it.
MIN_COVERAGE, MIN_DENSITY = 0.8, 0.5
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

#: Wording of public license notices.
NOTICES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k:
            before[i] = ends[k - 1]
        if k == len(tops):
            tops.append(v), ends.append(i)
        else:
            tops[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of aligned words of a and b, in order. Gaps wait on a stack, so deep recursion can't overflow."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        once_a, once_b = ({w for w, n in Counter(x).items() if n == 1} for x in (a[i:j], b[k:m]))
        both = once_a & once_b
        at = {w: p for p, w in enumerate(b[k:m], k) if w in both}
        found = [(p, at[w]) for p, w in enumerate(a[i:j], i) if w in both]
        anchors = [found[x] for x in increasing([q for _, q in found])]
        if not anchors:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)], strict=True):
            todo.append((p + 1, r, q + 1, s))
    return sorted(out)


class Scanner:
    """Notices with their gate words."""

    def __init__(self, notices: dict[str, str], coverage: float = MIN_COVERAGE) -> None:
        self.notices = {name: words(text) for name, text in notices.items()}
        share = Fraction(str(coverage))  # as written: 0.8 * 5 is 4
        self.least = {name: ceil(share * len(ws)) for name, ws in self.notices.items()}  # words that must be aligned
        held = Counter(w for ws in self.notices.values() for w in set(ws))
        self.gates: dict[str, list[str]] = {}  # gate word -> notices
        for name, ws in self.notices.items():
            counts, got = Counter(ws), 0
            for w in sorted(counts, key=lambda w: (-len(w), held[w], w)):  # long words are the rarest in any text
                self.gates.setdefault(w, []).append(name)
                got += counts[w]
                if len(ws) - got < self.least[name]:
                    break
        self.gate = re.compile("|".join(sorted(map(re.escape, self.gates), key=lambda w: (-len(w), w))))

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """Notices in text: name, first and last aligned word (end exclusive), coverage. In order of place; none overlap."""
        low = text.lower()
        if not self.gate.search(low):
            return []
        ws = _WORD.findall(low)
        hits: dict[str, list[int]] = {}
        for at, w in enumerate(ws):
            for name in self.gates.get(w, ()):
                hits.setdefault(name, []).append(at)
        found = []
        for name in sorted(hits):
            notice = self.notices[name]
            free = 0  # words before it belong to a found one
            for at in hits[name]:
                if at < free:
                    continue
                place = notice.index(ws[at])
                # close to where the gate word puts the notice, so that a second copy nearby takes no word's uniqueness; then wider
                for slack in (len(notice) // 4 + 2, 2 * len(notice)):
                    start = max(free, at - place - slack)
                    pairs = patience(ws[start : at - place + len(notice) + slack], notice)
                    if len(pairs) >= self.least[name]:
                        a, b = start + pairs[0][0], start + pairs[-1][0] + 1
                        if len(pairs) >= MIN_DENSITY * (b - a):
                            found.append((len(pairs), len(pairs) / len(notice), name, a, b))
                            free = b
                            break
        # where notices overlap, the one with more aligned words stays (so a notice wins over one that it contains), then the better covered one
        taken: list[tuple[int, int]] = []
        out = []
        for _, covered, name, a, b in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            k = bisect_left(taken, (a, b))
            if (k == len(taken) or taken[k][0] >= b) and (not k or taken[k - 1][1] <= a):
                taken.insert(k, (a, b))
                out.append((name, a, b, covered))
        return sorted(out, key=lambda x: (x[1], x[0]))


def scans(docs: DataFrame, notices: dict[str, str] | None = None, coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per notice found: doc_id, license, start_word, end_word, coverage."""
    scanner = Scanner(notices or NOTICES, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *x) for k, text in enumerate(batch.column("text").to_pylist()) for x in scanner.scan(text)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.float64())], ["doc_id", "license", "start_word", "end_word", "coverage"])

    return arrow_map(texts(docs), run, "doc_id long, license string, start_word long, end_word long, coverage double")
