"""License scan: winnowed fingerprints of templates in an inverted index, then banded local alignment.

Words are runs of letters and digits in lower case. Fingerprints are hashes of ``GRAM`` words in a row; of each
``SPAN`` neighbouring ones the smallest is kept, in templates and texts alike, so a common run of
``GRAM + SPAN - 1`` (five) words always has a fingerprint in common. Fingerprints that meet give candidate places;
an alignment in a band around them finds which words of the template stand in the text, and where.

Versions and the words that tell kin apart ("Lesser", "NonCommercial") must agree: a place with other such words is no
match, one with another version is reported as ``<family>-other-version``, unless a template of its own fits it. (A notice
of so few words that another version leaves no run of five in common is not met at all.)

Templates are a parameter: pairs of a name and a text of any length. Those given are whole texts of short licenses and the
notices by which files name long ones; names ending in -grant or -opening are parts that often stand alone. What share of
its whole license a part makes up is reported too.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleglass.llm.common import documents, slices
from saleglass.llm.decontamination import grams, hashes
from saleglass.llm.toxicity import words_of

GRAM, SPAN, BAND = 3, 3, 12
LEAST_WORDS, LEAST = 5, 0.8

# Words that tell kin apart, words that a version follows, and the whole license of each part.
KIN = frozenset(b"lesser affero nc sa nd noncommercial sharealike noderivatives noderivs".split())
BEFORE_VERSION = frozenset(b"version v by nc sa nd zero cc0 attribution noncommercial sharealike noderivatives gpl lgpl agpl mpl epl apache".split())
WHOLE = {"MIT-grant": "MIT", "ISC-grant": "ISC", "BSD-opening": "BSD-2-Clause", "Unlicense-opening": "Unlicense"}

# Whole texts of short licenses, and the notices that stand for long ones, as their publishers word them.
TEMPLATES = (
    ('MIT-notice', 'Released under the MIT License.'),
    ('MIT-notice', 'Licensed under the MIT License.'),
    (
        'MIT-grant',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        'rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit '
        'persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice '
        'and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    ('Apache-2.0-notice', 'Licensed under the Apache License, Version 2.0.'),
    (
        'Apache-2.0-notice',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        'the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by '
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        'WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
        'governing permissions and limitations under the License.',
    ),
    ('GPL-3.0-notice', 'This work is licensed under the GNU General Public License, version 3.'),
    ('GPL-2.0-notice', 'This work is licensed under the GNU General Public License, version 2.'),
    (
        'GPL-3.0-notice',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public '
        'License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later '
        'version.',
    ),
    (
        'GPL-2.0-notice',
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public '
        'License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later '
        'version.',
    ),
    ('CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
    ('CC-BY-4.0', 'Licensed under CC BY 4.0.'),
    ('CC-BY-SA-4.0', 'Licensed under CC BY-SA 4.0.'),
    ('CC-BY-3.0', 'Licensed under CC BY 3.0.'),
    ('CC-BY-SA-3.0', 'Licensed under CC BY-SA 3.0.'),
    ('CC-BY-3.0', 'This work is licensed under a Creative Commons Attribution 3.0 Unported License.'),
    ('CC-BY-SA-3.0', 'This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.'),
    ('CC-BY-ND-4.0', 'Licensed under CC BY-ND 4.0.'),
    ('CC-BY-NC-SA-4.0', 'Licensed under CC BY-NC-SA 4.0.'),
    ('CC-BY-NC-ND-4.0', 'Licensed under CC BY-NC-ND 4.0.'),
    ('CC-BY-4.0', 'This work is licensed under a Creative Commons Attribution 4.0 International License.'),
    ('CC-BY-NC-4.0', 'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.'),
    ('CC-BY-SA-4.0', 'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.'),
    ('CC-BY-ND-4.0', 'This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.'),
    ('CC-BY-NC-SA-4.0', 'This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.'),
    ('CC-BY-NC-ND-4.0', 'This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.'),
    ('CC0-1.0-notice', 'This work is marked with CC0 1.0 Universal.'),
    (
        'CC0-1.0-notice',
        'To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this '
        'software to the public domain worldwide. This software is distributed without any warranty. You should have received a '
        'copy of the CC0 Public Domain Dedication along with this software. If not, see '
        '<http://creativecommons.org/publicdomain/zero/1.0/>.',
    ),
    (
        'EPL-2.0-notice',
        'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is '
        'available at https://www.eclipse.org/legal/epl-2.0/',
    ),
    (
        'LGPL-2.1-notice',
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public '
        'License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later '
        'version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the '
        'implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for '
        'more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, '
        'write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA',
    ),
    (
        'BSD-opening',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the '
        'following conditions are met: Redistributions of source code must retain the above copyright notice, this list of '
        'conditions and the following disclaimer.',
    ),
    (
        'ISC-grant',
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby '
        'granted, provided that the above copyright notice and this permission notice appear in all copies.',
    ),
    (
        'MPL-2.0-notice',
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not '
        'distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.',
    ),
    (
        'Unlicense-opening',
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, '
        'compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, '
        'commercial or non-commercial, and by any means.',
    ),
    (
        'MIT',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        'rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit '
        'persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice '
        'and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS '
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        'MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT '
        'HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, '
        'ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        'ISC',
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby '
        'granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS '
        'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        'OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR '
        'CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF '
        'CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS '
        'SOFTWARE.',
    ),
    (
        'BSD-2-Clause',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the '
        'following conditions are met: Redistributions of source code must retain the above copyright notice, this list of '
        'conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, '
        'this list of conditions and the following disclaimer in the documentation and/or other materials provided with the '
        'distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        'WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR '
        'PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, '
        'INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE '
        'GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF '
        'LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT '
        'OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        'BSD-3-Clause',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the '
        'following conditions are met: Redistributions of source code must retain the above copyright notice, this list of '
        'conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, '
        'this list of conditions and the following disclaimer in the documentation and/or other materials provided with the '
        'distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or '
        'promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY '
        'THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        'THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE '
        'COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL '
        'DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR '
        'BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT '
        '(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE '
        'POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        'Unlicense',
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, '
        'compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, '
        'commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors '
        'of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication '
        'for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to '
        'be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. '
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        'WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE '
        'LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, '
        'OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please '
        'refer to <https://unlicense.org>',
    ),
    (
        'Zlib',
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        'liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for '
        'any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following '
        'restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original '
        'software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated '
        'but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being '
        'the original software. This notice may not be removed or altered from any source distribution.',
    ),
    (
        'GPL-3.0-notice',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public '
        'License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later '
        'version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the '
        'implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more '
        'details. You should have received a copy of the GNU General Public License along with this program. If not, see '
        '<https://www.gnu.org/licenses/>.',
    ),
    (
        'GPL-2.0-notice',
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public '
        'License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later '
        'version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the '
        'implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more '
        'details. You should have received a copy of the GNU General Public License along with this program; if not, write to '
        'the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.',
    ),
    (
        'AGPL-3.0-notice',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General '
        'Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any '
        'later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even '
        'the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License '
        'for more details. You should have received a copy of the GNU Affero General Public License along with this program. If '
        'not, see <https://www.gnu.org/licenses/>.',
    ),
    (
        'LGPL-3.0-notice',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General '
        'Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any '
        'later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even '
        'the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License '
        'for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If '
        'not, see <https://www.gnu.org/licenses/>.',
    ),
)


COLUMNS = (("license", "string"), ("n_words", "int"), ("n_matched", "int"), ("coverage", "double"), ("first_word", "int"), ("end_word", "int"), ("whole_coverage", "double"))


def winnowed(keys: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places of fingerprints that are smallest among ``SPAN`` neighbours of one text. ``last``: last place of the
    text that each place lies in; texts of fewer fingerprints keep their smallest."""
    place = np.arange(len(keys))
    low = keys.copy()
    for k in range(1, SPAN):
        at = np.minimum(place + k, last)
        low = np.minimum(low, keys[at])
    chosen = keys == low
    for k in range(1, SPAN):
        same = place - k >= 0
        same[k:] &= last[k:] == last[:-k]
        chosen |= same & (keys == low[np.maximum(place - k, 0)])
    return np.flatnonzero(chosen)


def align(pattern: list[bytes], text: list[bytes], shift: int, band: int) -> tuple[int, int, int] | None:
    """Best local alignment with text place - pattern place within ``band`` of ``shift``: (matched words, start, end)."""
    best, previous = (0, 0, 0, 0), {}
    for i, w in enumerate(pattern):
        row = {}
        for j in range(max(0, i + shift - band), min(len(text), i + shift + band + 1)):
            score, matched, start = previous.get(j - 1, (0, 0, j))
            cell = (score + 2, matched + 1, start) if text[j] == w else (score - 1, matched, start)
            for other in (previous.get(j), row.get(j - 1)):
                if other and other[0] - 1 > cell[0]:
                    cell = other[0] - 1, other[1], other[2]
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > best[0]:
                    best = *cell, j + 1
        previous = row
    return best[1:] if best[0] else None


def marks(words: list[bytes]) -> tuple[frozenset[bytes], frozenset[tuple[bytes, ...]]]:
    """Words that tell kin apart, and versions: the numbers that follow a word of ``BEFORE_VERSION`` directly."""
    versions = set()
    for i, w in enumerate(words):
        if w in BEFORE_VERSION:
            end = i + 1
            while end < len(words) and words[end].isdigit() and len(words[end]) <= 2:
                end += 1
            if end > i + 1:
                versions.add(tuple(words[i + 1 : end]))
    return KIN.intersection(words), frozenset(versions)


def family(name: str) -> str:
    """The name up to its version."""
    return re.split(r"-v?\d", name, maxsplit=1)[0]


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.rows = [(name, w) for name, text in templates if len(w := words_of(text)) >= LEAST_WORDS]
        self.marks = [marks(w) for _, w in self.rows]
        sizes: dict[str, int] = {}
        for name, w in self.rows:
            sizes[name] = max(len(w), sizes.get(name, 0))
        self.whole = {name: sizes.get(WHOLE.get(name, name), n) for name, n in sizes.items() if name in WHOLE}
        places = defaultdict(list)
        for t, (_, w) in enumerate(self.rows):
            keys = grams(hashes(w), GRAM)[: len(w) - GRAM + 1]
            for i in winnowed(keys, np.full(len(keys), len(keys) - 1)):
                places[int(keys[i])].append((t, int(i)))
        self.index = places
        self.keys = np.array(sorted(places), np.uint64)

    def matches(self, words: list[bytes], hits: list[tuple[int, int]]) -> list[tuple[str, int, int, int, int]]:
        """(name, template words, matched, start, end) in one text, the best where spans overlap; other versions come
        last. ``hits``: place and fingerprint."""
        shifts = defaultdict(set)
        for place, key in hits:
            for t, i in self.index[key]:
                shifts[t].add(place - i)
        found = []
        for t, own in shifts.items():
            name, pattern = self.rows[t]
            last = None
            for s in sorted(own):
                if last is not None and s - last <= BAND:
                    continue
                last = s
                lo = max(0, s - BAND)
                hit = align(pattern, words[lo : s + len(pattern) + BAND + 1], s - lo, 2 * BAND)
                if hit and hit[0] >= LEAST_WORDS and hit[0] >= LEAST * len(pattern):
                    end = lo + hit[2]
                    if words[end - 1] in BEFORE_VERSION:  # another version follows the last word that fits
                        end += 2
                    kin, versions = marks(words[lo + hit[1] : end])
                    if kin != self.marks[t][0]:
                        continue
                    other = versions != self.marks[t][1] and self.marks[t][1] != frozenset()
                    found.append((other, f"{family(name)}-other-version" if other else name, len(pattern), hit[0], lo + hit[1], lo + hit[2]))
        found.sort(key=lambda x: (x[0], -x[3], x[2], x[4], x[1]))
        chosen: list[tuple[str, int, int, int, int]] = []
        for _, *x in found:
            if all(x[4] <= y[3] or x[3] >= y[4] for y in chosen):
                chosen.append(tuple(x))
        return sorted(chosen, key=lambda x: x[3])

    def scan(self, texts: list) -> Iterator[tuple[int, tuple[str, int, int, int, int]]]:
        for a, b in slices(texts):
            words = [words_of(t) for t in texts[a:b]]
            sizes = np.array([len(w) for w in words], np.int64)
            flat = hashes([x for w in words for x in w])
            if not len(flat):
                continue
            keys = grams(flat, GRAM)
            first = np.cumsum(sizes) - sizes
            text = np.repeat(np.arange(len(words)), sizes)
            last = np.maximum(first, first + sizes - GRAM)[text]
            keys[np.arange(len(keys)) > last] = np.uint64(2**64 - 1)  # runs past the end of a text
            at = winnowed(keys, np.minimum(last, len(keys) - 1))
            k = np.searchsorted(self.keys, keys[at])
            at = at[self.keys[np.minimum(k, len(self.keys) - 1)] == keys[at]]
            hits = defaultdict(list)
            for p in at.tolist():
                hits[int(text[p])].append((p - int(first[text[p]]), int(keys[p])))
            for t, own in hits.items():
                for m in self.matches(words[t], own):
                    yield a + t, m


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License texts found in ``docs``: id, license, n_words (of the template), n_matched, coverage, first_word, end_word,
    whole_coverage (words matched for each word of the whole license, where the template is a part of one).

    One row for each place whose best template is covered to ``LEAST`` or more, in words. Null, empty and short texts
    have none; repeated rows are reported again; an empty table gives no rows; other columns are ignored. The templates
    are part of the program, so what tasks hold doesn't grow with the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in batches:
            rows = list(known.scan(batch.column(1).to_pylist()))
            at = pa.array([t for t, _ in rows], pa.int64())
            cols = [pa.array([m[i] for _, m in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()))]
            cover = pa.array([m[2] / m[1] for _, m in rows], pa.float64())
            whole = pa.array([m[2] / known.whole.get(m[0], m[1]) for _, m in rows], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *cols[:3], cover, *cols[3:], whole], names=[id_col, *(name for name, _ in COLUMNS)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{name} {own}" for name, own in COLUMNS))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
