"""License scans by conditional compression.

A cue (license, copyright, permission, ...) opens a candidate block: the text around it up to ``REACH``
characters on either side, cut at white space; overlapping blocks are one. A block is compressed alone
and with each template as a zstandard raw dictionary; the bytes that the dictionary saves rank the templates, and those
that save ``GAIN`` of what the template itself takes compressed are the winners. From the highest rank on a winner is
confirmed by its exact wording: the place in the block where the template's words (letters and digits, any case)
differ least, counting words missing and words added inside the match, by dynamic programming over the words. A
match may differ by ``DIFFER`` of the template's words at most, from ``SHORT`` words on by one at least, and
never in a word that tells licenses apart: one with a digit (a version) or of ``TELLING``, missing or added.
Templates of which such a word is not in the block are passed over. A name of fewer than ``TINY`` characters (GPLv2, MIT
License) is too short for a dictionary to save anything; where its words are there, it is ranked behind the others by
what little it saves, and confirmed by its exact wording alone. The words of a confirmed match do not count again;
the same template is looked for once more in the rest, then the next one. Of a license's wordings that fit at a place,
the one with most words the same counts, a difference against two.

After an ``SPDX-License-Identifier:`` a whole expression may stand: ids joined by AND and OR, in brackets, with a + or
an exception behind WITH. It is read first; every known id in it is a match of its own, with the ``expression``.

Every block of every whole text is scanned; a text without a cue has no block. Blocks that grow beyond
``BLOCK`` characters are scanned in pieces that overlap by more than the longest template. A null text
counts as empty. Null ids, repeated rows and extra columns pass; a document without a match has no row.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.llm.common import map_batches

REACH = 400
BLOCK = 8_000
GAIN = 0.1
DIFFER = 0.1
SHORT = 5
TINY = 24
LEVEL = 9

# fixed values: license statements and notices, by name
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "reserved": ["All rights reserved."],
}


def _more(name: str, *texts: str) -> None:
    TEMPLATES[name] = TEMPLATES.get(name, []) + [t for t in texts if t not in TEMPLATES.get(name, [])]


_BSD2 = (TEMPLATES["BSD"][1] + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
         "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
         "disclaimer in the documentation and/or other materials provided with the distribution.")
_more("BSD-2-Clause", _BSD2)
_more("BSD-3-Clause", _BSD2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
      "derived from this software without specific prior written permission.")
_FREE = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as "
         "published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
_more("AGPL-3.0", _FREE.format("Affero", "3"))
_more("LGPL-3.0", _FREE.format("Lesser", "3"))
_more("LGPL-2.1", _FREE.format("Lesser", "2.1"))
_more("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
      "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
      "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:")
_more("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
      "http://www.boost.org/LICENSE_1_0.txt)")
_more("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
      "available at https://www.eclipse.org/legal/epl-2.0/")
_more("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public "
      "License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html")
_more("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may "
      "not use this file except in compliance with the License.")
for _c, _long in (("NC-SA", "NonCommercial-ShareAlike"), ("NC-ND", "NonCommercial-NoDerivatives"), ("ND", "NoDerivatives")):
    _more(f"CC-BY-{_c}-4.0", f"Licensed under CC BY-{_c} 4.0.", f"This work is licensed under a Creative Commons Attribution-{_long} 4.0 International License.")
for _name, _forms in {
    "Apache-2.0": ["Apache License 2.0", "Apache 2.0 License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"],
    "Zlib": ["zlib License"], "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"], "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"], "EPL-2.0": ["Eclipse Public License 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0"], "CDDL-1.0": ["Common Development and Distribution License 1.0"],
    "GPL-2.0": ["GNU General Public License v2", "GNU GPL v2"], "GPL-3.0": ["GNU General Public License v3", "GNU GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License v3", "GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License v3", "GNU Affero General Public License, version 3"],
}.items():
    _more(_name, *[f"Licensed under the {f}." for f in _forms])
_more("MIT", "Distributed under the MIT License.")
_more("BSD-2-Clause", "BSD-2-Clause")
_more("BSD-3-Clause", "BSD-3-Clause")
# titles and names as they stand alone
for _name, _forms in {
    "MIT": ["MIT License"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"], "ISC": ["ISC License"], "Zlib": ["zlib License"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"], "BSL-1.0": ["Boost Software License 1.0", "Boost Software License Version 1.0"],
    "BSD-2-Clause": ["BSD 2-Clause", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause", "New BSD License"], "BSD": ["BSD License"],
    "EPL-2.0": ["Eclipse Public License 2.0"], "EPL-1.0": ["Eclipse Public License 1.0"], "Unlicense": ["The Unlicense"],
    "GPL-2.0": ["GNU General Public License Version 2", "GPLv2", "GPL v2", "GPL version 2"], "GPL-3.0": ["GNU General Public License Version 3", "GPLv3", "GPL v3", "GPL version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1", "LGPLv2.1", "LGPL v2.1"], "LGPL-3.0": ["GNU Lesser General Public License Version 3", "LGPLv3", "LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License Version 3", "AGPLv3", "AGPL v3"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"], "0BSD": ["0BSD", "BSD Zero Clause License", "Zero-Clause BSD License"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public License"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International"], "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International"],
}.items():
    _more(_name, *_forms)
_IDS: dict[str, str] = {}          # SPDX id in lower case -> name
for _name in [n for n in TEMPLATES if n not in ("BSD", "reserved")]:
    _ids = [_name, f"{_name}-only", f"{_name}-or-later"] if "GPL" in _name else [_name]
    _IDS |= {i.lower(): _name for i in _ids}
    _more(_name, *[f"SPDX-License-Identifier: {i}" for i in _ids])

# words that tell licenses apart: none may be missing; none but the everyday ones may be added
_EVERYDAY = {"by", "only", "later", "clause", "development", "distribution"}
TELLING = _EVERYDAY | {
    "apache", "bsd", "mit", "gnu", "gpl", "lgpl", "agpl", "affero", "lesser", "cc", "nc", "sa", "nd", "creative", "commons", "attribution",
    "noncommercial", "sharealike", "noderivatives", "noderivs", "isc", "mozilla", "mpl", "zlib", "boost", "bsl", "eclipse", "epl", "cddl", "unlicense", "wtfpl"}
_CUE = re.compile(r"licen[sc]|\bbsd-\d-clause\b|copyright|rights reserved|permission|redistribut|public domain|creative commons|\bcc[ -]by\b|free software"
                  r"|\b[al]?gpl|\bcc0\b|\b0bsd\b|\bwtfpl\b|fuck you want|\bapache[ -]2|\bmpl[ -]2|\bbsd (?:zero|[23])", re.I)
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*", re.I)
_PART = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.\-]*)(\+?))")
_WORD = re.compile(r"[A-Za-z0-9]+")


def _digit(w: str) -> bool:
    return any(c.isdigit() for c in w)


def _telling(words: list[str]) -> set[str]:
    """The words of a template that may not be missing; of a long one the names and versions only."""
    return {w for w in words if _digit(w) or w in TELLING and (len(words) < 20 or w not in _EVERYDAY)}


def _limit(n: int) -> float:
    """Differences allowed to a template of n words."""
    return max(DIFFER * n, 1 if n >= SHORT else 0)


@cache
def _templates():
    """(name, words, compressor with the template as dictionary, compressed size of the template, telling words, whether it is a
    short name)."""
    plain = zstandard.ZstdCompressor(level=LEVEL)
    frame = len(plain.compress(b""))
    out = []
    for name, texts in TEMPLATES.items():
        for t in texts:
            d = zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words = [w.lower() for w in _WORD.findall(t)]
            out.append((name, words, zstandard.ZstdCompressor(level=LEVEL, dict_data=d),
                        len(plain.compress(t.lower().encode())) - frame, _telling(words), len(t) < TINY))
    return plain, out


def blocks(text: str) -> list[tuple[int, int]]:
    """Stretches around cues; long ones in overlapping pieces."""
    found: list[list[int]] = []
    for m in _CUE.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if found and a <= found[-1][1]:
            found[-1][1] = b
        else:
            found.append([a, b])
    out = []
    for a, b in found:
        step = BLOCK - 4 * REACH
        out += [(i, min(b, i + BLOCK)) for i in range(a, max(a + 1, b - 4 * REACH), step)]
    return out


def _tells(w: str) -> bool:
    """Whether a word may not be added inside a match."""
    return _digit(w) or w in TELLING and w not in _EVERYDAY


def align(template: list[str], words: list[str]) -> tuple[int, int, int, int] | None:
    """(first, last + 1, missing, added) of the place where the template's words differ least from ``words`` (ties: the first end,
    then the last start); None if telling words differ everywhere. Row by row over the template's words: best cost and start
    for each end."""
    n, m = len(template), len(words)
    if not m:
        return None
    telling = _telling(template)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    text = np.fromiter((number[w] for w in words), np.int64, m)
    far = 1e9
    # cost of having added the words up to a place, so that a run of added words is a difference of two places
    added = np.concatenate(([0.0], np.cumsum([far if _tells(w) else 1.0 for w in words])))
    cost, start = np.zeros(m + 1), np.arange(m + 1)
    for w in template:
        base = cost + (far if w in telling else 1.0)                      # the template's word is missing
        came = start.copy()
        hit = np.flatnonzero(text == number.get(w, -1))
        better = cost[hit] <= base[hit + 1]
        at = hit[better] + 1
        base[at], came[at] = cost[at - 1], start[at - 1]
        # words added before an end: the best earlier place plus what lies between
        lead = base - added
        best = np.minimum.accumulate(lead)
        place = np.maximum.accumulate(np.where(lead <= best, np.arange(m + 1), 0))
        cost, start = best + added, came[place]
    end = int(np.argmin(cost))
    if cost[end] >= far / 2:
        return None
    first, diff = int(start[end]), int(round(cost[end]))
    same = (n + end - first - diff) // 2
    return (first, end, n - same, end - first - same) if same else None


def _expression(text: str, at: int) -> tuple[int, list[tuple[str, int, int]]]:
    """The end of the SPDX expression that begins at ``at``, and its known ids (name, start, end)."""
    found, depth, expect_id, end, exception = [], 0, True, at, False
    while m := _PART.match(text, at):
        bracket, word, plus = m.groups()
        if bracket == "(" and expect_id:
            depth += 1
        elif bracket == ")" and not expect_id and depth:
            depth -= 1
            end = m.end()
        elif word and expect_id:
            if word.upper() in ("AND", "OR", "WITH"):
                break
            word = word.rstrip(".-")
            stop = m.start(2) + len(word)
            if not exception and word.lower() in _IDS:
                found.append((_IDS[word.lower()], m.start(2), stop))
            expect_id, exception, end = False, False, stop + len(plus)
            if stop != m.end(2):                   # a full stop ends it
                break
        elif word and word in ("AND", "OR", "WITH", "and", "or", "with") and not expect_id:
            expect_id, exception = True, word.upper() == "WITH"
        else:
            break
        at = m.end()
    return end, found


def scan_text(text: str | None) -> list[tuple[str, int, int, float, int, int, str | None]]:
    """(license, start, end, gain, missing, added, expression) by start; code points."""
    plain, templates = _templates()
    out: dict[tuple[int, int], tuple] = {}
    for a, b in blocks(text or ""):
        part = text[a:b]
        data = part.lower().encode()
        alone = len(plain.compress(data))
        spots = [m.span() for m in _WORD.finditer(part)]
        words = [part[i:j].lower() for i, j in spots]
        known = set(words)
        saved = [(alone - len(c.compress(data)), size, name, t, tiny) for name, t, c, size, telling, tiny in templates
                 if telling <= known and (not tiny or known.issuperset(t))]
        winners = sorted((w for w in saved if w[4] or w[0] >= GAIN * w[1]), key=lambda w: (w[4], -w[0], -len(w[3]), w[2], w[3]))
        free = [(0, len(words))]                    # runs of words that no match has used

        def use(first: int, last: int) -> None:
            free[:] = [(x, y) for lo, hi in free for x, y in ((lo, min(hi, first)), (max(lo, last), hi)) if x < y]

        for m in _SPDX.finditer(part):
            end, ids = _expression(part, m.end())
            tag = " ".join(part[m.end():end].split())
            gain = {}
            for g, size, n, t, _ in saved:
                if t[0] == "spdx":
                    gain[n] = max(gain.get(n, 0.0), g / size)
            for name, i, j in ids:
                if gain.get(name, 0) >= GAIN:
                    out.setdefault((a + i, a + j), (name, a + i, a + j, round(gain[name], 4), 0, 0, tag))
            if ids:
                use(next(k for k, s in enumerate(spots) if s[1] > m.start()), sum(s[0] < end for s in spots))
        for g, size, name, t, tiny in winners:
            if t[0] == "spdx":
                continue
            while True:
                fit = [(got[2] + got[3], lo, got) for lo, hi in free if (got := align(t, words[lo:hi])) and got[2] + got[3] <= (0 if tiny else _limit(len(t)))]
                if not fit:
                    break
                _, lo, best = min(fit)
                hi = next(y for x, y in free if x == lo)
                # of the license's wordings at this place the one with most words the same, a difference counting against two
                score = len(t) - best[2] - 2 * (best[2] + best[3])
                for _, _, n, u, short in winners:
                    if n == name and u is not t and u[0] != "spdx" and (o := align(u, words[lo:hi])) and o[0] < best[1] and best[0] < o[1]:
                        if o[2] + o[3] <= (0 if short else _limit(len(u))) and (mine := len(u) - o[2] - 2 * (o[2] + o[3])) > score:
                            best, score = o, mine
                first, last, missing, added = best
                use(lo + first, lo + last)
                start, end = a + spots[lo + first][0], a + spots[lo + last - 1][1]
                out.setdefault((start, end), (name, start, end, round(max(g, 0) / size, 4), missing, added, None))
    return sorted(out.values(), key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, license, start, end, gain, missing, added, expression) per confirmed match."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        at, rows = [], []
        for i, t in enumerate(b.column("text").to_pylist()):
            found = scan_text(t)
            at += [i] * len(found)
            rows += found
        cols = list(zip(*rows)) or [()] * 7
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
        return pa.record_batch([b.column("id").take(pa.array(at, pa.int64())), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]],
                               names=["id", "license", "start", "end", "gain", "missing", "added", "expression"])

    kind = src.schema["id"].dataType.simpleString()
    return map_batches(src, run, f"id {kind}, license string, start long, end long, gain double, missing long, added long, expression string")
