"""The license scan against cosines worked out one by one, and statements that are not templates."""

import math
from collections import Counter

import pytest

from ledgerlark.llm import licenses

FILES = [
    (1, "a/LICENSE", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nEveryone may copy"),
    (2, "a/x.py", "# Licensed under the Apache License, Version 2.0 (the License)\ncode and more code"),
    (3, "b/c/COPYING", "This library is licensed under the GNU Lesser General Public License v3."),
    (4, "b/c/y.py", None),
    (5, "b/d.txt", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (6, None, ""),
    (7, "b/c/y.py", "the MIT License is one that was released under no version"),
    (7, "b/c/y.py", "the MIT License is one that was released under no version"),
    (None, "/e", "word " * 50_000 + "\nReleased under the MIT License.\n" + "other words " * 1000),
    (8, "f", "Mozilla Public License, version 2.0"),
    (9, "g", "This work is licensed under the GNU Affero General Public License, version 3, or any later version."),
    (10, "h", "This work is licensed under the GNU General Public License, version 4."),
]


def by_hand(files):
    """The best (licence, cosine) of each file, from all pairs of passages and templates."""
    bags = [set(licenses.terms(text or "")) for _, _, text in files]
    idf = lambda t: math.log((len(files) + 1) / (sum(t in b for b in bags) + 1)) + 1
    out = []
    for _, path, text in files:
        best = (0.0, "")
        whole = bool(path) and path.rpartition("/")[2].lower().startswith(("license", "copying"))
        for passage in licenses.passages(text or "", whole):
            one = {t: n * idf(t) for t, n in Counter(passage).items()}
            for name, statement in licenses.TEMPLATES:
                two = {t: n * idf(t) for t, n in Counter(licenses.terms(statement)).items()}
                if any(t.isdigit() and t not in one for t in two):
                    continue
                product = sum(one.get(t, 0) * w for t, w in two.items())
                cosine = product / math.sqrt(sum(w * w for w in one.values()) * sum(w * w for w in two.values())) if one else 0.0
                if cosine > best[0] + 1e-9 or (abs(cosine - best[0]) <= 1e-9 and name < best[1]):
                    best = (cosine, name)
        out.append((best[1], best[0]) if best[0] >= licenses.THRESHOLD else (None, None))
    return out


@pytest.mark.parametrize("files", [FILES, FILES[:1], FILES[:7] * 3])
def test_own_licences_by_hand(spark, files):
    rows = licenses.own_licences(spark.createDataFrame([(*f, "x") for f in files], "doc_id long, path string, text string, licence string")).collect()
    found = Counter((r.doc_id, r.path, r.licence, None if r.score is None else round(r.score, 6)) for r in rows)
    expected = by_hand(files)
    assert found == Counter((f[0], f[1], name, None if score is None else round(score, 6)) for f, (name, score) in zip(files, expected, strict=True))


def test_relatives_keep_their_names(spark):
    found = {r.doc_id: r.licence for r in licenses.scan(spark.createDataFrame(FILES, "doc_id long, path string, text string")).collect()}
    assert (found[1], found[2], found[3], found[4]) == ("GPL-2.0", "Apache-2.0", "LGPL-3.0", "LGPL-3.0")
    assert (found[5], found[8], found[9], found[10], found[None]) == ("CC-BY-SA-4.0", "MPL-2.0", "AGPL-3.0", None, "MIT")


MIT = f"MIT License\n\nCopyright (c) 2001 A\n\n{licenses._MIT}\n\n{licenses._MIT_NOTICE}\n\n{licenses._MIT_DISCLAIMS}"
BSD_2 = f"Copyright (c) 2001, A\nAll rights reserved.\n\n{licenses._BSD}\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
BSD_3 = f"{BSD_2}\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"


def wrapped(text, before="// "):
    import textwrap

    return "\n".join(before + line for line in textwrap.wrap(text, 70))


HEADER = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU{} General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
TEXTS = [
    ("BSD-2-Clause", BSD_2),
    ("BSD-2-Clause", f"{BSD_2}\n{licenses._BSD_DISCLAIMS}"),
    ("BSD-3-Clause", BSD_3),
    ("BSD-3-Clause", wrapped(f"{licenses._BSD} {licenses._BSD_CLAUSES} {licenses._BSD_NAMES} {licenses._BSD_DISCLAIMS}") + "\nint main() {}"),
    ("BSD-2-Clause", wrapped(f"{licenses._BSD} {licenses._BSD_CLAUSES} {licenses._BSD_DISCLAIMS}", " * ")),
    ("MIT", MIT),
    ("MIT", wrapped(f"{licenses._MIT} {licenses._MIT_NOTICE} {licenses._MIT_DISCLAIMS}", "# ")),
    ("ISC", wrapped(f"{licenses._GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {licenses._AUTHOR_DISCLAIMS}", "")),
    ("0BSD", f"Copyright A\n\n{licenses._GRANT}.\n\n{licenses._AUTHOR_DISCLAIMS}"),
    ("Zlib", f"{wrapped(licenses._ZLIB, '  ')}\n\n{licenses._ZLIB_TERMS}"),
    ("GPL-2.0", HEADER.format("", 2)),
    ("GPL-3.0", HEADER.format("", 3)),
    ("LGPL-3.0", HEADER.format(" Lesser", 3)),
    ("LGPL-2.1", HEADER.format(" Lesser", 2.1)),
    ("AGPL-3.0", HEADER.format(" Affero", 3)),
    (None, "This software is provided as is without any express or implied warranty."),
    (None, HEADER.format("", 7)),
    (None, "we were permitted to copy and to use the software of this and other authors and the following is the rest"),
    ("Apache-2.0, MIT", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("GPL-2.0, GPL-3.0", "This work is under the GNU General Public License version 2 and version 3."),
    ("MIT, MPL-2.0", "Dual licensed under the MIT License or the Mozilla Public License Version 2.0"),
    ("Apache-2.0, GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later OR Apache-2.0\ncode"),
]


def test_public_texts(spark):
    """Relatives compete: texts, file headers, notes on two licences; a disclaimer alone is none."""
    other = [(1000 + k, f"o/{k}", f"the and of to in a text that is not a license but other words number {k} for all") for k in range(200)]
    files = [(n, f"d{n}/x.c", text) for n, (_, text) in enumerate(TEXTS)]
    found = {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame(files + other, "doc_id long, path string, text string")).collect()}
    assert {n: found[n] for n in range(len(TEXTS))} == {n: name for n, (name, _) in enumerate(TEXTS)}
    assert {found[n] for n, _, _ in other} == {None}
