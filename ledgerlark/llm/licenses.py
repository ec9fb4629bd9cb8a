"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Passages of a file are compared with the templates: its lines, its paragraphs, of a licence file the whole text; of a passage that names licences
also its clauses ("MIT or Apache-2.0"), and one variant for each version of a list ("version 2 and version 3"). Terms are
lower-cased runs of letters and digits ("v3" is "3"); the document frequencies of all terms are counted over all files. Tasks keep the
passages that could reach the threshold if every word outside the templates had the least weight; their distinct bags of
terms are joined with the frequencies, which gives their lengths and so their cosines. A template's numbers must all be in the
passage, so that versions agree. A passage speaks for the template with the highest cosine at or above the threshold; a file's licences are those of its passages,
and its first licence is the one with the highest cosine. A licence that extends another one's text replaces it. SPDX lines name licences outright, with score 1.
A file without a licence inherits those of the nearest directory at or above its own that holds a licence file. Directories, not files,
are expanded into their ancestors and joined by path.

Defined results. Null and empty texts have no licence of their own. Ties go to the alphabetically first licence. Of several licence
files in one directory the best score counts, then the first path. A null path is a file without any directory. Repeated
rows are judged alike, rows without doc_id too. An empty table gives an empty result. Columns other than doc_id, path and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import short_batches, written

THRESHOLD = 0.75
#: Terms that a task counts before it passes them on.
TERMS_HELD = 500_000
#: Paragraphs of public licence texts.
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AUTHOR_DISCLAIMS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
    "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_DISCLAIMS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
    "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
_ZLIB_TERMS = (
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
    "acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
)
#: Statements, titles, headers and texts by which licences are named (licence, statement).
TEMPLATES = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # titles, as in lists of licences
    ("0BSD", "BSD Zero Clause License"),
    ("AGPL-3.0", "GNU Affero General Public License version 3"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL-2.0", "GNU General Public License version 2"),
    ("GPL-3.0", "GNU General Public License version 3"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3"),
    ("MIT", "MIT License"),
    ("Zlib", "zlib License"),
    # headers of files
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    # texts: paragraphs and the whole of short licences
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_AUTHOR_DISCLAIMS}"),
    ("0BSD", f"{_GRANT}. {_AUTHOR_DISCLAIMS}"),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_NOTICE} {_MIT_DISCLAIMS}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_CLAUSES}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_CLAUSES} {_BSD_DISCLAIMS}"),
    ("BSD-3-Clause", _BSD_NAMES),
    ("BSD-3-Clause", f"{_BSD} {_BSD_CLAUSES} {_BSD_NAMES}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_CLAUSES} {_BSD_NAMES} {_BSD_DISCLAIMS}"),
    ("Zlib", _ZLIB),
    ("Zlib", f"This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. {_ZLIB} {_ZLIB_TERMS}"),
)
#: Licences whose texts hold the other one's and more.
EXTENDS = (("BSD-3-Clause", "BSD-2-Clause"), ("ISC", "0BSD"))
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)")
#: Names by which SPDX lines call the same licences.
SPDX_SUFFIX = re.compile(r"-(only|or-later)$")
#: Base names of licence files begin with one of these, in any letter case.
LICENCE_FILES = r"(?i)^(licen[cs]e|copying|copyright|notice)"
_TERM = re.compile(r"[^\W_]+")
_VERSION = re.compile(r"\bv(?=\d)")


def terms(text: str) -> list[str]:
    return _TERM.findall(_VERSION.sub("", text.lower()))


_LIST = re.compile(r"\bv(?:ersions?|\.)?\s*(\d+(?:\.\d+)*)((?:\s*(?:,|/|\band\b|\bor\b)\s*(?:v(?:ersion|\.)?\s*)?\d+(?:\.\d+)*)+)", re.IGNORECASE)
_NUMBER = re.compile(r"\d+(?:\.\d+)*")
_CLAUSE = re.compile(r"\b(?:or|and)\b|[/;()]", re.IGNORECASE)
#: What stands around the names in a list of licences.
_AROUND = re.compile(r"\b(?:(?:dual|double)[- ]?licen[cs]ed|at your option|(?:your )?choice of|either(?: of)?|both|(?:the )?terms of|licen[cs]ed|released|available|distributed|under|the)\b", re.IGNORECASE)


def named(passage: str) -> list[str]:
    """Further passages of one that may name several licences or versions: its clauses, and a variant for each version."""
    if "icen" not in passage.lower():
        return []
    clauses = _CLAUSE.split(passage)
    out = [_AROUND.sub(" ", c) for c in clauses] if len(clauses) > 1 else []
    versions = _LIST.search(passage)
    if versions:
        for number in [versions[1], *_NUMBER.findall(versions[2])]:
            one = f"{passage[: versions.start()]}version {number}{passage[versions.end() :]}"
            out += [one, *(_AROUND.sub(" ", c) for c in _CLAUSE.split(one))]
    return out


def passages(text: str, whole: bool) -> list[list[str]]:
    """Terms of each passage."""
    lines = text.split("\n")
    each = [terms(line) for line in lines]
    out, block, blocks = list(each), [], []
    for line, own in zip([*lines, ""], [*each, []], strict=True):
        if line.strip():
            block.append((line, own))
        else:
            if len(block) > 1:
                out.append([t for _, some in block for t in some])
                blocks.append("\n".join(line for line, _ in block))
            block = []
    if "icen" in text or "ICEN" in text:
        out += [terms(n) for passage in (*lines, *blocks) for n in named(passage)]
    return [*out, [t for some in each for t in some]] if whole else out


def declared(text: str) -> list[str]:
    """Licences that SPDX lines name."""
    found = {SPDX_SUFFIX.sub("", name) for line in SPDX.findall(text) for name in re.findall(r"[A-Za-z0-9.+-]+", line)} if "SPDX-" in text else set()
    return sorted(name.rstrip("+") for name in found if name.upper() not in ("OR", "AND", "WITH"))


def weight(frequency: int, files: int) -> float:
    """Inverse document frequency; 1 for a term that every file holds, which is the least."""
    return math.log((files + 1) / (frequency + 1)) + 1


class Matcher:
    """What tasks can tell of passages from the frequencies of the templates' terms alone."""

    def __init__(self, templates, frequency: dict[str, int], files: int):
        self.idf = {t: weight(frequency.get(t, 0), files) for _, s in templates for t in terms(s)}
        self.templates, self.holders = [], {}
        for k, (name, statement) in enumerate(sorted(set(templates))):
            weights = {t: n * self.idf[t] for t, n in Counter(terms(statement)).items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.templates.append((name, {t for t in weights if t.isdigit()}))
            for t, w in weights.items():
                self.holders.setdefault(t, []).append((k, w / norm * self.idf[t]))

    def possible(self, text: str, whole: bool) -> list[dict]:
        """Passages that may reach the threshold: their products with licences, and what their length is made of."""
        out, seen, idf = [], set(), self.idf
        for passage in passages(text, whole):
            counts = Counter(passage)
            known = counts.keys() & idf.keys()
            square = sum((counts[t] * idf[t]) ** 2 for t in known)
            least = square + sum(n * n for t, n in counts.items() if t not in known)
            if square < THRESHOLD**2 * least or not known:
                continue  # even a template of just the known terms would stay below
            of_template: dict[int, float] = {}
            for t in known:
                n = counts[t]
                for k, w in self.holders[t]:
                    of_template[k] = of_template.get(k, 0.0) + n * w
            enough, products = THRESHOLD * math.sqrt(least) * (1 - 1e-9), {}
            for k, product in of_template.items():
                licence, numbers = self.templates[k]
                if product >= enough and numbers <= known:
                    products[licence] = max(product, products.get(licence, 0.0))
            bag = tuple(sorted(counts.items())) if products else ()
            if products and bag not in seen:
                seen.add(bag)
                others = [{"term": t, "n": n} for t, n in bag if t not in known]
                digest = hashlib.sha256(repr(list(bag)).encode()).digest()
                out.append({"bag": digest, "square": square, "others": others, "products": [{"licence": k, "product": v} for k, v in sorted(products.items())]})
        return out


POSSIBLE = pa.list_(pa.struct({"bag": pa.binary(), "square": pa.float64(), "others": pa.list_(pa.struct({"term": pa.string(), "n": pa.int64()})), "products": pa.list_(pa.struct({"licence": pa.string(), "product": pa.float64()}))}))


def frequencies(files: DataFrame) -> DataFrame:
    """term, n: the files that hold each term; the empty term counts all files. Counts are added up before they leave a task."""
    short_batches(files.sparkSession)

    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts[""] += 1
                counts.update(set(terms(text)))
                if len(counts) >= TERMS_HELD:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    return files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def own_licences(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, path, licence, score, licences, is_licence_file: what each file says itself. files: doc_id, path, text."""
    files = files.select(F.col("doc_id"), F.col("path").cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = written(frequencies(files), "license-terms")
    wanted = sorted({"", *(t for _, s in templates for t in terms(s))})  # a row a term of the templates
    frequency = {r[0]: r[1] for r in counted.filter(F.col("term").isin(wanted)).collect()}
    total = frequency.pop("", 0)
    matcher = Matcher(templates, frequency, total)
    licence_file = re.compile(LICENCE_FILES)

    def run(batches):
        for batch in batches:
            paths, whole = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            holds = [bool(p and licence_file.match(p.rpartition("/")[2])) for p in paths]
            found = [matcher.possible(t, h) for t, h in zip(whole, holds, strict=True)]
            spdx = [declared(t) for t in whole]
            arrays = [batch.column(0), batch.column(1), pa.array(holds, pa.bool_()), pa.array(spdx, pa.list_(pa.string())), pa.array(found, POSSIBLE)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "path", "is_licence_file", "declared", "possible"])

    bag = "array<struct<bag: binary, square: double, others: array<struct<term: string, n: long>>, products: array<struct<licence: string, product: double>>>>"
    found = files.mapInArrow(run, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, path string, is_licence_file boolean, declared array<string>, possible {bag}")
    found = written(found.withColumn("row", F.expr("uuid()")), "license-passages")  # without the texts
    each = found.filter(F.size("possible") > 0).select("row", F.explode("possible").alias("p")).select("row", "p.*")
    # Headers are copied widely: the length of a bag of terms and the licence that it speaks for are worked out once.
    bags = each.groupBy("bag").agg(F.first("square").alias("square"), F.first("others").alias("others"), F.first("products").alias("products"))
    idf = F.log((F.lit(total) + 1.0) / (F.coalesce("n", F.lit(0)) + 1.0)) + 1.0
    other = bags.select("bag", F.explode("others").alias("o")).select("bag", F.col("o.term").alias("term"), F.col("o.n").alias("times"))
    rare = counted.join(other.select("term").distinct(), "term", "left_semi")
    rest = other.join(rare, "term", "left").groupBy("bag").agg(F.sum(F.pow(F.col("times") * idf, 2)).alias("rest"))
    norms = bags.join(rest, "bag", "left").select("bag", F.sqrt(F.col("square") + F.coalesce("rest", F.lit(0.0))).alias("norm"), "products")
    score = F.transform("products", lambda p: F.struct(-F.round(p["product"] / F.col("norm"), 9), p["licence"]))
    speaks = norms.select("bag", F.array_min(score).alias("best")).select("bag", (-F.col("best.col1")).alias("score"), F.col("best.licence").alias("licence"))
    says = each.select("row", "bag").join(speaks.filter(F.col("score") >= THRESHOLD), "bag").select("row", "score", "licence")
    spdx = found.select("row", F.lit(1.0).alias("score"), F.explode("declared").alias("licence"))
    kinds = says.unionByName(spdx).groupBy("row", "licence").agg(F.max("score").alias("score"))  # a row a licence that a file names
    all_of = kinds.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("least"), "licence"))).alias("all"))
    names = F.transform("all", lambda x: x["licence"])
    for wider, narrower in EXTENDS:
        gone = F.array_contains(names, wider)
        all_of = all_of.withColumn("all", F.when(gone, F.filter("all", _other_than(narrower))).otherwise(F.col("all")))
    out = found.drop("possible", "declared").join(all_of, "row", "left")
    first = F.get("all", F.lit(0))
    licences = F.array_join(F.array_sort(F.transform("all", lambda x: x["licence"])), ", ")
    return out.select("doc_id", "path", first["licence"].alias("licence"), (-first["least"]).alias("score"), licences.alias("licences"), "is_licence_file")


def _other_than(name: str):
    return lambda x: x["licence"] != name


def directory_of(path):
    """Directory of a path, without a slash at its end; the root is the empty text."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, path, licence, score, licences (all of them, joined), origin (own, inherited or none) and the directory that inherited ones come from."""
    own = written(own_licences(files, templates).withColumn("directory", directory_of(F.coalesce("path", F.lit("")))), "own-licences")
    best = F.min(F.struct((-F.col("score")).alias("s"), "path", "licence", "licences"))
    holders = own.filter("is_licence_file and licence is not null").groupBy("directory").agg(best.alias("best"))
    holders = holders.select(F.col("directory").alias("ancestor"), F.col("best.licence").alias("inherited"), F.col("best.licences").alias("inherited_all"))
    # Every directory that occurs and all above it, down from itself: the deepest that holds a licence wins.
    parts = F.split("directory", "/")
    depths = F.sequence(F.lit(0), F.size(parts))
    above = own.select("directory").distinct().select("directory", F.explode(F.transform(depths, lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("ancestor"))
    nearest = above.distinct().join(holders, "ancestor").groupBy("directory").agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "inherited", "inherited_all")).alias("near"))
    nearest = nearest.select("directory", F.col("near.inherited").alias("inherited"), F.col("near.inherited_all").alias("inherited_all"), F.col("near.ancestor").alias("from_directory"))
    joined = own.join(nearest, "directory", "left")
    says = F.col("licence").isNotNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("licence", "inherited").alias("licence"),
        F.when(says, F.col("score")).alias("score"),
        F.coalesce(F.when(says, F.col("licences")), F.col("inherited_all")).alias("licences"),
        F.when(says, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~says, F.col("from_directory")).alias("from_directory"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source/lang/hundred/name; those that begin with a line on a licence are licence files."""
    first = F.lower(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    name = F.when(first.rlike(r"\blicen[cs]ed?\b"), F.concat(F.lit("LICENSE."), number)).otherwise(F.concat(number, F.lit(".txt")))
    parts = [F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.coalesce((F.col("doc_id") / 100).cast("long").cast("string"), F.lit("none")), name]
    return docs.select("doc_id", F.concat_ws("/", *parts).alias("path"), "text")
