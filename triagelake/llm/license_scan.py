"""License scan: TF-IDF cosine of blocks of text to licence notices and full texts, then inheritance along directories.

Terms are the templates' words; a word outside them counts as the term OTHER. A term's weight is
1 + ln((1 + files) / (1 + files that have it)), counted over all files. A text is cut into pieces at line and
sentence ends; comment marks are no words. A template of RUN_WORDS at most is compared with every run of
consecutive pieces (a run ends with the piece that takes it to twice the template's words), so that wrapped
headers are seen whole; every template is compared with the whole text. An SPDX tag names its license itself
and scores 1. A file's license is that of its best block. A file without one inherits from the nearest
directory above it that has a licence file: each file's ancestor directories are joined with the directories
of licence files and the longest wins.

What cannot reach the threshold is not compared: a cosine is at most the root of the share of the template's
squared weight that lies on terms the block has (Cauchy-Schwarz). So a block that reaches `least` holds one of
the template's heaviest terms, those without which the others make up less than `least` squared.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, in_batches, texts, written

_APACHE = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_NO_WARRANTY = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."
#: The usual notices of each license; the full texts lie in `licences`, named by their license.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software to deal in the software without restriction under the MIT license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 " + _APACHE),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 " + _APACHE),
    *((name, text) for name, kind, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")) for text in (_GNU.format(kind=kind, version=version), _GNU.format(kind=kind, version=version) + _NO_WARRANTY.format(kind=kind))),
)
LEAST = 0.8
OTHER = ""
#: Templates of so many words are sought in runs of pieces; longer ones are whole texts of licence files.
RUN_WORDS = 600
TAG = "spdx-license-identifier"
#: Licences of directories are broadcast up to so many directories, joined by a shuffle beyond.
BROADCAST_DIRECTORIES = 200_000
_WORD = re.compile(r"[a-z0-9]+(?:[.-][0-9a-z]+)*")
_PIECE_END = re.compile(r"\n|(?<=[.;:!?])\s+")
_TAG = re.compile(TAG + r":[ \t]*(\(*[a-z0-9.+-]+\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[a-z0-9.+-]+\)*)*)", re.IGNORECASE)


def terms(line: str, known: frozenset[str] | None) -> Counter:
    found = Counter(_WORD.findall(line.lower()))
    if known is None:
        return found
    out = Counter({t: n for t, n in found.items() if t in known})
    if strange := sum(found.values()) - sum(out.values()):
        out[OTHER] = strange
    return out


def cosine(a: Counter, b: Counter, idf: dict[str, float]) -> float:
    dot = sum(n * b[t] * idf[t] ** 2 for t, n in a.items() if t in b)
    norm = lambda v: math.sqrt(sum((n * idf[t]) ** 2 for t, n in v.items()))
    return dot / (norm(a) * norm(b)) if dot else 0.0


def weights(files: DataFrame, text_col: str, known: frozenset[str]) -> dict[str, float]:
    """The weight of each template term; its size is that of the templates."""

    def count(batches):
        found = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                found.update(known.intersection(_WORD.findall(text.decode().lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    total = files.count()
    counts = in_batches(files.select(F.col(text_col).cast("string").alias("text")), count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    have = {r["term"]: r["n"] for r in counts}
    return {OTHER: 1.0} | {t: 1 + math.log((1 + total) / (1 + have.get(t, 0))) for t in known}


def all_templates() -> tuple[tuple[str, str], ...]:
    """Notices, then the full texts; read on the driver."""
    return (*TEMPLATES, *((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licences").glob("*.txt"))))


def tagged(text: str, names: dict[str, str]) -> str | None:
    """What the first SPDX tag says: a template's license, the versions' -only and -or-later included, or the expression as it stands."""
    found = _TAG.search(text)
    if not found:
        return None
    return names.get(re.sub(r"(-only|-or-later|\+)$", "", found[1].lower().strip("()")), found[1])


class Template:
    """A template's counts, and what of it a block needs to reach `least`."""

    def __init__(self, name: str, text: str, idf: dict[str, float], least: float):
        self.name, self.counts, self.idf, self.least = name, terms(text, None), idf, least
        self.size = self.counts.total()
        self.parts = {t: (n * idf[t]) ** 2 for t, n in self.counts.items()}
        self.square = sum(self.parts.values())
        self.needed = least**2 * self.square * (1 - 1e-9)
        self.anchors, rest = set(), self.square
        for t in sorted(self.parts, key=lambda t: (-self.parts[t], t)):
            if rest < self.needed:
                break
            self.anchors.add(t)
            rest -= self.parts[t]

    def possible(self, here: set[str]) -> bool:
        return not self.anchors.isdisjoint(here) and sum(v for t, v in self.parts.items() if t in here) >= self.needed

    def best_run(self, pieces: list[list[str]]) -> tuple[float, int]:
        """The best score of a run of pieces (words as terms) and its first piece; 0 if none can reach `least`."""
        sizes, most = [len(p) for p in pieces], 2 * self.size
        own = [not self.counts.keys().isdisjoint(p) for p in pieces]
        anchored = [not self.anchors.isdisjoint(p) for p in pieces]
        starts: set[int] = set()
        for at in (k for k, x in enumerate(anchored) if x):
            first = last = at
            words = 0
            while first and words + sizes[first - 1] < most:
                first -= 1
                words += sizes[first]
            words = 0
            while last + 1 < len(pieces) and words < most:
                words += sizes[last]
                last += 1
            if self.possible(set().union(*pieces[first : last + 1])):
                starts.update(k for k in range(first, at + 1) if own[k])
        best, where = 0.0, 0
        for start in sorted(starts):
            have: dict[str, int] = {}
            dot = square = 0.0
            words, seen = 0, False
            for at in range(start, len(pieces)):
                for t in pieces[at]:
                    weight, n = self.idf[t] ** 2, have.get(t, 0)
                    square += (2 * n + 1) * weight
                    dot += self.counts.get(t, 0) * weight
                    have[t] = n + 1
                words, seen = words + sizes[at], seen or anchored[at]
                if seen and own[at] and (score := round(dot / math.sqrt(square * self.square), 12)) > best:
                    best, where = score, start
                if words >= most:
                    break
        return best, where


def scanned(text: str, forms: list[Template], names: dict[str, str], known: frozenset[str], idf: dict[str, float], least: float) -> tuple[str | None, float | None]:
    """A text's license and score: the best block's; ties go to the earlier one, then to the template listed first."""
    here = known.intersection(_WORD.findall(text.lower()))
    if TAG in here and (said := tagged(text, names)):
        return said, 1.0
    found = []
    forms = [(k, f) for k, f in enumerate(forms) if f.possible(here)]
    if not forms:
        return None, None
    whole = terms(text, known)
    pieces = [p for p in ([w if w in known else OTHER for w in _WORD.findall(x)] for x in _PIECE_END.split(text.lower())) if p]
    for k, form in forms:
        found.append((round(cosine(whole, form.counts, idf), 12), 0, -k))
        if form.size <= RUN_WORDS:
            score, where = form.best_run(pieces)
            found.append((score, -where, -k))
    score, _, k = max(found)
    return next((f.name, score) for n, f in forms if n == -k) if score >= least else (None, None)


def detected(files: DataFrame, path_col: str, text_col: str, templates=None, least: float = LEAST) -> DataFrame:
    """path, license, score for each row of files: the best block's template, or null.

    Whole texts are read. A null text, or one whose best block scores under `least`, has none. Templates are
    pairs of license and text; by default the notices and full texts here.
    """
    templates = all_templates() if templates is None else templates
    known = frozenset(t for _, text in templates for t in terms(text, None)) | {TAG}
    idf = weights(files, text_col, known)
    forms = [Template(name, text, idf, least) for name, text in templates]
    spdx = {name.lower(): name for name, _ in templates}

    def scan(batches):
        for batch in batches:
            found = [scanned(text.decode(), forms, spdx, known, idf, least) for text in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["path", "license", "score"])

    return in_batches(files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")), scan, "path string, license string, score double")


def upwards(directory: F.Column) -> F.Column:
    """A directory and all above it, the root (an empty string) included."""
    parts = F.split(directory, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def inherited(found: DataFrame, licence_file: str = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$") -> DataFrame:
    """found (path, license, score) with `effective` and `origin`: own, inherited or none.

    Where a directory has several licence files the best score, then the first path, counts. Rows without a
    path have no directories and inherit nothing; repeated rows are answered alike. Ancestors are looked up
    for each distinct directory, not for each file.
    """
    best = F.min(F.struct((-F.col("score")).alias("s"), "path", "license"))
    holders = found.where(F.col("license").isNotNull() & F.col("path").rlike(licence_file)).groupBy(F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).agg(best.alias("b")).select("dir", F.col("b.license").alias("given"))
    above = found.where("license IS NULL AND path IS NOT NULL").select(F.regexp_replace("path", "/?[^/]*$", "").alias("of")).distinct().select("of", F.explode(upwards(F.col("of"))).alias("dir"))
    nearest = bounded(written(above.join(holders, "dir").groupBy("of").agg(F.max_by("given", F.length("dir")).alias("given")), "license-nearest"), BROADCAST_DIRECTORIES)
    out = found.withColumn("of", F.when(F.col("license").isNull(), F.regexp_replace("path", "/?[^/]*$", ""))).join(nearest, "of", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select("path", "license", "score", F.coalesce("license", "given").alias("effective"), origin.alias("origin"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id; in a source/lang the licensed document with the smallest id is its licence file.

    What the scan found is written once, without texts, for it is read for the licence files and again for
    those that inherit. A document without an id is called `-` and is never a licence file.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    found = written(detected(docs.select(place.alias("path"), "text"), "path", "text"), "license-found")
    found = found.withColumn("doc_id", F.element_at(F.split("path", "/"), -1).try_cast("long")).withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    first = found.where("license IS NOT NULL AND doc_id IS NOT NULL").groupBy("dir").agg(F.min("doc_id").alias("doc_id"))
    files = found.join(first.withColumn("holds", F.lit(True)), ["dir", "doc_id"], "left")
    files = files.select(F.when(F.col("holds"), F.concat("dir", F.lit("/LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.col("path")).alias("path"), "license", "score")
    out = inherited(files)
    return out.select(F.regexp_extract("path", "([0-9]+)$", 1).try_cast("long").alias("doc_id"), "path", "license", F.round("score", 9).alias("score"), "effective", "origin")
