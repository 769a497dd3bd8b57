"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory with a licence file.

Lines that name a licence, the runs of short lines around them (headers are wrapped, and marked as comments), the sentences
of both, and the whole text of licence files are compared with templates. A template stands for a licence only where the
words and numbers that part it from its kin (Lesser, Affero, a version) are there, and no others of that kind. Document
frequencies of the templates' words are counted over all files; a word of no template weighs like the rarest and only adds
to a unit's length. A file without a licence of its own takes that of the nearest ancestor directory that holds a licence
file, by a join of directories' ancestors with those directories.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import byte_view, chunks, saved, small_batches, span_hashes, word_spans

# Statements by which texts name their licence, and openings of licence files.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 terms and conditions for use, reproduction, and distribution"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or any later version."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("CC-BY-4.0", "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz."),
    ("CC-BY-4.0", "Ce texte est mis à disposition sous licence Creative Commons Attribution 4.0 International."),
    ("CC-BY-4.0", "Esta obra está bajo una licencia Creative Commons Atribución 4.0 Internacional."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
]
_ANCHOR_RE2 = "(?i)licen[cs][ei]|lizen[sz]|permission is hereby|permission to use|redistribution and use|public domain"
_ANCHOR = re.compile(_ANCHOR_RE2)
# Words that tell licences of one family apart; version numbers do too.
_TELLING = {"lesser", "lgpl", "affero", "agpl", "noncommercial", "sharealike", "noderivatives"}
_CODES = {"nc", "sa", "nd"}  # telling next to BY alone
_VERSION = re.compile(r"[0-9]+(?:\.[0-9]+)*$")
_MARKS = re.compile(r"^[\s/*#;%!|\"'.<>-]+|[\s*/>-]+$")  # of a comment, around its text
WRAPPED, AROUND = 120, 8  # characters of a line that may be part of a wrapped header, and lines of it on each side
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"


def terms(s: str) -> list[str]:
    return _WORD.findall(s.lower())


def telling(words: set[str]) -> set[str]:
    """What tells a licence from its kin, versions without a zero at the end: 3.0 is 3."""
    versions = {re.sub(r"(\.0)+$", "", w) for w in words if _VERSION.match(w) and len(w) < 6 and not re.match(r"(19|20)[0-9]{2}$", w)}
    return (words & (_TELLING | _CODES if "by" in words else _TELLING)) | versions


VOCABULARY = sorted({w for _, t in TEMPLATES for w in terms(t)})


class Templates:
    """TF-IDF vectors of the templates, from how many of `files` files hold each word of VOCABULARY."""

    def __init__(self, files: int, df: dict[str, int]) -> None:
        self.idf = {w: log((files + 1) / (df.get(w, 0) + 1)) + 1 for w in VOCABULARY}
        self.other = log(files + 1) + 1
        self.rows, self.index, self.telling = [], defaultdict(list), [telling(set(terms(t))) for _, t in TEMPLATES]
        for k, (name, text) in enumerate(TEMPLATES):
            v = {w: n * self.idf[w] for w, n in Counter(terms(text)).items()}
            self.rows.append((name, sqrt(sum(x * x for x in v.values()))))
            for w, x in v.items():
                self.index[w].append((k, x))

    def best(self, text: str) -> tuple[str | None, float]:
        """The licence with the largest cosine of those that the text does not rule out, ties to the first by name; (None,
        0) without a common word. A template is ruled out by a telling word or version that the text lacks, and by such a
        word (not a version: addresses and dates hold numbers too) that the template lacks."""
        counts = Counter(terms(text))
        told = telling(set(counts))
        words = told & (_TELLING | _CODES)
        norm = sqrt(sum((n * self.idf.get(w, self.other)) ** 2 for w, n in counts.items()))
        dot: dict[int, float] = defaultdict(float)
        for w, n in counts.items():
            for k, x in self.index.get(w, ()):
                if self.telling[k] <= told and words <= self.telling[k]:
                    dot[k] += n * self.idf[w] * x
        if not dot:
            return None, 0.0
        cosine = {k: d / norm / self.rows[k][1] for k, d in dot.items()}
        k = min(cosine, key=lambda k: (-cosine[k], self.rows[k][0]))
        return self.rows[k][0], cosine[k]


def own_license(text: str, is_file: bool, templates: Templates, threshold: float) -> tuple[str | None, float, int]:
    """(licence, cosine, line from 1) of the best unit of the whole text; line 0 for a licence file as a whole."""
    found: tuple[str | None, float, int] = (None, 0.0, 0)
    if is_file:
        name, score = templates.best(text)
        found = (name, score, 0) if score >= threshold else found
    lines = text.split("\n")
    for at, line in enumerate(lines, 1):
        if _ANCHOR.search(line):
            wrapped = _wrapped(lines, at - 1)
            parts = [p for u in (line, wrapped) for p in _SENTENCE.split(u) if _ANCHOR.search(p)]
            for unit in dict.fromkeys([line, wrapped, *parts]):
                name, score = templates.best(unit)
                if score >= threshold and score > found[1]:
                    found = (name, score, at)
    return found


def _wrapped(lines: list[str], at: int) -> str:
    """The run of short lines around one, without the marks of comments; a line without text parts runs."""
    if len(lines[at]) > WRAPPED:
        return lines[at]

    def run(places: range) -> Iterator[str]:
        for k in places:
            text = _MARKS.sub("", lines[k]) if len(lines[k]) <= WRAPPED else ""
            if not text:
                return
            yield text

    before = list(run(range(at - 1, max(-1, at - 1 - AROUND), -1)))[::-1]
    return " ".join([*before, _MARKS.sub("", lines[at]), *run(range(at + 1, min(len(lines), at + 1 + AROUND)))])


_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _words_alone(data: np.ndarray) -> np.ndarray:
    """Bytes with a blank for what is in no word of terms(): a dot is in one between a word's sign and a digit."""
    inside = _IN_WORD[data]
    dot = np.zeros(len(data), bool)
    if len(data) > 2:
        dot[1:-1] = (data[1:-1] == 46) & inside[:-2] & (data[2:] >= 48) & (data[2:] <= 57)
    return np.where(inside | dot, data, np.uint8(32))


_VOCABULARY_HASH = span_hashes(np.frombuffer(" ".join(VOCABULARY).encode(), np.uint8), *word_spans(np.frombuffer(" ".join(VOCABULARY).encode(), np.uint8), np.array([0, len(" ".join(VOCABULARY).encode())]))[:2])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with each word of VOCABULARY, as counts by its place."""
    order = np.argsort(_VOCABULARY_HASH)
    ordered = _VOCABULARY_HASH[order]
    total = np.zeros(len(VOCABULARY), np.int64)
    for batch in batches:
        data, offs = byte_view(batch.column(0))
        for i, j in chunks(offs):
            own = _words_alone(data[offs[i] : offs[j]])
            starts, ends, rows = word_spans(own, offs[i : j + 1] - offs[i])
            h = span_hashes(own, starts, ends)
            at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
            hit = ordered[at] == h
            pair = np.unique(rows[hit] * len(VOCABULARY) + order[at[hit]])
            total += np.bincount(pair % len(VOCABULARY), minlength=len(VOCABULARY))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(VOCABULARY)), pa.int32()), pa.array(total)], ["word", "n"])


def _scan(templates_b, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_file = batch.column(3).to_pylist()
            named = pc.fill_null(pc.match_substring_regex(batch.column(2), _ANCHOR_RE2), False).to_pylist()
            rows = [i for i in range(batch.num_rows) if named[i] or is_file[i]]
            texts = dict(zip(rows, batch.column(2).take(pa.array(rows, pa.int64())).to_pylist(), strict=True))
            found = [own_license(texts[i] or "", bool(is_file[i]), templates_b.value, threshold) if i in texts else (None, 0.0, 0) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([f[0] for f in found], pa.string()), pa.array([round(f[1], 6) for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int32())], ["id", "path", "is_file", "license", "score", "line"])

    return run


def license_scan(files: DataFrame, path: str | Column = "path", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """doc_id, path, license, origin (own or inherited), score, line, directory of every row of files.

    Paths use `/`. Files named like LICENSE or COPYING are licence files; their licence holds for their directory and all
    below it that have none nearer. score and line (0: whole file) are those of the unit found, of the licence file where
    inherited; directory is the one inherited from. Of several licence files in a directory the best score counts, ties to
    the first path. No licence: nulls. Null paths have no directory and inherit nothing; null texts have no licence.
    """
    small_batches(files.sparkSession)
    place = F.col(path) if isinstance(path, str) else path
    own = files.select(F.col(id_col).alias("id"), place.alias("path"), F.col(text_col).alias("text"))
    total = own.count()
    df = {VOCABULARY[r.word]: r.n for r in own.select("text").mapInArrow(_frequencies, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    templates = files.sparkSession.sparkContext.broadcast(Templates(total, df))
    kind = dict(own.dtypes)["id"]
    marked = own.withColumn("is_file", F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)))
    scanned = saved(marked.mapInArrow(_scan(templates, threshold), f"id {kind}, path string, is_file boolean, license string, score double, line int"))
    scanned = scanned.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    best = Window.partitionBy("dir").orderBy(F.col("score").desc(), "path")
    # One row a directory before the window: a directory may hold any number of licence files.
    holders = scanned.where("is_file and license is not null").groupBy("dir", "path").agg(F.max(F.struct("score", "license", "line")).alias("b")).select("dir", "path", "b.*")
    holders = holders.withColumn("rn", F.row_number().over(best)).where("rn = 1").select(F.col("dir").alias("above"), F.col("license").alias("from_license"), F.col("score").alias("from_score"), F.col("line").alias("from_line"))
    dirs = scanned.where("dir is not null and license is null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    climbed = dirs.select("dir", F.explode(F.array_distinct(above)).alias("above")).join(holders, "above")
    nearest = saved(climbed.groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "from_license", "from_score", "from_line")).alias("n")).select("dir", "n.above", "n.from_license", "n.from_score", "n.from_line"))
    joined = scanned.join(nearest, "dir", "left")
    has = F.col("license").isNotNull()
    return joined.select(
        F.col("id").alias("doc_id"),
        "path",
        F.coalesce("license", "from_license").alias("license"),
        F.when(has, "own").when(F.col("from_license").isNotNull(), "inherited").alias("origin"),
        F.when(has, F.col("score")).otherwise(F.col("from_score")).alias("score"),
        F.when(has, F.col("line")).otherwise(F.col("from_line")).alias("line"),
        F.when(~has, F.col("above")).alias("directory"),
    )
