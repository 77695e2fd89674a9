"""Licence scans by sparse TF-IDF cosine, and inheritance along directories.

Every line, and every sentence of it, is compared with the templates; idf
counts all documents and is a weight only. A file that says its own licence
keeps it.
Others take that of the nearest directory above them that has a licence file,
found by joins on path prefixes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Usual notices of common licences, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "This project is licensed under the terms of the MIT license."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-only"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
}
#: A line says a licence from this cosine on.
COSINE = 0.7
#: A file is a licence file by its name, or if notices are at least this share of its words.
NOTICE_SHARE = 0.5
_FILE = re.compile(r"(?i)^(un)?licen[cs]e|^copying|^notice")
_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_SENTENCE = re.compile(r"(?<=[.;!?])\s+")
_CLAUSE = re.compile(r"(?<=:)\s+")


def terms(line: str) -> Counter[str]:
    return Counter(_TERM.findall(line.lower()))


class Matcher:
    """TF-IDF vectors of the templates, and the cosine of a line to each."""

    def __init__(self, documents: int, df: dict[str, int]):
        self.idf = {t: math.log((1 + documents) / (1 + df.get(t, 0))) + 1 for line in _lines() for t in terms(line)}
        self.unknown = math.log(1 + documents) + 1
        self.vectors = [(name, {t: n * self.idf[t] for t, n in terms(line).items()}) for name, lines in TEMPLATES.items() for line in lines]
        self.norms = [math.sqrt(sum(x * x for x in v.values())) for _, v in self.vectors]
        self.posting: dict[str, list[tuple[int, float]]] = {}
        for i, (_, v) in enumerate(self.vectors):
            for t, x in v.items():
                self.posting.setdefault(t, []).append((i, x / self.norms[i]))
        self.known: dict[str, tuple[tuple[str, float] | None, int, int]] = {}

    def match(self, words: list[str]) -> tuple[str, float] | None:
        """The best template of a run of terms, at least at COSINE; ties go to the first template."""
        idf = self.idf
        shared = [t for t in words if t in idf]
        if not shared:
            return None
        inside = 0.0
        v = Counter(shared)
        for t, n in v.items():
            inside += (n * idf[t]) ** 2
        others = len(words) - len(shared)
        # the cosine to any template is at most the share of the norm in shared terms, and n terms of weight u have at least n u^2 of it
        if inside < COSINE**2 * (inside + others * self.unknown**2) - 1e-9:
            return None
        dots: dict[int, float] = {}
        for t, n in v.items():
            for i, y in self.posting[t]:
                dots[i] = dots.get(i, 0.0) + n * idf[t] * y
        norm = inside + sum((n * self.unknown) ** 2 for n in Counter(t for t in words if t not in idf).values())
        best = max(dots.items(), key=lambda d: (d[1], -d[0]))
        c = best[1] / math.sqrt(norm)
        return (self.vectors[best[0]][0], min(1.0, c)) if c >= COSINE else None

    def line(self, line: str) -> tuple[tuple[str, float] | None, int, int]:
        """The best match of a lower-cased line, its sentences and their clauses after colons; words in notices, and words in all.

        A clause of one term (the name before a colon) isn't a notice.
        """
        if line in self.known:
            return self.known[line]
        best: tuple[str, float] | None = None
        all_words: list[str] = []
        said = size = 0
        sentences = _SENTENCE.split(line)
        for sentence in sentences:
            clauses = _CLAUSE.split(sentence) if ":" in sentence else [sentence]
            found = [_TERM.findall(c) for c in clauses]
            # terms hold no white space: those of the parts are those of the whole
            words = found[0] if len(found) == 1 else [t for f in found for t in f]
            n = len(sentence.split())
            got, held = self.match(words) if len(words) > 1 or len(sentences) == 1 else None, n
            parts = [got]
            if len(found) > 1:
                of = [self.match(f) if len(set(f)) > 1 else None for f in found]
                parts += of
                if got is None:
                    held = sum(len(c.split()) for c, g in zip(clauses, of, strict=True) if g)
            said += held if any(parts) else 0
            size += n
            for g in parts:
                if g and (best is None or g[1] > best[1] + 1e-12):
                    best = g
            all_words += words
        if len(sentences) > 1 and (got := self.match(all_words)):
            said = size
            if best is None or got[1] > best[1] + 1e-12:
                best = got
        out = best, said, size
        if len(line) <= 1000:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[line] = out
        return out

    def scan(self, text: str | None) -> tuple[str | None, float, float]:
        """``(licence, cosine, share of words in notices)``; the best line decides, then the first."""
        best, share, size = (None, 0.0), 0, 0
        for line in text.lower().split("\n") if text else ():
            if line:
                got, said, n = self.line(line)
                share += said
                size += n
                if got and got[1] > best[1] + 1e-12:
                    best = got
        return *best, share / max(1, size)


def _lines() -> list[str]:
    return [line for lines in TEMPLATES.values() for line in lines]


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents and, of them, those that hold each template term: a table of the templates' size."""
    vocabulary = sorted({t for line in _lines() for t in terms(line)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, counts, n = frozenset(vocabulary), Counter(), 0
        for b in batches:
            for text in b["text"]:
                n += 1
                counts.update(wanted.intersection(_TERM.findall((text or "").lower())))
        yield pd.DataFrame({"term": [None, *counts], "n": [n, *counts.values()]})

    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r["term"]: r["n"] for r in got}
    return df.pop(None, 0), df


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def license_scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, path, license, cosine, basis, origin`` for every document.

    ``basis`` is own, inherited or none; ``origin`` the path of the licence
    file or the file itself. Of several licence files of a directory, the
    highest cosine counts, then the smallest path. Null and empty texts say
    nothing; a null path has no directory. Repeated rows are all returned.
    """
    documents, df = document_frequencies(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((documents, df))

    @F.pandas_udf("license string, cosine double, share double")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(*shared.value)
        for texts in batches:
            yield pd.DataFrame([matcher.scan(t) for t in texts], columns=["license", "cosine", "share"])

    base = docs.select(F.col(id_col).alias("id"), path.cast("string").alias("path"), scan(F.col(text_col).cast("string")).alias("s")).select("id", "path", "s.*")
    files = stored(base.withColumn("directory", _parent(F.col("path"))))
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(_FILE.pattern)
    rank = F.struct((-F.col("cosine")).alias("c"), "path", "license")
    of_directory = files.where(F.col("license").isNotNull() & (named | (F.col("share") >= NOTICE_SHARE))).groupBy("directory").agg(F.min(rank).alias("best"))
    of_directory = stored(of_directory.where("directory is not null").select("directory", F.col("best.license").alias("license"), F.col("best.path").alias("origin"), F.col("best.c").alias("c")))
    # Each distinct directory looks at itself and all directories above it.
    directories = files.where("license is null and directory is not null").select("directory").distinct()
    parts = F.split("directory", "/")
    above = directories.select("directory", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("up", "ancestor"))
    nearest = above.join(of_directory.withColumnRenamed("directory", "ancestor"), "ancestor").groupBy("directory").agg(F.min(F.struct("up", "license", "origin", "c")).alias("near"))
    # `near` and the files have no hot key: a directory's files may be many, its row is one.
    out = files.join(nearest, "directory", "left")
    own = F.col("license").isNotNull()
    return out.select(
        "id",
        "path",
        F.coalesce("license", "near.license").alias("license"),
        F.when(own, F.col("cosine")).otherwise(F.coalesce(-F.col("near.c"), F.lit(0.0))).alias("cosine"),
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(own, F.col("path")).otherwise(F.col("near.origin")).alias("origin"),
    )
