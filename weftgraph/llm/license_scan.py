"""Licences of files: TF-IDF cosine of headers and licence files to templates, then inheritance along directories."""

from __future__ import annotations

import math
import pkgutil
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .decontaminate import words

LEAST = 0.6
#: Share of a text's words in its licence passages from which on it counts as a licence file of its directory.
FILE_SHARE = 0.5
#: Least cosine of a whole text to a whole licence from which on it counts as a copy of it.
WHOLE = 0.9

# Notices and first sentences of common licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-2.0", "Licensed under the GNU General Public License, Version 2."),
    ("GPL-3.0", "Licensed under the GNU General Public License, Version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, Version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)

#: Licences whose whole texts are in the folder ``licences``.
WHOLE_TEXTS = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")


def whole_texts() -> tuple[tuple[str, str], ...]:
    return tuple((name, pkgutil.get_data(__package__, f"licences/{name}.txt").decode()) for name in WHOLE_TEXTS)


def _holder(line: list[bytes]) -> bool:
    """Whether a line names a copyright holder, which is no part of the licence."""
    return line[:1] == [b"copyright"] and len(line) > 1 and (line[1] in (b"c", "©".encode()) or line[1].isdigit())


class Scorer:
    """Cosine of a passage to each template over words weighted by log-scaled inverse document frequency.

    A word outside the templates' vocabulary weighs as one that no document has, so a
    passage with other words beside the notice scores lower.
    """

    def __init__(self, templates, n_docs: int, df: dict[bytes, int]):
        self.vocabulary = {w for _, text in templates for w in words(text.encode())}
        self.idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) + 1 for w in self.vocabulary}
        self.rare = math.log(1 + n_docs) + 1
        self.by_word: dict[bytes, list[tuple[int, float]]] = {}
        self.names = [name for name, _ in templates]
        for k, (_, text) in enumerate(templates):
            weight = {w: n * self.idf[w] for w, n in Counter(words(text.encode())).items()}
            norm = math.sqrt(sum(x * x for x in weight.values()))
            for w, x in weight.items():
                self.by_word.setdefault(w, []).append((k, x / norm))

    def best(self, passage: list[bytes], least: float = 0.0) -> tuple[float, int]:
        """The largest cosine and its template (ties: the first); (0, -1) where no cosine can reach ``least``.

        No cosine exceeds the share that the vocabulary's words have in the passage's norm.
        """
        counts = Counter(passage)
        if self.vocabulary.isdisjoint(counts):
            return 0.0, -1
        weight = {w: n * self.idf.get(w, self.rare) for w, n in counts.items()}
        norm = sum(x * x for x in weight.values())
        known = self.vocabulary.intersection(weight)
        if sum(weight[w] ** 2 for w in known) < least * least * norm * (1 - 1e-9):
            return 0.0, -1
        dots: dict[int, float] = {}
        for w, x in weight.items():
            for k, y in self.by_word.get(w, ()):
                dots[k] = dots.get(k, 0.0) + x * y
        k = min(dots, key=lambda k: (-dots[k], k))
        return dots[k] / math.sqrt(norm), k


def scan_text(text: bytes, scorer: Scorer, least: float, wholes: Scorer | None = None) -> tuple[str | None, float, float]:
    """Licence of a text, the cosine, and the share of words in licence passages.

    By its lines and its paragraphs that reach ``least``; but a text that as a whole
    reaches ``WHOLE`` on one of ``wholes`` is that licence, and all of it a licence passage.
    """
    if wholes:
        score, k = wholes.best([w for line in text.split(b"\n") if not _holder(run := words(line)) for w in run], WHOLE)
        if score >= WHOLE:
            return wholes.names[k], score, 1.0
    top, which, covered, total = 0.0, -1, 0, 0
    for paragraph in text.split(b"\n\n"):
        lines = [words(line) for line in paragraph.split(b"\n")]
        total += sum(map(len, lines))
        held = 0
        for line in lines:
            if line:
                score, k = scorer.best(line, least)
                if score >= least:
                    held += len(line)
                    if score > top:
                        top, which = score, k
        if len(lines) > 1:
            whole = [w for line in lines for w in line]
            if whole:
                score, k = scorer.best(whole, least)
                if score >= least:
                    held = len(whole)
                    if score > top:
                        top, which = score, k
        covered += held
    return (scorer.names[which] if which >= 0 else None), top, covered / total if total else 0.0


def word_counts(texts: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of texts, and in how many each vocabulary word occurs, over all texts. Sums are taken in the tasks first."""

    def count(batches):
        n, df = 0, Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                n += 1
                df.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.binary()), pa.array([n, *df.values()], pa.int64())], names=["word", "n"])

    got = texts.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return sum(r["n"] for r in got if r["word"] is None), {bytes(r["word"]): r["n"] for r in got if r["word"] is not None}


def licenses(df: DataFrame, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = (), templates=TEMPLATES, least: float = LEAST, wholes: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """The licence of every file: ``path, license, score, origin, from_path`` after the columns in ``keep``.

    Each line and paragraph of a whole text is compared with each template by the cosine
    of sparse TF-IDF vectors, with document frequencies over all texts. The best one of at
    least ``least`` is the file's own licence: origin ``file`` where such passages hold at
    least half of its words (then it also licenses its directory), else ``header``. Before that
    the whole text, without the lines of copyright holders, is compared alike with whole
    licences (``wholes``, None for those of ``WHOLE_TEXTS``); one of at least ``WHOLE`` is
    the file's licence, with origin ``file``. A file without one takes that of the nearest directory above it that has a licence file
    (ties: larger cosine, then first path): origin ``inherited``. Else ``none``.

    Inheritance is by joins on directories: distinct directories of open files are spread
    to their ancestors (a row per level), joined to one licence per directory, and the
    deepest is kept; files then join on their directory, whose hot values Spark splits.

    Null text counts as empty; a null path inherits nothing and licenses nothing; repeated
    rows give repeated results; an empty table gives none; clashing names are kept apart.
    """
    rows = df.select(*[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)], F.col(f"`{path_col}`").alias("path"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    wholes = whole_texts() if wholes is None else wholes
    vocabulary = frozenset(w for _, t in (*templates, *wholes) for w in words(t.encode()))
    n, df_of = word_counts(rows.select("text"), vocabulary)
    out = rows.drop("text").schema.add("license", "string").add("score", "double").add("share", "double")
    last = len(rows.columns) - 1

    def scan(batches):
        scorer, whole = Scorer(templates, n, df_of), Scorer(wholes, n, df_of)
        for batch in slices(batches):
            found = [scan_text(t, scorer, least, whole) for t in batch.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())], names=out.names)

    own = rows.mapInArrow(scan, out).withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")))
    own = written(own, "licences")
    is_file = F.col("license").isNotNull() & (F.col("share") >= FILE_SHARE)
    per_dir = own.filter(is_file & F.col("dir").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("x")).select("dir", F.col("x.license").alias("dir_license"), F.col("x.path").alias("from_path"))
    open_dirs = own.filter(F.col("license").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    above = open_dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))))).select(F.col("dir").alias("below"), "depth", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest("depth", F.lit(1))), "/")).alias("dir"))
    nearest = above.join(per_dir, "dir").groupBy("below").agg(F.max_by(F.struct("dir_license", "from_path"), "depth").alias("x")).select(F.col("below").alias("dir"), F.col("x.dir_license").alias("dir_license"), F.col("x.from_path").alias("from_path"))
    nearest = written(nearest, "inherited")
    found = own.join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    return found.select(
        *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)],
        F.col("path"),
        F.coalesce("license", "dir_license").alias("license"),
        F.when(mine, F.round("score", 6)).alias("score"),
        F.when(mine & (F.col("share") >= FILE_SHARE), "file").when(mine, "header").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("from_path")).alias("from_path"),
    )
