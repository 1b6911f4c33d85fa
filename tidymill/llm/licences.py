"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

Units of a file are its lines, its paragraphs (runs of lines that are not blank) and itself, over the whole text and without
comment marks. A unit and a template are vectors of words weighted tf * idf; idf comes from the lines of all files, for the words of the
templates (any other word counts as seen in one line). The best template with a cosine of at least LEAST is the unit's licence, the best unit's
licence that of the file. A file is a licence file if its name says so or if its whole text is such a unit.

A file without a licence of its own takes that of the nearest directory above it, its own directory first, that holds a licence file.
Directories are joined, not files: each different directory looks for its ancestors' licences once, and files join their directory.

Defined results: null and empty texts have no licence of their own; ties go to the licence first in order of its name; a directory with
several licence files takes the best score; a null path has no directories and inherits nothing; repeated rows are repeated; an empty
table gives no rows; columns other than those named are not read.
"""
from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, pick, stored, whole_text

LEAST = 0.6
#: Opening or customary words of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "The MIT License (MIT). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
FILE_NAMES = re.compile(r"(?i)^(licen[cs]e|copying|unlicense|notice)([.\-_].*)?$")
COMMENT = re.compile(r"^\s*(?://+|/\*+|\*+/?|#+|;+|--+|<!--|%+)?\s*")
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def lines_of(text: str) -> list[str]:
    return [COMMENT.sub("", line) for line in text.split("\n")]


def paragraphs_of(lines: list[str]) -> list[str]:
    """Runs of at least two lines that are not blank; one line is a unit already."""
    out, run = [], []
    for line in [*lines, ""]:
        if line.strip():
            run.append(line)
        else:
            if len(run) > 1:
                out.append(" ".join(run))
            run = []
    return out


class Matcher:
    """Cosine of units to the templates under the given counts of lines."""

    def __init__(self, templates, total: int, lines_with: dict[str, int]):
        self.idf = lambda w: math.log((1 + total) / (1 + lines_with.get(w, 1))) + 1
        self.vocabulary = {w for _, text in templates for w in words(text)}
        self.weights = {w: self.idf(w) for w in self.vocabulary}
        self.other = math.log((1 + total) / 2) + 1
        self.templates = []
        for name, text in templates:
            vector = {w: n * self.weights[w] for w, n in Counter(words(text)).items()}
            norm = math.sqrt(sum(x * x for x in vector.values()))
            self.templates.append((name, {w: x / norm for w, x in vector.items()}))
        self.templates.sort(key=lambda t: t[0])

    def best(self, unit: str) -> tuple[float, str | None]:
        found = Counter(words(unit))
        known = {w: n * self.weights[w] for w, n in found.items() if w in self.vocabulary}
        if not known:
            return 0.0, None
        norm = math.sqrt(sum(x * x for x in known.values()) + self.other ** 2 * sum(n * n for w, n in found.items() if w not in known))
        inside = math.sqrt(sum(x * x for x in known.values()))
        if inside / norm < LEAST:       # a cosine is no larger
            return 0.0, None
        score, name = 0.0, None
        for licence, vector in self.templates:
            value = sum(x * vector.get(w, 0.0) for w, x in known.items()) / norm
            if value > score + 1e-12:
                score, name = value, licence
        return (score, name) if score >= LEAST else (0.0, None)

    def scan(self, text: str, named: bool) -> tuple[float, str | None, bool]:
        """Score and licence of a file, and whether it is a licence file."""
        lines = lines_of(text)
        whole = self.best(" ".join(lines))
        units = [self.best(u) for u in (*lines, *paragraphs_of(lines))]
        score, name = min([whole, *units], key=lambda x: (-x[0], x[1] or ""))
        return score, name, name is not None and (named or whole[1] is not None)


def line_counts(files: DataFrame, templates=TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of lines of all files, and for each word of the templates of the lines that hold it."""
    vocabulary = {w for _, text in templates for w in words(text)}

    def run(rows):
        total, held = 0, Counter()
        for text in rows["text"]:
            for line in text.split("\n"):
                total += 1
                held.update(vocabulary.intersection(words(line)))
        return {"word": ["", *held], "n": [total, *held.values()]}

    found = {r["word"]: r["n"] for r in map_batches(files.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop("", 0), found


def scan(files: DataFrame, templates=TEMPLATES, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, path, licence, score, origin (own, inherited or none), from_dir of every file (path, text)."""
    source = pick(files, *dict.fromkeys((*keep, "path", "text"))).select(*keep, "path", whole_text().alias("text"))
    counts = line_counts(source, templates)

    def run(rows):
        matcher = Matcher(templates, *counts)
        found = [matcher.scan(t, bool(FILE_NAMES.match((p or "").rsplit("/", 1)[-1]))) for p, t in zip(rows["path"], rows["text"])]
        return {c: rows[c] for c in (*keep, "path")} | {"own_score": [s for s, _, _ in found], "own": [n for _, n, _ in found], "holds": [h for _, _, h in found]}

    kept = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    scanned = stored(map_batches(source, run, kept + "path string, own_score double, own string, holds boolean"), "scanned")
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    scanned = scanned.withColumn("dir", directory)
    # The best score, then the first name: the least of (-score, name).
    best = (scanned.filter("holds and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own").alias("n"))).alias("b"))
            .select("dir", F.col("b.n").alias("dir_licence"), (-F.col("b.s")).alias("dir_score")))
    above = ancestors(scanned.filter("dir is not null").select("dir").distinct())
    nearest = (above.join(best.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir")
               .agg(F.max_by(F.struct("dir_licence", "dir_score", "ancestor"), "depth").alias("near")))
    placed = scanned.join(nearest, "dir", "left")
    own, near = F.col("own").isNotNull(), F.col("near").isNotNull()
    return placed.select(
        *keep, "path", F.coalesce("own", "near.dir_licence").alias("licence"),
        F.when(own, F.col("own_score")).otherwise(F.coalesce("near.dir_score", F.lit(0.0))).alias("score"),
        F.when(own, "own").when(near, "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("near.ancestor")).alias("from_dir"))


def ancestors(directories: DataFrame) -> DataFrame:
    """dir, ancestor (itself, and each directory above, the root as the empty string), depth."""
    parts = F.split("dir", "/")
    return (directories.select("dir", parts.alias("parts"))
            .select("dir", "parts", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"))
            .select("dir", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("ancestor"), "depth")
            .groupBy("dir", "ancestor").agg(F.max("depth").alias("depth")))
