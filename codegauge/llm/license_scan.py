"""Licence scans: sparse TF-IDF cosine to templates, then the nearest ancestor directory's licence. DataFrame functions only.

A header is a line that names a licence or copyright, or a window around such a word in the text without its comment marks and line
breaks; a licence file (LICENSE, COPYING, ...) is compared whole and by its title.
Weights are count * (ln((1 + N) / (1 + df)) + 1) over N templates, a word of no template having df 0. A
file takes its best header's licence if the cosine is at least THRESHOLD; a licence file's licence holds for its
directory. A file without one of its own takes that of the nearest ancestor directory that has one.

Relatives differ in few words, so two of them are told apart by what they must say: a template's numbers that are in its licence's name (its
version, or its clauses) must all be in what it is compared with, and the best template must be better than those of other licences by
MARGIN. Of equal ones the smaller name is taken. Licence files are compared with the full texts of `licenses/` too (each the text that
its publisher gives under that name), with weights over all of these. SPDX identifiers count as they are, whole expressions included, but
for -only, -or-later and +. With whole_lines neither windows nor identifiers count.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How the licences name themselves in headers and in the first words of their texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-3.0", "Licensed under CC BY 3.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
)
#: The titles of texts whose bodies name each other.
TITLES = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
)
THRESHOLD, MARGIN, TITLE_WORDS = 0.6, 0.01, 10
HEADER = r"(?i)licen[sc]e|copyright|spdx|hereby granted|public domain|redistribut"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)([.-][a-z0-9.-]*)?$"
TOKEN = r"[a-z0-9]+"


#: Words of a window that starts at a header's word, or three words before it.
WINDOWS = (5, 8, 12, 24, 40)
_ID = r"[(]*[A-Za-z0-9][A-Za-z0-9.+-]*[)]*"
SPDX = rf"SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:OR|AND|WITH)[ \t]+{_ID})*)"
COMMENT_MARK = r"(?m)^[ \t]*(?://+|/?[*]+|#+|;+|--+|%+|<!--)"
#: A word that a window starts at.
HEADER_WORD = HEADER.replace("hereby granted", "hereby").replace("public domain", "domain")

Templates = tuple[tuple[str, str], ...]


def file_templates() -> Templates:
    """TEMPLATES and the full texts, for licence files."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licenses")
    full = []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            full.append((name.removesuffix(".txt"), f.read()))
    return (*TEMPLATES, *TITLES, *full)


def required(name: str, text: str) -> set[str]:
    """The numbers of a licence's name that its template has: what is compared with it must have them."""
    return set(re.findall(r"[0-9]+", name)) & set(re.findall(TOKEN, text.lower()))


def idf(templates: Templates = TEMPLATES) -> tuple[dict[str, float], float]:
    """(weight of each template word, weight of any other)."""
    df = Counter(w for _, t in templates for w in set(re.findall(TOKEN, t.lower())))
    n = len(templates)
    return {w: math.log((1 + n) / (1 + d)) + 1 for w, d in df.items()}, math.log(1 + n) + 1


def template_vectors(spark: SparkSession, templates: Templates = TEMPLATES) -> DataFrame:
    """(template, license, word, unit, need): unit-length vectors; as many rows as the templates have words. need: the word is required."""
    weight, _ = idf(templates)
    rows = []
    for i, (name, text) in enumerate(templates):
        tf = Counter(re.findall(TOKEN, text.lower()))
        norm = math.sqrt(sum((c * weight[w]) ** 2 for w, c in tf.items()))
        rows += [(i, name, w, c * weight[w] / norm, int(w in required(name, text))) for w, c in sorted(tf.items())]
    return spark.createDataFrame(rows, "template int, license string, word string, unit double, need int")


def _base(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def directory(path: Column) -> Column:
    """What stands before the last "/"; "" at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def best_matches(segments: DataFrame, key: list[str], templates: Templates = TEMPLATES) -> DataFrame:
    """(key, license, cosine) of each segment (key, segment): its best template's licence, if no other licence is within MARGIN."""
    spark = segments.sparkSession
    weight, other = idf(templates)
    words = F.broadcast(spark.createDataFrame(sorted(weight.items()), "word string, idf double"))
    tf = segments.select(*key, F.explode(F.regexp_extract_all(F.lower("segment"), F.lit(TOKEN), F.lit(0))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("n"))
    tf = tf.join(words, "word", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(other)))
    # One pass: the squared length of a segment comes with its products, each word's once (template -1).
    vectors = template_vectors(spark, templates)
    postings = vectors.groupBy("word").agg(F.collect_list(F.struct("template", "license", "unit", "need")).alias("p"))
    none = F.array(F.struct(F.lit(-1).alias("template"), F.lit("").alias("license"), F.lit(0.0).alias("unit"), F.lit(0).alias("need")))
    hit = tf.join(F.broadcast(postings), "word", "left").select(*key, "w", F.explode(F.concat(none, F.coalesce("p", F.array().cast("array<struct<template:int,license:string,unit:double,need:int>>")))).alias("t"))
    dots = hit.groupBy(*key, "t.template", "t.license").agg(F.sum(F.col("w") * F.col("t.unit")).alias("dot"), F.sum("t.need").alias("met"), F.sum(F.when(F.col("t.template") == -1, F.col("w") * F.col("w"))).alias("square"))
    needs = F.broadcast(vectors.groupBy("template").agg(F.sum("need").alias("needed")))
    dots = dots.join(needs, "template", "left").where((F.col("template") == -1) | (F.col("met") == F.col("needed")))
    by = dots.groupBy(*key, "license").agg(F.round(F.max("dot"), 12).alias("dot"), F.max("square").alias("square"))
    ranked = F.array_sort(F.collect_list(F.when(F.col("license") != "", F.struct((-F.col("dot")).alias("less"), "license"))))  # as many as licences
    best = by.groupBy(*key).agg(F.max("square").alias("square"), ranked.alias("r")).where(F.size("r") > 0)
    length = F.sqrt("square")
    cosine = lambda i: -F.get("r", F.lit(i))["less"] / length
    apart = cosine(0) - F.coalesce(cosine(1), F.lit(-1.0)) >= MARGIN
    return best.where(apart).select(*key, F.get("r", F.lit(0))["license"].alias("license"), cosine(0).alias("cosine"))


def _windows(text: Column) -> Column:
    """Runs of words around a header's words, with comment marks and line breaks gone."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, COMMENT_MARK, " ")), F.lit(TOKEN), F.lit(0))
    at = lambda w: F.filter(F.transform(w, lambda x, i: F.when(x.rlike(HEADER_WORD), i + 1)), lambda i: i.isNotNull())
    cut = lambda w, i: F.array(*[F.array_join(F.slice(w, F.greatest(i - back, F.lit(1)), n), " ") for back in (0, 3) for n in WINDOWS])
    return F.array_distinct(F.flatten(F.transform(at(words), lambda i: cut(words, i))))


def _spdx(named: DataFrame, key: list[str]) -> DataFrame:
    """(key, license, cosine 1) of what SPDX lines name."""
    ids = named.select(*key, F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("license"))
    ids = ids.withColumn("license", F.regexp_replace(F.regexp_replace("license", "[()]", ""), r"(-only|-or-later|[+])($|[ \t])", "$2"))
    return ids.where(~F.col("license").isin("NONE", "NOASSERTION")).select(*key, "license", F.lit(1.0).alias("cosine"))


def scan(files: DataFrame, threshold: float = THRESHOLD, whole_lines: bool = False) -> DataFrame:
    """files (file_id, path, text) to (file_id, license, cosine, source, directory), one row for each row of files.

    source is "own" (a header or the file's whole text), "inherited" (directory says from where) or null with no
    licence. Null and empty texts have no header and may inherit; a null path lies in no directory. Whole texts are read.
    Rows equal in file_id and path are one file: their headers are joined and each row gets the same answer. Extra columns
    are not read. An empty table gives no rows.
    """
    key = ["file_id", "path"]
    whole = F.coalesce(_base(F.col("path")).rlike(LICENSE_FILE), F.lit(False))
    lines = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: x.rlike(HEADER)))
    named = files.select("file_id", "path", "text").where(F.col("text").rlike(HEADER))

    def matches(named: DataFrame, segments: Column, templates: Templates) -> DataFrame:
        parts = named.select(*key, F.explode(segments).alias("segment")).distinct().withColumn("seg", F.xxhash64("segment"))
        return best_matches(parts, [*key, "seg"], templates).select(*key, "license", "cosine")

    best = matches(named.where(~whole), lines if whole_lines else F.array_union(lines, _windows(F.col("text"))), TEMPLATES)
    title = F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)), 1, TITLE_WORDS), " ")
    best = best.union(matches(named.where(whole), F.array("text", title), file_templates()))
    best = (best if whole_lines else best.union(_spdx(named, key))).where(F.col("cosine") >= threshold - 1e-9)
    first = F.min(F.struct((-F.round("cosine", 9)).alias("less"), "license")).alias("own")
    own = best.groupBy(*key).agg(first).select(*key, "own.license", (-F.col("own.less")).alias("cosine"))
    return _inherit(files.select(*key), own)


def _inherit(files: DataFrame, own: DataFrame) -> DataFrame:
    from . import shared

    own = shared.written(own, "licenses")
    is_file = _base(F.col("path")).rlike(LICENSE_FILE)
    held = own.where(is_file).groupBy(directory(F.col("path")).alias("up")).agg(F.max(F.struct("cosine", "license")).alias("h"))
    held = held.select("up", F.col("h.license").alias("up_license"), F.col("h.cosine").alias("up_cosine"))
    # Directories, not files, look for the nearest ancestor: each distinct one and its parents join the licensed ones.
    dirs = files.where("path is not null").select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    near = dirs.select("dir", F.explode(F.array_distinct(F.concat(ups, F.array("dir")))).alias("up")).join(held, "up")
    near = near.groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "up_license", "up_cosine")).alias("n"))
    near = shared.written(near.select("dir", "n.up", "n.up_license", "n.up_cosine"), "license-dirs")
    i, p = "own_id", "own_path"
    got = files.join(own.select(F.col("file_id").alias(i), F.col("path").alias(p), "license", "cosine"), F.col("file_id").eqNullSafe(F.col(i)) & F.col("path").eqNullSafe(F.col(p)), "left")
    got = got.withColumn("dir", F.when(F.col("license").isNull(), directory(F.col("path")))).join(near, "dir", "left")
    return got.select(
        "file_id",
        F.coalesce("license", "up_license").alias("license"),
        F.coalesce("cosine", "up_cosine").alias("cosine"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited").alias("source"),
        F.when(F.col("license").isNull(), F.col("up")).alias("directory"),
    )
