"""Licence scan: sparse TF-IDF cosine of notices to templates, then nearest-ancestor inheritance; DataFrame functions only.

Every line with a licence word, alone and in blocks with the lines around it, is compared with the templates.  Document
frequencies of the template terms are counted over all files.  Files without a licence of their own take that of the
nearest directory above them that holds a licence file, found by joins on directory paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import attach, stored

_GNU = ("This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} License as "
        "published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
_GNU_FILE = ("GNU {kind} LICENSE Version {version}, {date} Copyright (C) {years} Free Software Foundation, Inc. Everyone is permitted to "
             "copy and distribute verbatim copies of this license document, but changing it is not allowed.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: {one} Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. {two} Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_NAMES = (" {three} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission.")
_AS_IS = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
          "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")


def _gnu(licence: str, kind: str, version: str, date: str, years: str, whats=("program",)) -> tuple[tuple[str, str], ...]:
    return ((licence, f"This work is licensed under the GNU {kind} License, version {version}."),
            *[(licence, _GNU.format(what=what, kind=kind, version=version)) for what in whats],
            (licence, _GNU_FILE.format(kind=kind, version=version, date=date, years=years)))


# Licence ids and the wording of their usual notices, headers and the heads of their files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
                   "REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    *_gnu("GPL-2.0", "General Public", "2", "June 1991", "1989, 1991"),
    *_gnu("GPL-3.0", "General Public", "3", "29 June 2007", "2007"),
    *_gnu("LGPL-2.1", "Lesser General Public", "2.1", "February 1999", "1991, 1999", ("program", "library")),
    *_gnu("LGPL-3.0", "Lesser General Public", "3", "29 June 2007", "2007", ("program", "library")),
    *_gnu("AGPL-3.0", "Affero General Public", "3", "19 November 2007", "2007"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD.format(one="1.", two="2.") + _AS_IS),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD.format(one="1.", two="2.") + _BSD_NAMES.format(three="3.") + _AS_IS),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which "
                "accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which "
                "is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, "
                "dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
ANCHOR = r"(?i)licen[cs]e|licensed|copyright|public domain|permission is hereby|redistribution and use|creative commons"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Blocks around a line with a licence word: (lines before it, lines in all).  Headers wrap, so a block may begin earlier;
#: the longest one holds a whole file of the BSD kind.
BLOCKS = ((0, 4), (1, 4), (2, 4), (0, 24))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def passages(text: Column) -> Column:
    """Every line with a licence word, and the blocks of lines around it."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    starts = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(ANCHOR), i + 1)), lambda i: i.isNotNull())

    def block(held: Column, i: Column, before: int, size: int) -> Column:
        return F.array_join(F.slice(held["lines"], F.greatest(F.lit(1), i - before), F.least(F.lit(size), size - before + i - 1)), "\n")

    # the lines are bound to a lambda's variable, as an expression in a lambda is evaluated again for each element
    held = F.array(F.struct(lines.alias("lines"), starts.alias("starts")))
    every = F.flatten(F.transform(held, lambda h: F.flatten(F.transform(h["starts"], lambda i: F.array(
        F.get(h["lines"], i - 1), *[block(h, i, *b) for b in BLOCKS])))))
    return F.when(text.rlike(ANCHOR), F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def template_terms(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``template, licence, term, tf``: a fixed small table (a row per template term)."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(k).alias("licence"), F.lit(t).alias("text"))
                     for i, (k, t) in enumerate(templates)])
    base = spark.range(1).select(F.inline(rows)).withColumn("terms", terms(F.col("text")))
    return base.select("template", "licence", F.explode("terms").alias("term")).groupBy("template", "licence", "term").agg(
        F.count(F.lit(1)).alias("tf"))


def notice_scores(files: DataFrame, texts: DataFrame, n_files: int, threshold: float, templates=TEMPLATES) -> DataFrame:
    """``row, licence, cosine`` of the best template of each file at or above the threshold."""
    spark = files.sparkSession
    of_templates = template_terms(spark, templates)
    vocabulary = sorted({r.term for r in of_templates.select("term").distinct().collect()})  # terms of fixed templates
    known = F.array(*[F.lit(t) for t in vocabulary])
    df = (texts.select(F.explode(F.array_intersect(terms(F.col("text")), known)).alias("term"))
          .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    idf = lambda d: F.log(F.lit(1.0 + n_files) / (F.lit(1.0) + d)) + F.lit(1.0)
    weights = stored(of_templates.join(df, "term", "left").withColumn("idf", idf(F.coalesce("df", F.lit(0))))
                     .withColumn("w", F.col("tf") * F.col("idf")), "licence-terms")
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    # a term outside the templates weighs as one that no file has
    one = files.where(F.size("passages") > 0).select("row", F.posexplode("passages").alias("no", "passage"))
    per_term = one.select("row", "no", F.explode(terms(F.col("passage"))).alias("term")).groupBy("row", "no", "term").agg(
        F.count(F.lit(1)).cast("double").alias("tf"))
    term_idf = weights.select("term", F.col("idf").alias("i")).distinct()
    weighted = per_term.join(F.broadcast(term_idf), "term", "left").withColumn(
        "w_p", F.col("tf") * F.coalesce("i", idf(F.lit(0.0))))
    of_passage = weighted.join(F.broadcast(weights.select("template", "licence", "term", "w").groupBy("term").agg(
        F.collect_list(F.struct("template", "w")).alias("hits"))), "term", "left")
    p_norm = F.sqrt(F.sum(F.col("w_p") * F.col("w_p"))).alias("p_norm")
    parts = of_passage.select("row", "no", "w_p", F.transform("hits", lambda h: F.struct(
        h["template"].alias("template"), (h["w"] * F.col("w_p")).alias("x"))).alias("hits"))
    norm = parts.groupBy("row", "no").agg(p_norm)
    dots = parts.select("row", "no", F.inline("hits")).groupBy("row", "no", "template").agg(F.sum("x").alias("dot"))
    names = weights.select("template", "licence").distinct().join(norms, "template")
    score = dots.join(norm, ["row", "no"]).join(F.broadcast(names), "template").withColumn(
        "cosine", F.round(F.col("dot") / (F.col("p_norm") * F.col("t_norm")), 9))
    best = score.groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("neg"), "licence")).alias("b"))
    return best.select("row", F.col("b.licence").alias("licence"), (-F.col("b.neg")).alias("cosine")).where(
        F.col("cosine") >= threshold)


def ancestors(directory: Column) -> Column:
    """The directory itself and all above it, as structs (dir, depth); the root is the empty path with depth 0."""
    parts = F.split(directory, "/")
    n = F.when(F.length(directory) == 0, 0).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(
        F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir"), k.alias("depth")))


def scan_licences(files: DataFrame, path: Column, licence_file: Column | None = None, text_col: str = "text",
                  carry: tuple[str, ...] = (), threshold: float = 0.75, templates=TEMPLATES) -> DataFrame:
    """Per input row: the carried columns, ``path, licence, cosine, origin, declared_in``.

    ``origin`` is ``own`` for a file with a notice whose cosine to a template reaches ``threshold``, ``inherited``
    when the nearest directory above it (its own included) with a licence file gives one (``declared_in``), else
    ``none`` with a null licence.  Of several licence files in a directory the one with the highest cosine counts,
    then the smallest path.  Ties between templates go to the licence that sorts first.  By default a licence file is
    one called LICENSE, LICENCE, COPYING or NOTICE, with any suffix.  Null texts have no notice; a null path lies in
    the root.  Repeated rows give a row each; an empty table gives none.
    """
    path = F.coalesce(path, F.lit(""))
    named = F.regexp_extract(path, r"([^/]*)$", 1).rlike(r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$")
    rows = stored(files.select(
        F.monotonically_increasing_id().alias("row"), path.alias("path"),
        F.coalesce(named if licence_file is None else licence_file, F.lit(False)).alias("declares"),
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("carried"),
        passages(F.col(text_col)).alias("passages")), "licence-files")
    texts = files.select(F.col(text_col).alias("text")).where("text is not null")
    own = stored(notice_scores(rows, texts, rows.count(), threshold, templates), "licence-own")
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    known = stored(rows.drop("passages").join(own, "row", "left").withColumn("dir", directory), "licence-known")
    declared = (known.where("declares and licence is not null").groupBy("dir")
                .agg(F.min(F.struct((-F.col("cosine")).alias("neg"), "path", "licence")).alias("d"))
                .select("dir", F.col("d.licence").alias("dir_licence")))
    dirs = known.where("licence is null").select(F.col("dir").alias("start")).distinct()
    up = dirs.select("start", F.inline(ancestors(F.col("start"))))
    near = (attach(up, ["dir"], declared, F.col("start")).where("dir_licence is not null")
            .groupBy(F.col("start").alias("dir")).agg(F.max(F.struct("depth", "dir", "dir_licence")).alias("n"))
            .select("dir", F.col("n.dir").alias("declared_in"), F.col("n.dir_licence").alias("near_licence")))
    out = attach(known, ["dir"], near, F.col("row"))
    inherited = F.col("licence").isNull() & F.col("near_licence").isNotNull()
    return out.select(
        *[F.col(f"carried.`{c}`").alias(c) for c in carry], "path",
        F.coalesce("licence", "near_licence").alias("licence"), "cosine",
        F.when(F.col("licence").isNotNull(), "own").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.when(inherited, F.col("declared_in")).alias("declared_in"))
