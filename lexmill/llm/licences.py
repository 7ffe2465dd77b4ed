"""Licence scan by sparse TF-IDF cosine, with inheritance along directories; DataFrame operations only.

Every line of every file, and the file as a whole, is a segment; so are windows
over the words of the file, across its lines, from each template term on, as long
as each template with that term and half as long again.  Statements inside long
lines and wrapped headers are met by windows.  Terms are runs
of letters and digits, lower-cased, without a short list of function words.
Inverse document frequencies of the templates' terms come from all segments that
are lines; terms outside the templates take the largest value.  A segment's
licence is the template of highest cosine, at least ``LEAST_COSINE``; a file's
own licence is that of its best segment.

A file whose name says so, or of which licence lines, or the template terms of one licence window, make up
at least half of the terms, is a licence file of its directory.  A file without a licence of its
own takes that of the nearest ancestor directory with a licence file, by a join
of the paths of its ancestors.

Only what the templates bound is broadcast (their terms and weights).  Hot
directories are safe: the licence table has one row per directory, so the join
may be split or its small side sent round.

Defined edge cases: null or empty text has no own licence; a null path has no
directory and inherits nothing; ties go to the smaller template id, then the
smaller path; repeated rows each give a row; an empty table gives an empty one;
columns of the input other than the three named are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch

LEAST_COSINE = 0.6
FILE_SHARE = 0.5
FUNCTION_WORDS = "a an and any are as at be by for from in is it its no not of on or that the their them there this to was which with you your".split()
_GNU_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("GPL-3.0", _GNU_HEADER.format("General", 3)),
    ("GPL-2.0", _GNU_HEADER.format("General", 2)),
    ("LGPL-3.0", _GNU_HEADER.format("Lesser General", 3)),
    ("AGPL-3.0", _GNU_HEADER.format("Affero General", 3)),
]
_NAMED = r"(?i)(^|/)(licen[cs]e|copying|unlicen[cs]e)([-._][^/]*)?$"


def template_terms(templates: list[tuple[str, str]]) -> list[tuple[int, str, int]]:
    """(template, term, count)."""
    out = []
    for k, (_, text) in enumerate(templates):
        terms = [t for t in re.findall(r"[a-z0-9]+", text.lower()) if t not in FUNCTION_WORDS]
        out += [(k, t, terms.count(t)) for t in sorted(set(terms))]
    return out


def _windows(spark: SparkSession, given: DataFrame, terms_of: str, counted: list[tuple[int, str, int]], idf: dict[str, float], rest: float, norms: dict[int, float], least: float) -> DataFrame:
    """``row, b, wide``: cosine and template of each file's best window, and the most template terms in one licence window."""
    long_as: dict[int, int] = {}
    of: dict[int, dict[str, float]] = {}
    for k, t, c in counted:
        long_as[k] = long_as.get(k, 0) + c
        of.setdefault(k, {})[t] = c * idf[t] / math.sqrt(norms[k])
    shapes = [(t, k, n, of[k]) for k, t, _ in counted for n in sorted({long_as[k], long_as[k] * 3 // 2})]
    shapes = spark.createDataFrame(shapes, "term string, template int, n int, ws map<string,double>")
    known = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    spots = given.select("row", F.expr(terms_of).alias("terms")).select("row", F.size("terms").alias("all"), F.posexplode("terms").alias("pos", "term")).join(F.broadcast(known), "term")
    # rows alike are one; a single exchange serves this and the windows
    spots = spots.repartition("row").groupBy("row", "pos").agg(F.first("all").alias("all"), F.first("term").alias("term"), F.first("idf").alias("idf"))
    ahead = Window.partitionBy("row").orderBy("pos").rangeBetween(0, max(long_as.values(), default=1) * 3 // 2 - 1)
    near = spots.withColumn("near", F.collect_list(F.struct("pos", "term", "idf")).over(ahead)).where(F.size("near") > 1)
    # no window scores above the root of the squared weights of the template terms in it
    met = near.join(F.broadcast(shapes), "term").withColumn("near", F.expr("filter(near, x -> x.pos < pos + n)"))
    met = met.where(F.expr("aggregate(array_distinct(near.term), 0D, (a, t) -> a + power(coalesce(ws[t], 0D), 2))") >= least * least * 0.999)
    met = met.withColumn("n", F.least("n", F.col("all") - F.col("pos"))).withColumn("tfs", F.expr("transform(array_distinct(transform(near, x -> struct(x.term, x.idf))), d -> struct(d.term, d.idf * size(filter(near, x -> x.term = d.term)) AS v))"))
    dot, sq = F.expr("aggregate(tfs, 0D, (a, d) -> a + d.v * coalesce(ws[d.term], 0D))"), F.expr("aggregate(tfs, 0D, (a, d) -> a + d.v * d.v)") + (F.col("n") - F.size("near")) * F.lit(rest * rest)
    scored = met.select("row", F.size("near").alias("n"), "template", F.round(dot / F.sqrt(sq), 9).alias("cosine")).where(F.col("cosine") >= least)
    return scored.groupBy("row").agg(F.max(F.struct("cosine", (-F.col("template")).alias("col2"))).alias("b"), F.max("n").alias("wide"))


def scan(spark: SparkSession, files: DataFrame, id_col: str, path_col: str, text_col: str, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """A row per file: ``id, path, own_licence, own_cosine, is_licence_file, licence, licence_from``."""
    scratch = Scratch(spark, "licences")
    given = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("id", "path", "text"))
    stop = ",".join(f"'{w}'" for w in FUNCTION_WORDS)
    terms_of = f"filter(split(lower(line), '[^a-z0-9]+'), t -> t <> '' AND NOT t IN ({stop}))"
    segs = given.select("row", F.expr(f"filter(transform(split(text, '\n'), (line, i) -> named_struct('line_no', i, 'terms', {terms_of})), s -> size(s.terms) > 0)").alias("segs"))
    counted = template_terms(templates)
    known = spark.createDataFrame(sorted({(t,) for _, t, _ in counted}), "term string")
    # rows alike in id, path and text share a row key: what they count together is divided by their number
    rows = segs.select("row", F.coalesce(F.size("segs"), F.lit(0)).alias("n_lines"), F.expr("coalesce(aggregate(segs, 0L, (a, s) -> a + size(s.terms)), 0L)").alias("n_terms"))
    rows = scratch.table(rows.groupBy("row", "n_lines", "n_terms").agg(F.count("*").alias("copies")))
    lines = segs.select("row", F.explode("segs").alias("s")).select("row", "s.line_no", F.size("s.terms").cast("long").alias("n_terms"), "s.terms")
    tokens = lines.select("row", "line_no", "n_terms", F.explode("terms").alias("term")).join(F.broadcast(known), "term")
    tokens = tokens.groupBy("row", "line_no", "n_terms", "term").agg(F.count("*").alias("tf"))
    tokens = scratch.table(tokens.join(rows.where("copies > 1").select("row", "copies"), "row", "left").select("row", "line_no", "n_terms", "term", (F.col("tf") / F.coalesce("copies", F.lit(1))).cast("long").alias("tf")))
    n_segments = rows.agg(F.sum("n_lines")).first()[0] or 0
    df = {r["term"]: r["df"] for r in tokens.groupBy("term").agg(F.count("*").alias("df")).collect()}
    idf = {t: math.log((1 + n_segments) / (1 + df.get(t, 0))) + 1 for t in {t for _, t, _ in counted}}
    rest = math.log(1 + n_segments) + 1
    norms: dict[int, float] = {}
    for k, t, c in counted:
        norms[k] = norms.get(k, 0.0) + (c * idf[t]) ** 2
    weights = spark.createDataFrame([(t, k, c * idf[t] / math.sqrt(norms[k])) for k, t, c in counted], "term string, template int, w double")
    idfs = spark.createDataFrame(sorted(idf.items()), "term string, idf double")

    whole = tokens.groupBy("row", "term").agg(F.sum("tf").alias("tf")).join(rows, "row").where("n_lines > 1").select("row", F.lit(-1).alias("line_no"), "n_terms", "term", "tf")
    segments = tokens.select("row", "line_no", "n_terms", "term", "tf").unionByName(whole)
    valued = segments.join(F.broadcast(idfs), "term").withColumn("v", F.col("tf") * F.col("idf"))
    sized = valued.groupBy("row", "line_no", "n_terms").agg((F.sum(F.col("v") * F.col("v")) + (F.first("n_terms") - F.sum("tf")) * F.lit(rest * rest)).alias("sq"))
    dots = valued.join(F.broadcast(weights), "term").groupBy("row", "line_no", "template").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    scored = dots.join(sized, ["row", "line_no"]).select("row", "line_no", "n_terms", "template", F.round(F.col("dot") / F.sqrt("sq"), 9).alias("cosine")).where(F.col("cosine") >= least)
    best = scored.groupBy("row", "line_no", "n_terms").agg(F.max(F.struct("cosine", (-F.col("template")).alias("col2"))).alias("b"))
    own = best.groupBy("row").agg(F.max("b").alias("b"), F.sum(F.when(F.col("line_no") >= 0, F.col("n_terms")).otherwise(0)).alias("covered"), F.max(F.when(F.col("line_no") < 0, 1).otherwise(0)).alias("all_of_it"))
    windows = _windows(spark, given, terms_of.replace("lower(line)", "lower(text)"), counted, idf, rest, norms, least)
    own = own.withColumn("wide", F.lit(0)).unionByName(windows.select("row", "b", F.lit(0).alias("covered"), F.lit(0).alias("all_of_it"), "wide"))
    own = own.groupBy("row").agg(F.max("b").alias("b"), F.greatest(F.max("covered"), F.max("wide")).alias("covered"), F.max("all_of_it").alias("all_of_it"))
    names = F.array(*[F.lit(n) for n, _ in templates])
    own = own.join(rows, "row").select(F.col("row").alias("orow"), F.element_at(names, 1 - F.col("b.col2")).alias("own_licence"), F.col("b.cosine").alias("own_cosine"), ((F.col("all_of_it") == 1) | (F.col("covered") >= FILE_SHARE * F.col("n_terms"))).alias("mostly"))

    found = given.drop("text").join(own, F.col("row") == F.col("orow"), "left").select("id", "path", "own_licence", "own_cosine", (F.col("own_licence").isNotNull() & F.col("path").isNotNull() & (F.coalesce("mostly", F.lit(False)) | F.col("path").rlike(_NAMED))).alias("is_licence_file"))
    found = scratch.table(found)
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    in_dirs = found.where("is_licence_file").select(directory.alias("dir"), "path", "own_licence", "own_cosine").groupBy("dir").agg(F.min(F.struct((-F.col("own_cosine")).alias("c"), "path", "own_licence")).alias("b")).select("dir", F.col("b.own_licence").alias("dir_licence"), F.col("b.path").alias("dir_path"))
    # ancestors of a path: '', 'a', 'a/b', ...; the longest with a licence file wins
    need = found.where(F.col("own_licence").isNull() & F.col("path").isNotNull()).select("path").distinct().withColumn("d", directory)
    parts = F.split("d", "/")
    above = need.select("path", F.explode(F.array_distinct(F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))).alias("dir"))
    near = above.join(in_dirs, "dir").groupBy(F.col("path").alias("npath")).agg(F.max(F.struct(F.length("dir").alias("depth"), "dir_licence", "dir_path")).alias("b"))
    out = found.join(near, F.col("own_licence").isNull() & (F.col("path") == F.col("npath")), "left")
    return out.select("id", "path", "own_licence", "own_cosine", "is_licence_file", F.coalesce("own_licence", "b.dir_licence").alias("licence"), F.when(F.col("own_licence").isNotNull(), F.col("path")).otherwise(F.col("b.dir_path")).alias("licence_from"))
