"""License scans with DataFrame functions only.

Segments (header lines and whole files) that name a licence term are compared with templates by sparse TF-IDF cosine. A file
whose whole text matches is a licence file of its directory; files without a header of their own inherit from the nearest
directory above them that has one, found by joins on paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stored

# Wordings of licence notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
]
#: A segment is compared only if it holds one of these; every template does.
NAMES = "licen[cs]e|redistribution"
HEADER, FILE = 0.75, 0.5  # cosines from which a line is a header and a text a licence file


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def template_weights(spark: SparkSession) -> DataFrame:
    """(template, licence, term, tf): as many rows as the templates have words."""
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(name).alias("licence"), F.lit(text).alias("text")) for k, (name, text) in enumerate(TEMPLATES)])
    rows = spark.range(1).select(F.inline(rows))
    return rows.select("template", "licence", F.explode(words(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))


def idf(files: DataFrame) -> DataFrame:
    """(term, idf) of the template terms by the number of files that hold them; the empty term stands for any other word."""
    terms = sorted({w for _, t in TEMPLATES for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()})
    held = F.array_distinct(F.filter(words(F.col("text")), lambda w: w.isin(terms)))
    # The empty term, which every file gets, counts the files in the same pass. One row holds all counts: one per template term.
    counts = files.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    both = counts.agg(F.collect_list(F.struct("term", "df")).alias("all"), F.max(F.when(F.col("term") == "", F.col("df"))).alias("n"))
    both = both.select("n", F.inline("all"))
    return both.select("term", F.when(F.col("term") == "", F.log1p("n")).otherwise(F.log1p(F.col("n") / F.col("df"))).alias("idf"))


def cosines(segments: DataFrame, weights: DataFrame, idfs: DataFrame) -> DataFrame:
    """(key, licence, cosine) of the best template of each of ``segments`` (key, segment), which are distinct; of equal cosines the last licence by name.

    ``weights`` and ``idfs`` have a row per template word and are broadcast. Words of no template, and template words of no
    file, weigh like a word of no file.
    """
    rest = idfs.where("term = ''").select("idf").scalar()
    weighed = lambda d: d.join(F.broadcast(idfs), "term", "left").withColumn("w", F.col("tf") * F.coalesce(F.col("idf"), rest))
    t = weighed(weights)
    size = t.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    t = t.join(F.broadcast(size), "template").groupBy("term").agg(F.collect_list(F.struct("template", "licence", (F.col("w") / F.col("norm")).alias("w"))).alias("of"))
    tf = segments.select("key", F.explode(words(F.col("segment"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    hit = weighed(tf).join(F.broadcast(t), "term", "left")
    norm = hit.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = hit.where("of is not null").select("key", "w", F.explode("of").alias("t"))
    dot = dot.groupBy("key", "t.template", "t.licence").agg(F.sum(F.col("w") * F.col("t.w")).alias("dot"))
    best = dot.join(norm, "key").select("key", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"), "licence")
    return best.groupBy("key").agg(F.max(F.struct("cosine", "licence")).alias("best")).select("key", "best.*")


def scan(files: DataFrame) -> DataFrame:
    """One row per row of ``files`` (doc_id, path, text): doc_id, path, header (licence of its best line), header_cosine,
    file_licence (if the whole text is a licence), licence (the one that holds) and inherited_from (a directory).

    A null text is empty and has no licence of its own; a null path lies in the directory ''. Rows of one path are one file
    as to directories; repeated rows each get their row. Other columns are ignored; an empty table gives an empty table.
    """
    spark = files.sparkSession
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    names = lambda c: F.lower(c).rlike(NAMES)
    named = files.where(names(F.col("text"))).select("path", "text", F.filter(F.array_distinct(F.split("text", "\n")), names).alias("lines"))
    pairs = named.select("path", "text", F.explode(F.array_union("lines", F.array("text"))).alias("segment"))
    # A digest stands for the segment, so that no word carries a whole text along.
    pairs = pairs.select("path", "segment", F.unhex(F.md5("segment")).alias("key"), (F.col("segment") == F.col("text")).alias("whole"))
    scored = cosines(pairs.groupBy("key").agg(F.first("segment").alias("segment")), template_weights(spark), stored(idf(files), "license-idf"))
    pairs = pairs.select("path", "key", "whole").distinct().join(scored.where(F.col("cosine") >= FILE), "key")
    top = lambda ok, what: F.max_by(F.when(ok, F.col(what)), F.when(ok, F.struct("cosine", "licence")))
    header, whole = F.col("cosine") >= HEADER, F.col("whole")
    own = pairs.groupBy("path").agg(
        top(header, "licence").alias("header"), F.max(F.when(header, F.col("cosine"))).alias("header_cosine"),
        top(whole, "licence").alias("file_licence"), F.max(F.when(whole, F.col("cosine"))).alias("file_cosine"),
    )
    above = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    holders = own.where("file_licence is not null").groupBy(above(F.col("path")).alias("ancestor"))
    holders = holders.agg(F.max_by("file_licence", F.struct("file_cosine", "file_licence")).alias("from_dir"))
    dirs = files.select(above(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    chain = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("ancestor"))
    nearest = chain.join(holders, "ancestor").groupBy("dir").agg(F.max_by(F.struct("ancestor", "from_dir"), F.length("ancestor")).alias("near"))
    out = files.select("doc_id", "path", above(F.col("path")).alias("dir")).join(own, "path", "left").join(nearest, "dir", "left")
    mine = F.coalesce("header", "file_licence")
    return out.select(
        "doc_id", "path", "header", "header_cosine", "file_licence", F.coalesce(mine, "near.from_dir").alias("licence"),
        F.when(mine.isNull(), F.col("near.ancestor")).alias("inherited_from"),
    )
