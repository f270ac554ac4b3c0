"""Licence scans: sparse TF-IDF cosine to templates, then inheritance by directory (operator 6).

A file that speaks of a licence is read as notices: each line that does, each
stretch of up to ``WINDOW`` consecutive lines, paragraph and run of comment
lines that does, and the whole file.  Their words and word pairs, weighted by
TF-IDF over all notices of the corpus, are compared with templates (one-line
notices, header paragraphs and full texts) by a join on the terms.  A file that
is similar as a whole to a template of at least ``file_share`` of its length, or
whose matched lines make up that share of its words, is a licence file: it
licenses its directory.  A file takes the best template of its own notices; one without takes that of the
nearest directory above it that a licence file licenses, found by joining its
ancestor directories.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from importlib.resources import files as resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lossgrid.operators.flags import flag_words, with_flag

from .components import redealt
from .util import slices, small_side, stage, word_count

# The notices by which well-known licences are applied to a file.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("ISC", "Licensed under the ISC License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0"),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
GNU = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
#: The paragraph of a source file's header that names its licence.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-2.0", GNU.format("program", ";", "General Public License", ";", "2")),
    ("GPL-3.0", GNU.format("program", ":", "General Public License", ",", "3")),
    ("LGPL-2.1", GNU.format("library", ";", "Lesser General Public License", ";", "2.1")),
    ("LGPL-3.0", GNU.format("library", ":", "Lesser General Public License", ",", "3")),
    ("AGPL-3.0", GNU.format("program", ":", "Affero General Public License", ",", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
)
#: Licence and notice; a licence may have several notices.
Templates = tuple[tuple[str, str], ...]
CUE = r"(?i)licen[sc]e|copyright|public\s+domain|creative\s+commons|spdx|\bcc0\b|\bcc[ -]by\b"
SPEAKS = re.compile(CUE)
#: Lines over which a notice may be wrapped beside other text; alone in a paragraph it may have any number.
WINDOW = 5
COMMENT = re.compile(r"\s*(?:/\*+|\*+/|\*|//+|#+|--+|;+|%+|<!--|dnl\b)")
LINE, BLOCK, WHOLE = range(3)
LEAST_COSINE = 0.5
FILE_SHARE = 0.5


def terms(text: Column) -> Column:
    """Lower-cased words (a version like 2.0 is one) and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.\p{N}+)*"), F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


@cache
def known_templates() -> Templates:
    """One-line notices, headers and the full texts beside this module."""
    full = [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in (resources(__package__) / "licence_texts").iterdir() if f.name.endswith(".txt")]
    return (*NOTICES, *HEADERS, *sorted(full))


def templates(spark: SparkSession, given: Templates | None = None) -> DataFrame:
    given = known_templates() if given is None else given
    return spark.createDataFrame([(i, *t) for i, t in enumerate(sorted(given))], "template int, licence string, notice string")


def matches(notices: DataFrame, known: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """notice_id, licence, size (words of the template), cosine: the best template of every distinct notice text.

    ``notices``: notice_id, notice, n (how often the text occurs).  Document
    frequencies count every occurrence and every template.  Ties go to the
    licence first by name.

    No term weighs less than 1, so a notice's terms that are in templates and
    the number of its others bound its cosine from above; only notices whose
    bound reaches ``least`` have all their terms weighed.
    """
    total = (notices.agg(F.sum("n")).first()[0] or 0) + known.count()
    # What a row has once is computed below explode, not for each term.
    two = known.withColumn("size", word_count(F.col("notice"))).select("template", "licence", "size", F.explode(terms(F.col("notice"))).alias("term")).groupBy("template", "licence", "size", "term").agg(F.count("*").alias("tf"))
    two = stage(two, "template-terms")
    weight = (1 + F.log("tf")) * F.col("idf")

    def idf(counts: DataFrame) -> DataFrame:
        every = counts.unionByName(two.groupBy("term").agg(F.count("*").alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
        return every.select("term", (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1).alias("idf"))

    listed = notices.select("notice_id", "n", terms(F.col("notice")).alias("terms"))
    near = listed.withColumn("kinds", F.size(F.array_distinct("terms"))).select("notice_id", "n", "kinds", F.explode("terms").alias("term"))
    near = near.join(small_side(two.select("term").distinct()), "term").groupBy("notice_id", "n", "kinds", "term").agg(F.count("*").alias("tf"))
    near = stage(near, "notice-terms")
    common = small_side(stage(idf(near.groupBy("term").agg(F.sum("n").alias("df"))), "idf"))
    own = near.join(common, "term").select("notice_id", "kinds", "term", weight.alias("w"))
    theirs = two.join(common, "term").select("template", "licence", "size", "term", weight.alias("v"))
    theirs = theirs.withColumn("length", F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("template"))))
    shortest = own.groupBy("notice_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w")) + F.max("kinds") - F.count("*")).alias("shortest"))
    dots = own.join(small_side(theirs), "term").groupBy("notice_id", "template", "licence", "size", "length").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    possible = stage(dots.join(shortest, "notice_id").where(F.col("dot") >= (least - 1e-6) * F.col("shortest") * F.col("length")), "possible")

    left = listed.join(possible.select("notice_id").distinct(), "notice_id", "left_semi")
    one = stage(left.select("notice_id", F.explode("terms").alias("term")).groupBy("notice_id", "term").agg(F.count("*").alias("tf")), "possible-terms")
    # Of all terms only those that these notices hold are counted: a bounded set of
    # flags takes the others out where they are read, and the rest is summed up
    # before it is dealt.  A term let through by a collision meets nothing below.
    met = listed.withColumn("terms", F.array_distinct("terms")).select("n", F.explode("terms").alias("term"))
    met = with_flag(met, F.xxhash64("term"), flag_words(one.select(F.xxhash64("term").alias("hash")), "hash")).where("_flagged")
    norms = one.join(idf(met.groupBy("term").agg(F.sum("n").alias("df"))), "term").groupBy("notice_id").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    scored = possible.join(norms, "notice_id").select("notice_id", "licence", "size", F.round(F.col("dot") / (F.col("norm") * F.col("length")), 9).alias("cosine"))
    best = scored.groupBy("notice_id").agg(F.min(F.struct((-F.col("cosine")).alias("below"), "licence", "size")).alias("b"))
    return best.select("notice_id", "b.licence", "b.size", (-F.col("b.below")).alias("cosine")).where(F.col("cosine") >= least)


def notices(text: str) -> Iterator[tuple[int, str]]:
    """LINE, BLOCK or WHOLE and the words of all that may be a licence notice in a text.

    Lines come once for each place, blocks of lines once for each wording.
    """
    lines = text.split("\n")
    speaks = [bool(SPEAKS.search(x)) for x in lines]
    yield from ((LINE, x.strip(" ")) for x, s in zip(lines, speaks, strict=True) if s)
    whole = text.strip()
    yield WHOLE, whole

    marks, inside = [], False  # is the line a comment; in a block comment
    for x in lines:
        marks.append(inside or bool(COMMENT.match(x)))
        if "/*" in x or "*/" in x:
            inside = x.rfind("/*") > x.rfind("*/")
    bare = [COMMENT.sub("", x, count=1).strip() for x in lines]
    filled = [any(c.isalnum() for c in x) for x in bare]
    blocks = {}  # in the order found
    for runs, least in ((_stretches(filled), 2), (_stretches(marks), 1)):
        for a, b in runs:
            if b - a >= least:
                blocks[a, b] = None
            if least == 2:
                for n in range(2, min(WINDOW, b - a - 1) + 1):
                    blocks.update(dict.fromkeys((i, i + n) for i in range(a, b - n + 1)))
    seen = {whole}
    for a, b in blocks:
        block = " ".join(bare[a:b]).strip()
        if block not in seen and (any(speaks[a:b]) or SPEAKS.search(block)):
            seen.add(block)
            yield BLOCK, block


def _stretches(flags: list[bool]) -> list[tuple[int, int]]:
    """Start and end of each run of true values."""
    edges = [i for i, (x, y) in enumerate(zip([False, *flags], [*flags, False], strict=True)) if x != y]
    return list(zip(edges[::2], edges[1::2], strict=True))


def _notices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 16):
        at, kinds, found = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for kind, notice in notices(text):
                at.append(i), kinds.append(kind), found.append(notice)
        same = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("key", "path", "n_words")]
        yield pa.RecordBatch.from_arrays([*same, pa.array(kinds, pa.int32()), pa.array(found, pa.string())], ["key", "path", "n_words", "kind", "notice"])


def ancestors(path: Column) -> Column:
    """The directories above a path with their depth, from the root ('') down."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))


def scan(files: DataFrame, given: Templates | None = None, least: float = LEAST_COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """One row for each row of ``files`` (file_id, path, text; other columns are ignored).

    file_id, path, n_notices (lines that speak of a licence), own (licence of
    the most similar notice: line, block of lines or whole file), cosine,
    licence_file, licence (own, or inherited), origin ('notice', 'directory' or
    null) and from_dir (the directory that licensed it).  Whole texts are read;
    a null or empty text has no notice, a null path no directory but the root.
    Of several licence files in a directory the most similar counts, then the
    first licence by name.  Rows that repeat an id and path are taken as one
    file's; each gets the file's result.  An empty table gives an empty table.
    """
    key = F.xxhash64("file_id", "path")
    rows = files.select("file_id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", key)
    lines = rows.where(F.col("text").rlike(CUE)).select("key", "path", word_count(F.col("text")).alias("n_words"), "text")
    lines = lines.mapInArrow(_notices, "key long, path string, n_words long, kind int, notice string").withColumn("notice_id", F.xxhash64(F.lower("notice")))
    lines = stage(lines.withColumn("notice_words", F.when(F.col("kind") == LINE, word_count(F.col("notice")))), "notices")
    texts = stage(lines.groupBy("notice_id").agg(F.min("notice").alias("notice"), F.count("*").alias("n")), "notice-texts")
    best = stage(matches(texts, templates(files.sparkSession, given), least), "matches")

    found = lines.join(best.withColumnRenamed("notice_id", "m"), redealt(F.col("notice_id")) == F.col("m"), "left")
    owned = found.groupBy("key", "path", "n_words").agg(
        F.count_if(F.col("kind") == LINE).alias("n_notices"),
        F.sum(F.when(F.col("licence").isNotNull(), F.col("notice_words"))).alias("licence_words"),
        F.max((F.col("kind") == WHOLE) & F.col("licence").isNotNull() & (F.col("size") >= file_share * F.col("n_words"))).alias("whole"),
        F.min(F.when(F.col("licence").isNotNull(), F.struct((-F.col("cosine")).alias("below"), "licence"))).alias("b"),
    )
    owned = owned.select("key", "path", "n_notices", F.col("b.licence").alias("own"), (-F.col("b.below")).alias("cosine"), (F.coalesce("whole", F.lit(False)) | (F.coalesce("licence_words", F.lit(0)) >= file_share * F.col("n_words"))).alias("licence_file"))
    owned = stage(owned, "owned")

    place = F.regexp_replace("path", r"/?[^/]*$", "")
    directories = owned.where("licence_file and own is not null").select(place.alias("dir"), "own", "cosine").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("below"), F.col("own").alias("licence"))).alias("b"))
    directories = stage(directories.select(F.col("dir").alias("d"), F.col("b.licence").alias("licence")), "directories")
    # Directories inherit first, one row for each, so files join their own directory only.
    every = rows.select(place.alias("place")).distinct()
    up = every.select("place", F.explode(ancestors(F.concat(F.col("place"), F.lit("/")))).alias("a")).select("place", "a.depth", "a.dir")
    nearest = up.join(directories, F.col("dir") == F.col("d")).groupBy("place").agg(F.max(F.struct("depth", "dir", "licence")).alias("n"))
    nearest = stage(nearest.select(F.col("place").alias("at"), F.col("n.dir").alias("from_dir"), F.col("n.licence").alias("inherited")), "nearest")

    plain = rows.select("file_id", "path", "key", place.alias("place"))
    mine = owned.select(F.col("key").alias("k"), "n_notices", "own", "cosine", "licence_file")
    out = plain.join(mine, F.col("key") == F.col("k"), "left").join(small_side(nearest), F.col("place") == F.col("at"), "left")
    return out.select(
        "file_id",
        "path",
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        "own",
        "cosine",
        F.coalesce("licence_file", F.lit(False)).alias("licence_file"),
        F.coalesce("own", "inherited").alias("licence"),
        F.when(F.col("own").isNotNull(), "notice").when(F.col("inherited").isNotNull(), "directory").alias("origin"),
        F.when(F.col("own").isNull(), F.col("from_dir")).alias("from_dir"),
    )
