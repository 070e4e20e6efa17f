"""License scans by diagonal voting (operator 11), in DataFrame operations only.

Every run of k words of every text, as a rolling hash, is joined with the places of the templates' runs. A hit at word
i of the text and word j of the template votes for the diagonal i - j, the place at which the template would begin.
Votes are added up by diagonal; a diagonal and its neighbours, which words left out or put in have shifted, are merged;
and of what remains the words are verified: hits are compared as words, not only as hashes, and the share of the
template's words that verified hits cover is the place's coverage. A template counts from `similarity` on.

k is WORDS, or all words of a template with fewer. An exact phrase counts wherever its words stand consecutively; other
templates are notices, found with a fifth of their words changed. The templates are a list in the program, and so small
that the join sends them to all tasks: the number of their words is checked against MOST_WORDS.

One pass reads the texts. It keeps hits, which few runs are, and one marker row a document; all later steps read those.

Defined results: words are runs of what isn't an ASCII sign, space or control character, A-Z in lower case; a null text
is empty and has no words; repeated rows, and rows without a doc_id, are documents of their own; templates that tie all
count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, table, texts_of

#: Words of a run, least coverage of a notice, words that all templates may have together.
WORDS, SIMILARITY, MOST_WORDS = 4, 0.8, 100_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: fixed value, after lowering A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False

    @property
    def words(self) -> list[str]:
        kept = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in self.text)
        return "".join(c.lower() if c in UPPER else c for c in kept).split()

    def slack(self, similarity: float) -> int:
        """Words by which neighbouring diagonals may be apart; none for an exact phrase."""
        return 0 if self.exact else int(len(self.words) * (1 - similarity) + 1e-9)


#: Phrases and their labels: fixed values.
PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]
#: Notices as licenses ask for them: fixed values.
NOTICES = [
    Template("mit", "Released under the MIT License."),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    Template("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    Template(
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    Template(
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    ),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]
TEMPLATES = PHRASES + NOTICES


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.col(text), UPPER, UPPER.lower()), BETWEEN), "")


def rolling(words: Column, length: int, width: int) -> Column:
    """The runs of this many words as structs of `width` words, the rest null."""
    count = F.greatest(F.size(words) - (length - 1), F.lit(0))
    nothing = F.array_repeat(F.lit(None).cast("string"), count)
    return F.arrays_zip(*((F.slice(words, k + 1, count) if k < length else nothing).alias(f"w{k}") for k in range(width)))


def places(templates: list[Template], k: int, similarity: float) -> list[tuple]:
    """(template, label, exact, size, slack, run, j, gram): every run of words of every template."""
    out = []
    for number, t in enumerate(templates):
        w, slack = t.words, t.slack(similarity)
        run = min(k, len(w))
        out += [(number, t.label, t.exact, len(w), slack, run, j, " ".join(w[j : j + run])) for j in range(len(w) - run + 1) if run]
    return out


def hits(docs: DataFrame, templates: list[Template], k: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc, doc_id, n_words, and by hit: i and j (words of text and template), template, label, exact, size, slack, run. One row a document has none."""
    known = places(templates, k, similarity)
    if sum(t[5] + 1 for t in known) > MOST_WORDS * k:
        raise ValueError(f"templates of more than {MOST_WORDS} words")
    lengths, width = sorted({t[5] for t in known}), max((t[5] for t in known), default=1)
    spark = docs.sparkSession
    schema = "template int, label string, exact boolean, size int, slack int, run int, j int, known string"
    runs = spark.createDataFrame([*known, (None, None, None, None, None, 0, None, None)], schema)
    runs = runs.withColumn("hash", F.when(F.col("run") > 0, F.xxhash64(*(F.get(F.split("known", " "), F.lit(n)) for n in range(width)))).otherwise(F.lit(0)))
    marker = F.array(F.struct(*(F.lit(None).cast("string").alias(f"w{n}") for n in range(width))))
    rows = texts_of(docs).select(F.monotonically_increasing_id().alias("doc"), "doc_id", words_of("text").alias("w"))
    rows = rows.select("doc", "doc_id", F.size("w").alias("n_words"), F.posexplode(F.concat(marker, *(rolling(F.col("w"), n, width) for n in lengths))).alias("p", "g"))
    # the runs of one length follow those of the length before: size of words less (length - 1) of them each
    i, run, upto = F.lit(None).cast("int"), F.lit(0), F.lit(1)
    for n in lengths:
        i, run = F.when(F.col("p") >= upto, F.col("p") - upto).otherwise(i), F.when(F.col("p") >= upto, F.lit(n)).otherwise(run)
        upto = upto + F.greatest(F.col("n_words") - (n - 1), F.lit(0))
    grams = [F.col(f"g.w{n}") for n in range(width)]
    rows = rows.select("doc", "doc_id", "n_words", i.alias("i"), run.alias("length"), F.concat_ws(" ", *grams).alias("gram"), F.when(F.col("p") > 0, F.xxhash64(*grams)).otherwise(F.lit(0)).alias("hash"))
    # doc numbers a row of the scan; written here, they stay
    found = stage(rows.join(F.broadcast(runs), "hash").drop("hash"), "license-hits")
    return found.where("run = 0 and length = 0 or run = length and gram = known").drop("length", "gram", "known")


def spans(found: DataFrame) -> DataFrame:
    """doc, doc_id, template, label, exact, begin, end (words), votes, alone, coverage: each diagonal of hits(), with its neighbours.

    coverage: of the template's words, the share that verified hits of the diagonal and its neighbours cover; alone: of the diagonal only.
    """
    votes = found.where("run > 0").groupBy("doc", "template", (F.col("i") - F.col("j")).alias("diagonal"))
    votes = votes.agg(
        F.first("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("label", "exact", "size", "slack", "run")),
        F.collect_set("j").alias("js"), F.min("i").alias("begin"), (F.max("i") + F.max("run")).alias("end"),
    )
    # diagonals at most `slack` apart, on a scale where slack is 1: no more of them than 2 slack + 1, with no more runs than the template has
    near = Window.partitionBy("doc", "template").orderBy(F.col("diagonal") / F.greatest(F.col("slack"), F.lit(0.5))).rangeBetween(-1, 1)
    covered = lambda js: F.size(F.array_distinct(F.flatten(F.transform(js, lambda j: F.sequence(j, j + F.col("run") - 1)))))
    merged = votes.select(
        "*", F.flatten(F.collect_list("js").over(near)).alias("near_js"),
        F.min("begin").over(near).alias("from"), F.max("end").over(near).alias("to"),
    )
    return merged.select(
        "doc", "doc_id", "template", "label", "exact", "diagonal", F.col("from").alias("begin"), F.col("to").alias("end"),
        F.size("near_js").alias("votes"), (covered(F.col("js")) / F.col("size")).alias("alone"), (covered(F.col("near_js")) / F.col("size")).alias("coverage"),
    )


def license_scan(docs: DataFrame, templates: list[Template] = TEMPLATES, k: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base: places of exact templates, and the first and last of them; labels: those of exact templates and of notices
    covered to `similarity`; score: the largest coverage of any template, 0 without a hit.
    """
    found = hits(docs, templates, k, similarity)
    base, notice = F.col("exact") & (F.col("alone") == 1), ~F.col("exact") & (F.col("coverage") >= similarity - 1e-9)
    names = lambda which: F.array_sort(F.collect_set(F.when(which, F.col("label"))))
    by_doc = spans(found).groupBy("doc").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("diagonal"))).alias("first_word"), F.max(F.when(base, F.col("diagonal"))).alias("last_word"),
        names(base).alias("base"), names(base | notice).alias("all"), F.max("coverage").alias("score"),
    )
    every = found.where("run = 0").select("doc", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    joined = lambda c: F.concat_ws(",", F.coalesce(F.col(c), F.array().cast("array<string>")))
    return every.join(by_doc, "doc", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"), joined("base").alias("base_labels"), joined("all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql(templates: list[Template] = TEMPLATES, k: int = WORDS, similarity: float = SIMILARITY) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ",\n  ".join(f"({n}, {quoted(label)}, {exact}, {size}, {slack}, {run}, {j}, {quoted(gram)})" for n, label, exact, size, slack, run, j, gram in places(templates, k, similarity))
    return f"""
WITH t(template, label, exact, size, slack, run, j, gram) AS (VALUES
  {values}),
d AS (SELECT row_number() OVER () AS doc, doc_id,
             list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc, run, unnest(range(0, len(w) - run + 1)) AS i, w FROM d, (SELECT DISTINCT run FROM t) WHERE len(w) >= run),
h AS (SELECT doc, template, i, j FROM (SELECT doc, run, i, array_to_string(w[i + 1:i + run], ' ') AS gram FROM g) JOIN t USING (run, gram)),
v AS (SELECT doc, template, i - j AS diagonal, list(j) AS js FROM h GROUP BY ALL),
n AS (SELECT a.doc, a.template, a.diagonal, any_value(label) AS label, any_value(exact) AS exact, any_value(size) AS size,
             list(DISTINCT x) FILTER (a.diagonal = b.diagonal) AS own, list(DISTINCT x) AS near
      FROM v a JOIN (SELECT DISTINCT template, label, exact, size, slack, run FROM t) USING (template)
      JOIN v b ON a.doc = b.doc AND a.template = b.template AND abs(a.diagonal - b.diagonal) <= slack,
      unnest(flatten(list_transform(b.js, lambda y: range(y, y + run)))) AS u(x) GROUP BY ALL),
c AS (SELECT doc, diagonal, label, len(near) / size AS coverage, exact AND len(own) = size AS base, NOT exact AND len(near) / size >= {similarity}e0 - 1e-9 AS notice FROM n),
s AS (SELECT doc, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word, max(diagonal) FILTER (base) AS last_word,
             list_sort(list(DISTINCT label) FILTER (base)) AS base, list_sort(list(DISTINCT label) FILTER (base OR notice)) AS every, max(coverage) AS score FROM c GROUP BY doc)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(every, ','), '') AS labels, coalesce(score, 0e0) AS score
FROM d LEFT JOIN s USING (doc)
"""


SQL = _sql()
