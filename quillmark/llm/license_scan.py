"""License scan (operator 10): MinHash bands over overlapping windows, then exact shingle
containment.  DataFrame functions only.

Words are runs of letters and digits, A-Z lower-cased; shingles are ``WORDS`` words.  A
template of ``L`` words is looked for in windows of ``W = L + max(1, L // 4)`` words that
start every ``W - L + 1`` words, so any ``L`` consecutive words lie in some window whole.
A window that holds at least ``CONTAINED`` of a template's shingles then has a Jaccard
similarity of about a half or more with it, and with ``BANDS`` bands of one MinHash each
they collide in some band with a probability of at least ``1 - 0.5 ** BANDS``.  Windows and
templates that collide are verified on the shingles themselves.

Two exact conditions spare work and lose nothing: a matching window lacks less than a fifth
of the template's shingles, so it holds one of a few words that together lie in more
shingles than that (``anchors``); and a MinHash can only be equal if the window holds a
shingle of the template.

Defined results: one row per id and template that occurs, so texts without a match, null
and empty texts have none; rows that share an id are taken together; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
CONTAINED = 0.8
BANDS = 24
#: Anchors up to which texts are tested for them first.
MOST_ANCHORS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Short notices of common licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def anchors(templates: list[list[str]]) -> list[str]:
    """Words such that every text that matches a template holds one of its anchors."""
    out: set[str] = set()
    for words in templates:
        shingles = [words[i:i + WORDS] for i in range(len(words) - WORDS + 1)]
        may_lack = len(shingles) - -(-len(shingles) * round(CONTAINED * 100) // 100)
        left = [s for s in shingles if not any(w in out for w in s)]
        while len(shingles) - len(left) <= may_lack:
            best = max({w for s in left for w in s}, key=lambda w: (len(w) >= 6, sum(w in s for s in left), len(w), w))
            out.add(best)
            left = [s for s in left if best not in s]
    return sorted(out)


def window_of(length: int) -> tuple[int, int]:
    """Words of a window and of the step between windows."""
    width = length + max(1, length // 4)
    return width, width - length + 1


def _once(rows: DataFrame, name: str, value) -> DataFrame:
    """Adds a column behind a generator: filters and expressions on it use its value and
    are not rewritten in terms of what it was made from."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _shingles(words):
    return F.transform(F.sequence(F.lit(1), F.size(words) - (WORDS - 1)), lambda i: F.array_join(F.slice(words, i, WORDS), " "))


def _minhash(hashes):
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, j))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``license, width, step, template array<string>, band, value``: a few rows a
    template, from the literal texts."""
    usable = {k: template_words(t) for k, t in templates.items()}
    usable = {k: w for k, w in usable.items() if len(w) >= WORDS}
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(window_of(len(w))[0]).alias("width"), F.lit(window_of(len(w))[1]).alias("step"),
                              F.array(*map(F.lit, w)).alias("words")) for k, w in usable.items()])
    t = spark.range(1).select(F.inline(rows))
    t = t.withColumn("template", F.array_distinct(_shingles(F.col("words"))))
    t = t.withColumn("hashes", F.transform("template", lambda s: F.xxhash64(s)))
    return t.select("license", "width", "step", "template", "hashes", F.posexplode(_minhash(F.col("hashes"))).alias("band", "value"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, license, containment, first_word, n_windows``: the largest share of the
    template's shingles in a window, where the first matching window starts (in words) and
    how many windows match."""
    templates = templates or TEMPLATES
    spark = docs.sparkSession
    usable = {k: template_words(t) for k, t in templates.items() if len(template_words(t)) >= WORDS}
    lengths = sorted({window_of(len(w)) for w in usable.values()})
    shingles = [w[i:i + WORDS] for w in usable.values() for i in range(len(w) - WORDS + 1)]
    first = anchors(list(usable.values()))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    if len(first) <= MOST_ANCHORS:
        found = F.lit(False)
        for a in first:
            found = found | F.col("low").contains(a)
        rows = _once(rows, "low", F.lower("text")).where(found).drop("low")
    rows = _once(rows, "words", F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).drop("text")
    rows = _once(rows.where(F.size("words") >= WORDS), "shingles", _shingles(F.col("words"))).drop("words")
    rows = _once(rows, "hashes", F.transform("shingles", lambda s: F.xxhash64(s)))
    all_hashes = F.array(*[F.xxhash64(F.lit(" ".join(s))) for s in shingles])
    rows = rows.where(F.arrays_overlap("hashes", all_hashes))
    sizes = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(s).alias("step")) for w, s in lengths])
    rows = rows.select("*", F.inline(sizes))
    # first words of windows: 0, step, ... as long as a template fits
    last = F.greatest(F.size("shingles") + WORDS - 1 - F.col("width") + F.col("step") - 1, F.lit(0))
    rows = rows.select("doc_id", "shingles", "hashes", "width", "step", F.explode(F.sequence(F.lit(0), last, F.col("step"))).alias("first_word"))
    part = lambda c: F.slice(c, F.col("first_word") + 1, F.col("width") - (WORDS - 1))
    rows = _once(rows.withColumnRenamed("hashes", "all"), "hashes", F.array_distinct(part("all"))).where(F.arrays_overlap("hashes", all_hashes))
    rows = rows.select("doc_id", "width", "first_word", part("shingles").alias("shingles"), "hashes")
    known = template_table(spark, templates)
    bands = rows.select("doc_id", "width", "first_word", "shingles", F.posexplode(_minhash(F.col("hashes"))).alias("band", "value"))
    hits = bands.join(F.broadcast(known.select("license", "width", "template", "band", "value")), ["width", "band", "value"])
    share = F.size(F.array_intersect("template", "shingles")) / F.size("template")
    hits = hits.select("doc_id", "license", "first_word", share.alias("containment")).where(F.col("containment") >= CONTAINED).distinct()
    return hits.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"), F.count(F.lit(1)).alias("n_windows"))


def oracle(templates: dict[str, str] | None = None) -> str:
    """The same matches in DuckDB SQL, from every window and no MinHash."""
    usable = {k: template_words(t) for k, t in (templates or TEMPLATES).items() if len(template_words(t)) >= WORDS}
    values = ", ".join(f"('{k}', {window_of(len(w))[0]}, {window_of(len(w))[1]}, [{', '.join(repr(x) for x in w)}])" for k, w in usable.items())
    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) AS v(license, width, step, words)),
ts AS (SELECT license, width, step, list_distinct(list_transform(range(1, len(words) - {WORDS - 2}), lambda i: array_to_string(words[i:i + {WORDS - 1}], ' '))) AS template FROM t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\p{{L}}\\p{{N}}]+') AS words FROM documents),
s AS (SELECT doc_id, len(words) AS n, list_transform(range(1, len(words) - {WORDS - 2}), lambda i: array_to_string(words[i:i + {WORDS - 1}], ' ')) AS shingles FROM d WHERE len(words) >= {WORDS}),
c AS (SELECT s.*, license, width, step, template FROM s JOIN ts ON list_has_any(s.shingles, ts.template)),
w AS (SELECT *, unnest(range(0, greatest(n - width + step - 1, 0) + 1, step)) AS first_word FROM c),
x AS (SELECT doc_id, license, first_word, len(list_intersect(template, shingles[first_word + 1:first_word + width - {WORDS - 1}])) / len(template) AS containment FROM w)
SELECT doc_id, license, max(containment) AS containment, CAST(min(first_word) AS INTEGER) AS first_word, count(*) AS n_windows
FROM x WHERE containment >= {CONTAINED} GROUP BY doc_id, license"""
