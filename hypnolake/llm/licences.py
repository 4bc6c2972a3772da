"""Licence scan: an exact set-similarity join of text blocks with licence templates, in DataFrame functions only.

A block (line) meets a template if it holds at least the share ``THRESHOLD`` of the template's distinct words. All template words
are ordered by the number of blocks of the corpus that hold them, rarest first. A block that reaches the needed overlap must hold one of a template's
first |T| - need + 1 words (prefix filter), must hold enough template words at all (length filter), and from the place of the
first common word on, both sides must still have enough words (positional filter). What is left is verified word by word. Where a block meets
two templates and the words of one are among the other's, only one counts: the longer if a word that it adds stands there, else the shorter.

Texts are read once: each block is reduced to the template words in it, written to the shared folder. The templates are a fixed list, so
broadcasting them is bounded; the join needs no shuffle, and a pair is met at its rarest common word only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hypnolake.session import cut_lineage

from .common import id_text, query, table

THRESHOLD = 0.9
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that name a licence by themselves, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public licence notices, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
               "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def template_words(templates: list[tuple[str, str]], threshold: float) -> list[tuple[int, str, list[str], int]]:
    """(number, label, distinct words, needed overlap) of each template."""
    out = []
    for k, (label, text) in enumerate(templates):
        words = sorted(set(re.findall(r"[a-z0-9]+", text.lower())))
        out.append((k, label, words, math.ceil(threshold * len(words) - 1e-9)))
    return out


def nested_templates(known: list[tuple[int, str, list[str], int]]) -> list[tuple[int, int, list[str]]]:
    """(number of a template, number of one that holds all its words and more, the words it adds)."""
    return [(k, j, sorted(set(wide) - set(words))) for k, _, words, _ in known for j, _, wide, _ in known if set(words) < set(wide)]


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _is(words: Column, at: Column, phrase: str) -> Column:
    """Whether the words of ``phrase`` stand at ``at``."""
    hit = F.lit(True)
    for k, w in enumerate(phrase.split()):
        hit = hit & F.coalesce(F.get(words, at + k) == w, F.lit(False))
    return hit


def _reduced(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per row: n_words, places of phrases, phrase labels, and per block the template words in it.

    ``lower`` changes letters beyond A-Z too; none of them becomes a letter of a phrase or ends a word, so counts and places stand.
    """
    rows = id_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.lower("text").alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", _GAP), lambda w: w != ""))
    any_ = lambda at: [_is(F.col("words"), at, p) for p in PHRASES]
    places = F.when(
        F.contains("text", F.lit("license")),
        F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: any_(i)[0] | any_(i)[1] | any_(i)[2]),
    )
    rows = rows.withColumn("places", places)
    named = F.array_compact(F.array(*(F.when(F.exists("places", lambda i: _is(F.col("words"), i, p)), F.lit(label)) for p, label in PHRASES.items())))
    blocks = F.transform(F.split("text", "\n"), lambda s: F.array_intersect(F.split(s, _GAP), _strings(vocabulary)))
    return rows.select(
        "row", "doc_id", F.size("words").cast("long").alias("n_words"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.coalesce(named, F.array().cast("array<string>")).alias("base"), blocks.alias("blocks"),
    )


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Words, phrase places, licence labels and score per row of ``docs`` (doc_id, text).

    ``score`` is the largest share of a template that a block holds, among those that meet the threshold; 1 where a phrase stands;
    else 0. Null or empty text has no words and no labels; a null doc_id stays; equal rows each get the same result; a text of any length is one row of blocks;
    an empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    known = template_words(templates, threshold)
    vocabulary = sorted({w for _, _, words, _ in known for w in words})
    least = min(need for *_, need in known)
    rows = cut_lineage(_reduced(docs, vocabulary))
    blocks = rows.select("row", F.explode("blocks").alias("held")).filter(F.size("held") >= least)
    # Frequencies over all blocks, combined before the shuffle; at most one row per template word.
    freq = rows.select(F.explode("blocks").alias("held")).select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    listed = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(need).alias("need"),
             _strings(words).alias("words")) for k, label, words, need in known))).alias("t")).select("t.*")
    counted = listed.select("template", "label", "need", F.explode("words").alias("word")).join(F.broadcast(freq), "word", "left")
    ordered = counted.groupBy("template", "label", "need").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).getField("word").alias("t_words"))
    size = F.size("t_words")
    prefix = ordered.select("template", "label", "need", "t_words", F.posexplode(F.slice("t_words", F.lit(1), size - F.col("need") + 1)).alias("at", "word"))
    probes = blocks.select("row", "held", F.explode("held").alias("word"))
    met = probes.join(F.broadcast(prefix), "word").filter(F.size("held") >= F.col("need"))  # length
    met = met.filter(F.size("t_words") - F.col("at") >= F.col("need"))  # position: words left in the template from its rarest common one
    common = F.array_intersect("t_words", "held")  # in the template's order
    met = met.withColumn("common", common).filter((F.get("common", F.lit(0)) == F.col("word")) & (F.size("common") >= F.col("need")))
    holds = lambda words, need: F.size(F.array_intersect("held", _strings(words))) >= need
    for k, j, added in nested_templates(known):
        (*_, short, short_need), (*_, wide, wide_need) = known[k], known[j]
        less = (F.col("template") == k) & holds(added, 1) & holds(wide, wide_need)
        more = (F.col("template") == j) & ~holds(added, 1) & holds(short, short_need)
        met = met.filter(~(less | more))
    found = met.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.size("common") / F.size("t_words")).alias("share"))
    none = F.array().cast("array<string>")
    return rows.drop("blocks").join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", none)))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    values = ", ".join(f"({k}, '{label}', [{', '.join(repr(w) for w in words)}], {need})" for k, label, words, need in template_words(TEMPLATES, THRESHOLD))
    words = lambda s: f"[w FOR w IN regexp_split_to_array({s}, '{_GAP}') IF w <> '']"
    places = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM spots WHERE array_to_string(words[i:i + {len(p.split()) - 1}], ' ') = '{p}'" for p, label in PHRASES.items()
    )
    return f"""
WITH t(template, label, words, need) AS (VALUES {values}),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, text, {words("text")} AS words FROM d),
spots AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE contains(text, 'license')),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
blocks AS (SELECT doc_id, list_distinct({words("line")}) AS held FROM lines),
nested AS (SELECT s.template AS k, s.words AS short, s.need AS short_need, b.template AS j, b.words AS wide, b.need AS wide_need, [w FOR w IN b.words IF NOT list_contains(s.words, w)] AS added
  FROM t s, t b WHERE len(b.words) > len(s.words) AND len(list_intersect(s.words, b.words)) = len(s.words)),
met AS (
  SELECT doc_id, label, len(list_intersect(held, t.words)) / len(t.words) AS share
  FROM blocks, t WHERE len(list_intersect(held, t.words)) >= need AND NOT EXISTS (SELECT 1 FROM nested WHERE
    k = t.template AND list_has_any(held, added) AND len(list_intersect(held, wide)) >= wide_need
    OR j = t.template AND NOT list_has_any(held, added) AND len(list_intersect(held, short)) >= short_need)
),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM met GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, base.first_word, base.last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(found.share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op2_licences", _sql())
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return scan(table(spark, sf_dir, "documents"))
