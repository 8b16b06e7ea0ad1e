"""License scan: an exact set-similarity join of text blocks with license templates.

A block holds a template if it has at least the template's share of its distinct words. Words are put into one global
order, the corpus' rarest first, and then
* prefix: of a template of n words that needs `least` of them, a block must have one of the first n - least + 1;
* length: a block with fewer than `least` words of any template is none;
* position: at the first common word, what is left of both sets must suffice for `least`.
What passes is counted exactly, so no block is missed and none is wrong. Blocks are windows of 2s words at every s-th
word, s being the power of two (8 at least) that covers the template, so that a passage as long as the template lies
whole in one. Only blocks around a prefix word are ever made, from whole texts, and only the words of templates count.

Everything is DataFrame operations: a pass that counts the template's words in the corpus, and a pass that finds the
blocks and joins them with the templates' prefixes. Documents aren't shuffled, only a narrow row each and one for each
block that holds a template.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose words stand consecutively, and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]


@dataclass(frozen=True)
class Template:
    """A license's wording; share: of its distinct words, how many a block must have."""

    label: str
    text: str
    share: float = 0.8


#: Wordings by which licenses are given. Short ones need nearly all their words.
TEMPLATES = [
    Template("apache-2", "Licensed under the Apache License, Version 2.0", 0.9),
    Template("apache-2", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", 0.9),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", 0.9),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3", 0.9),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mit", "Released under the MIT License", 0.9),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    lowered = text.translate(str.maketrans(UPPER, LOWER))
    return [w for w in re.split(_BETWEEN, lowered) if w]


def spaced(text) -> Column:
    """Column: the words of a text with one space between; empty for null and texts without words."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.btrim(F.regexp_replace(lowered, _BETWEEN, " "), F.lit(" "))


@dataclass(frozen=True)
class _Plan:
    """Templates in the global order: ranks are places in vocab, from 1, the rarest word first."""

    vocab: list[str]
    rows: list[dict]  # of each template: label, size, least, step, ranks


def _planned(templates: list[Template], seen: dict[str, int]) -> _Plan:
    sets = [(t, template_words(t.text)) for t in templates]
    if any(not w for _, w in sets) or any(not 0 < t.share <= 1 for t in templates):
        raise ValueError("a template needs words, and a share above 0 up to 1")
    vocab = sorted({w for _, ws in sets for w in ws}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: k + 1 for k, w in enumerate(vocab)}
    rows = []
    for t, ws in sets:
        ranks = sorted({rank[w] for w in ws})
        step = max(8, 1 << (len(ws) - 1).bit_length())
        rows.append({"label": t.label, "size": len(ranks), "least": math.ceil(t.share * len(ranks) - 1e-9), "step": step, "ranks": ranks})
    return _Plan(vocab, rows)


def word_counts(docs: DataFrame, vocab: set[str]) -> dict[str, int]:
    """How often each word of the templates is in the corpus: at most one row for each reaches the driver."""
    words = docs.select(F.split(spaced(F.col("text")), " ").alias("words"))
    known = words.select(F.explode(F.filter("words", lambda w: w.isin(*sorted(vocab)))).alias("word"))
    return {r["word"]: r["n"] for r in known.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _phrase_starts(phrase: str) -> Column:
    """Column: where in `words` the phrase's words stand consecutively; words are looked at only where the phrase is."""
    parts = phrase.split(" ")

    def here(i):
        found = F.lit(True)
        for k, part in enumerate(parts):
            found = found & F.get(F.col("words"), i + k).eqNullSafe(F.lit(part))
        return found

    there = F.contains(F.concat(F.lit(" "), F.col("spaced"), F.lit(" ")), F.lit(f" {phrase} "))
    places = F.transform(F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (x["w"] == parts[0]) & here(x["i"])), lambda x: x["i"].cast("long"))
    return F.when(there, places).otherwise(F.array().cast("array<bigint>"))


def _blocks(plan: _Plan) -> Column:
    """Column: every block around a prefix word, as (step, ranks of its template words, ascending and distinct)."""
    steps = sorted({r["step"] for r in plan.rows})
    first = {s: sorted({plan.vocab[k - 1] for r in plan.rows if r["step"] == s for k in r["ranks"][: r["size"] - r["least"] + 1]}) for s in steps}
    union = sorted({w for ws in first.values() for w in ws})
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*union), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    vocab = F.array(*[F.lit(w) for w in plan.vocab])
    ranked = lambda ws: F.array_sort(F.array_distinct(F.filter(F.transform(ws, lambda w: F.array_position(vocab, w)), lambda r: r > 0)))

    def of_step(s: int) -> Column:
        own = F.filter(F.col("hits"), lambda x: x["w"].isin(*first[s]))
        at = F.transform(own, lambda x: F.floor(x["i"] / s).cast("int"))
        ids = F.filter(F.array_distinct(F.concat(at, F.transform(at, lambda b: b - 1))), lambda b: b >= 0)
        return F.transform(ids, lambda b: F.struct(F.lit(s).alias("step"), ranked(F.slice(F.col("words"), b * s + 1, F.lit(2 * s))).alias("own")))

    return hits, F.concat(*[of_step(s) for s in steps])


def _prefixes(docs: DataFrame, plan: _Plan) -> DataFrame:
    """step, rank, place, label, size, least, all: a row for each word of each template's prefix. Its size is
    that of the template list, a parameter, never of the corpus."""
    rows = [
        f"struct({r['step']} AS step, {k}L AS rank, {p} AS place, '{r['label']}' AS label, {r['size']} AS size, {r['least']} AS least, array({', '.join(f'{x}L' for x in r['ranks'])}) AS all)"
        for r in plan.rows
        for p, k in enumerate(r["ranks"][: r["size"] - r["least"] + 1])
    ]
    return docs.sparkSession.sql(f"SELECT inline(array({', '.join(rows)}))")


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs (doc_id, text).

    n_base: places of PHRASES; first_word and last_word: the smallest and largest word at which one begins, null if
    none does. labels: base_labels and those of templates that a block holds. score: 1 with a base label, else the
    largest share of a template's words in a block that holds it, else 0. Null, empty and wordless texts have no words
    and no labels. Repeated rows and ids, null ids too, keep a row each; other columns aren't read; an empty table
    gives an empty result. Very long texts are scanned whole: their blocks are rows of their own."""
    templates = TEMPLATES if templates is None else templates
    if any(not re.fullmatch(r"[\w.+-]+", t.label) for t in templates):
        raise ValueError("labels are letters, digits, dots, plus and minus signs")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plan = _planned(templates, word_counts(narrow, {w for t in templates for w in template_words(t.text)}))
    told = narrow.select(F.monotonically_increasing_id().alias("row"), "doc_id", spaced(F.col("text")).alias("spaced"))
    told = told.withColumn("words", F.when(F.col("spaced") == "", F.array().cast("array<string>")).otherwise(F.split("spaced", " ")))
    hits, blocks = _blocks(plan)
    told = told.select("row", "doc_id", "words", F.size("words").cast("long").alias("n_words"), *[_phrase_starts(p).alias(f"base{k}") for k, (p, _) in enumerate(PHRASES)], hits.alias("hits"))
    at = F.concat(*[F.col(f"base{k}") for k in range(len(PHRASES))])
    labels = F.array_sort(F.array_distinct(F.concat(*[F.when(F.size(f"base{k}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for k, (_, label) in enumerate(PHRASES)])))
    told = told.select("row", "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), labels.alias("base"), blocks.alias("blocks"))
    # documents without a block stay as one row
    kept = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    each = told.select(*kept, F.explode_outer("blocks").alias("b")).select(*kept, "b.step", "b.own")
    each = each.select(*kept, "step", "own", F.posexplode_outer("own").alias("j", "rank"))
    x = each.join(_prefixes(docs, plan), ["step", "rank"], "left")
    enough = (F.col("least") <= F.size("own")) & (F.least(F.col("size") - F.col("place"), F.size("own") - F.col("j")) >= F.col("least"))
    # the first common word speaks for the pair; then the count of all common words decides
    both = F.array_intersect("own", "all")
    holds = enough & (F.array_min(both) == F.col("rank")) & (F.size(both) >= F.col("least"))
    x = x.select(*kept, F.when(holds, F.col("label")).alias("label"), F.when(holds, F.size(both) / F.col("size")).alias("share"))
    one = x.groupBy("row").agg(*[F.first(c).alias(c) for c in kept[1:]], F.collect_set("label").alias("found"), F.max("share").alias("share"))
    return one.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The scan in DuckDB, by comparing every block of every text with every template of its step."""
    plan = _planned(TEMPLATES, {})
    quote = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    held = "\n      UNION ALL ".join(
        f"""SELECT rid, '{r["label"]}' AS label, max(len(list_intersect(b, {quote([plan.vocab[k - 1] for k in r["ranks"]])}))) AS n, {r["size"]} AS size, {r["least"]} AS least FROM blocks WHERE step = {r["step"]} GROUP BY rid"""
        for r in plan.rows
    )
    steps = sorted({r["step"] for r in plan.rows})
    blocks = "\n      UNION ALL ".join(f"SELECT rid, {s} AS step, list_slice(w, i + 1, i + {2 * s}) AS b FROM told, unnest(range(0, len(w), {s})) AS u(i)" for s in steps)
    starts = lambda p: f"list_filter(range(0, len(w)), lambda i: {' AND '.join(f'w[i + {k + 1}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(p.split(' ')))})"
    return f"""WITH told AS MATERIALIZED (
      SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM documents),
    based AS (SELECT rid, doc_id, len(w) AS n_words, {", ".join(f"{starts(p)} AS p{k}" for k, (p, _) in enumerate(PHRASES))} FROM told),
    blocks AS ({blocks}),
    held AS ({held}),
    found AS (SELECT rid, list(DISTINCT label) AS more, max(n / size) AS share FROM held WHERE n >= least GROUP BY rid),
    joined AS (
      SELECT b.*, list_concat({", ".join(f"p{k}" for k in range(len(PHRASES)))}) AS places, more, share,
             list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))}], lambda x: x IS NOT NULL) AS base
      FROM based b LEFT JOIN found USING (rid))
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
           array_to_string(list_sort(base), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
           CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
    FROM joined"""
