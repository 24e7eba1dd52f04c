"""License scan by diagonal voting (DataFrame operations only).

All rolling word 4-grams of a document are hashed and joined to the places where the same hash stands in
a license template. A hit votes for its diagonal, document place minus template place. Votes are summed
per document, template and diagonal. A document's diagonals of one template are put in order, and where one
follows another by ``GAP`` or less (words inserted or left out) they are one group. The span that a group
covers is verified: the template's words are looked for one after another, each behind the last one found
and on a diagonal of the group. A template is found when enough of its words stand like this.

The join has two steps: within the row the hashes meet the set of all template hashes (a semi-join whose
smaller side is a literal), and only those that are in it are exploded and joined to the template places. So
the rows that are shuffled are hits, and those of one document are combined before the shuffle. Work and
memory grow with the number of hits and the words: diagonals are grouped in a window over sorted narrow rows,
and the spans of a document are verified beside its words, which are not copied.

Templates with fewer words than a hash takes are hashed whole; ones without words are never found. Up to
``MOST_HASHES`` hashes of templates are a literal and a broadcast; beyond, all hashes are joined by shuffle.

Defined results: a null text is empty, has no words, a score of 0, empty label strings and null places.
Very long texts are scanned whole, with their words in one row's memory. Repeated rows are judged each on
its own (rows carry an id of their own). Spans that begin and end alike are ordered by label, then cover.
A null ``doc_id`` is passed on. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import ascii_lower, let, table, text_of, written

#: What a word is, and the base phrases with their labels.
WORD_10 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label and text of the templates, public license notices.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
#: Words of a rolling hash.
K = 4
#: Diagonals at most so far apart are merged.
GAP = 3
#: Hashes of templates that are held as a literal and broadcast.
MOST_HASHES = 100_000
#: Share of a template's words that must stand in place.
LEAST_COVER = 0.7


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD_10), F.lit(0))


def grams(words: Column, k: int = K) -> Column:
    """Hashes of all k-grams, in order; none if there are fewer words."""
    rolling = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    return F.when(F.size(words) >= k, rolling).otherwise(F.array().cast("array<bigint>"))


def template_places(spark: SparkSession, templates: list[tuple[str, str]], k: int = K) -> DataFrame:
    """One row per template and place: _template, _label, _length, _gram, _words, _at, _hash. As large as the templates are."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "_template int, _label string, text string")
    rows = rows.withColumn("_words", words_of(text_of())).drop("text").withColumn("_length", F.size("_words")).withColumn("_gram", F.least(F.lit(k), F.col("_length")))
    own = F.coalesce(*(F.when(F.col("_gram") == n, grams(F.col("_words"), n)) for n in range(1, k + 1)))
    return rows.select("_template", "_label", "_length", "_gram", "_words", F.posexplode(own).alias("_at", "_hash"))


def _phrase_places(words: Column, phrase: str) -> Column:
    first, *rest = phrase.split()
    here = lambda i: (F.get(words, i) == first) & F.coalesce(_all([F.get(words, i + j + 1) == w for j, w in enumerate(rest)]), F.lit(False))
    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    return F.when(F.array_contains(words, rest[-1]), found).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _scanned(docs: DataFrame, hashes: list[int] | None, lengths: list[int]) -> DataFrame:
    """One row per document: base findings, and the hits with the words of documents that have any."""
    places = lambda w: F.array(*(F.struct(F.lit(label).alias("label"), _phrase_places(w, p).alias("at")) for p, label in PHRASES.items()))
    known = lambda all_of: all_of if hashes is None else F.filter(all_of, lambda x: x["hash"].isin(hashes))
    hits = lambda w: F.concat(*(known(F.transform(grams(w, n), lambda h, i: F.struct(i.alias("at"), h.alias("hash")))) for n in lengths)) if lengths else F.array().cast("array<struct<at:int,hash:bigint>>")
    found = let(words_of(text_of()), lambda w: let(hits(w), lambda h: F.struct(F.size(w).cast("long").alias("n_words"), places(w).alias("base"), h.alias("hits"), F.when(F.size(h) > 0, w).alias("words"))))
    return docs.select("doc_id", found.alias("f")).select(F.monotonically_increasing_id().alias("_row"), "doc_id", "f.*")


def diagonals(scanned: DataFrame, templates: DataFrame, gap: int = GAP) -> DataFrame:
    """Votes by document, template and diagonal, neighbouring diagonals merged: one row per merged group."""
    hits = scanned.filter(F.size("hits") > 0).select("_row", F.explode("hits").alias("h")).select("_row", F.col("h.at").alias("_place"), F.col("h.hash").alias("_hash"))
    votes = hits.join(templates, "_hash")
    votes = votes.groupBy("_row", "_template", "_label", "_gram", (F.col("_place") - F.col("_at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("_place").alias("first"), F.max("_place").alias("last"))
    in_order = Window.partitionBy("_row", "_template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > gap, F.lit(True))
    votes = votes.withColumn("_new", new.cast("long")).withColumn("_group", F.sum("_new").over(in_order))
    return votes.groupBy("_row", "_template", "_label", "_gram", "_group").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))


def _in_place(template: Column, words: Column, span: Column) -> Column:
    """How many words of the template stand in order: each is looked for behind the last one found, on the diagonals of the span."""
    state = lambda i, at, n: F.struct(i.alias("i"), at.cast("int").alias("at"), n.alias("n"))

    def step(a: Column, x: Column) -> Column:
        low = F.greatest(a["at"], a["i"] + span["low"], span["first"])
        high = F.least(a["i"] + span["high"], span["end"] - 1)
        # array_position finds the first one
        found = F.when(low <= high, F.array_position(F.slice(words, low + 1, F.greatest(high - low + 1, F.lit(0))), x)).otherwise(F.lit(0))
        hit = found > 0
        return state(a["i"] + 1, F.when(hit, low + found.cast("int")).otherwise(a["at"]), a["n"] + hit.cast("int"))

    return F.aggregate(template, state(F.lit(0), F.lit(0), F.lit(0)), step)["n"]


def verified(merged: DataFrame, scanned: DataFrame, templates: DataFrame) -> DataFrame:
    """_row and ``spans``: of each document with hits all spans, with the share of the template's words that stand in place."""
    texts = templates.filter("_at = 0").select("_template", "_words", "_length")
    span = F.struct("_template", "_label", "votes", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"), F.col("first").cast("int").alias("first"), (F.col("last") + F.col("_gram")).cast("int").alias("end"))
    # a template's spans in one document at a time, with the template's words once
    listed = merged.select("_row", "_template", span.alias("s")).groupBy("_row", "_template").agg(F.collect_list("s").alias("listed"))  # as many as the document has groups
    listed = listed.join(texts, "_template").groupBy("_row").agg(F.collect_list(F.struct("listed", "_words", "_length")).alias("by_template"))
    both = listed.join(scanned.filter(F.size("hits") > 0).select("_row", "words"), "_row")
    cover = lambda t, s: _in_place(t["_words"], F.col("words"), s) / t["_length"]
    of_template = lambda t: F.transform(t["listed"], lambda s: F.struct(s["first"].alias("start"), s["end"].alias("end"), s["_label"].alias("_label"), cover(t, s).alias("cover"), s["votes"].alias("votes")))
    return both.select("_row", F.flatten(F.transform("by_template", of_template)).alias("spans"))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, k: int = K, gap: int = GAP, least_cover: float = LEAST_COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    spark = docs.sparkSession
    places = written(template_places(spark, TEMPLATES if templates is None else templates, k), "license-templates")
    lengths = sorted(r[0] for r in places.select("_gram").distinct().collect())  # k at most
    few = places.limit(MOST_HASHES + 1).count() <= MOST_HASHES
    hashes = [r[0] for r in places.select("_hash").distinct().collect()] if few else None  # MOST_HASHES at most
    scanned = written(_scanned(docs, hashes, lengths), "license-scan")
    narrow = places.drop("_words", "_length")
    spans = verified(diagonals(scanned, F.broadcast(narrow) if few else narrow, gap), scanned, places)
    found = lambda c: F.filter(c, lambda x: x["cover"] >= least_cover)
    spans = spans.select("_row", F.array_max(F.transform("spans", lambda x: x["cover"])).alias("_score"), F.transform(found("spans"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["_label"].alias("_label"), x["cover"].alias("cover"))).alias("spans"))
    best = spans.select("_row", "_score", F.array_sort(F.array_distinct(F.transform("spans", lambda x: x["_label"]))).alias("_own"), F.array_sort("spans").alias("spans"))
    out = scanned.select("_row", "doc_id", "n_words", "base").join(best, "_row", "left")
    at = F.flatten(F.transform("base", lambda x: x["at"]))
    base = F.array_sort(F.transform(F.filter("base", lambda x: F.size(x["at"]) > 0), lambda x: x["label"]))
    own = F.coalesce("_own", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.coalesce("_score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,_label:string,cover:double>>")).alias("spans"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
