"""License scans by diagonal voting.

All rolling word 3-grams of every text are hashed and joined with the 3-grams of license templates. A match votes for the
diagonal (position in the text minus position in the template) of its template. Neighbouring diagonals, which inserted or missing
words set apart, are merged into spans that drift by no more in all than ``DRIFT`` and what the template may lack, so a span is at most
that much longer than its template. The join compares the words themselves beside the hash, and a span is verified in order: of its
votes those count that rise in the text and in the template, and they must cover enough of the template's words.

Base phrases are found in the word array itself: every place where their words stand consecutively.

Null texts count as empty (no words, no labels, score 0). Votes are made distinct by row content, so repeated rows agree. The
built-in templates are broadcast, a fixed list of a few hundred 3-grams; a table of templates (label, text), such as whole license
texts, is joined as Spark sees fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The word pattern, the base phrases with their labels, and license texts with theirs.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)
GRAM = 3
#: Words that a copy may have more than its template may lack; the share of the template's words that its votes must cover.
DRIFT, COVER = 2, 0.8


def words_of(text: Column) -> Column:
    """Word array of a text after lower-casing A-Z."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _grams(words: Column) -> Column:
    """Rolling 3-grams as structs w0, w1, w2; the last ones have nulls."""
    return F.arrays_zip(words.alias("w0"), F.slice(words, 2, F.size(words)).alias("w1"), F.slice(words, 3, F.size(words)).alias("w2"))


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...] | DataFrame = TEMPLATES) -> DataFrame:
    """(template, label, n_words, place, t0, t1, t2, hash) of every 3-gram of the templates."""
    if isinstance(templates, DataFrame):
        rows = templates.select("label", "text").distinct().withColumn("template", F.xxhash64("label", "text"))
    else:
        rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template long, label string, text string")
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words"))
    each = rows.select("template", "label", "n_words", F.posexplode(_grams(F.col("words"))).alias("place", "g")).where("g.w2 IS NOT NULL")
    return each.select("template", "label", "n_words", "place", F.col("g.w0").alias("t0"), F.col("g.w1").alias("t1"), F.col("g.w2").alias("t2"), F.xxhash64("g.w0", "g.w1", "g.w2").alias("hash"))


def _any_order(places: Column) -> Column:
    """How many words of the template the votes at ``places`` cover, whatever their order."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(*[p + i for i in range(GRAM)])))))


def in_order(votes: Column, n_words: Column) -> Column:
    """Most template words that votes (at, back: minus the place) cover that rise in both; sorted, so that of votes at one place of
    the text one counts. The state holds, for each place, the best cover of a chain that ends there."""

    def step(best: Column, vote: Column) -> Column:
        place = -vote["back"]
        before = F.coalesce(F.array_max(F.slice(best, 1, F.greatest(place - (GRAM - 1), F.lit(0)))), F.lit(0)) + GRAM
        # A chain whose last vote overlaps this one gains only the words beyond it.
        near = [F.when(F.coalesce(F.get(best, place - back), F.lit(0)) > 0, F.get(best, place - back) + back) for back in range(1, GRAM)]
        reached = F.greatest(before, *near)
        return F.transform(best, lambda b, at: F.when(at == place, F.greatest(b, reached)).otherwise(b))

    return F.aggregate(votes, F.array_repeat(F.lit(0), n_words), step, lambda best: F.array_max(best))


def spans(texts: DataFrame, templates: tuple[tuple[str, str], ...] | DataFrame = TEMPLATES) -> DataFrame:
    """Accepted spans of ``texts`` (doc_id, key, words): doc_id, key, template, label, first, last (word positions), cover."""
    grams = texts.select("doc_id", "key", F.posexplode(_grams(F.col("words"))).alias("at", "g"))
    grams = grams.select("doc_id", "key", "at", "g.*", F.xxhash64("g.w0", "g.w1", "g.w2").alias("h"))
    there = template_grams(texts.sparkSession, templates)
    if not isinstance(templates, DataFrame):
        there = F.broadcast(there)
    same = (F.col("h") == F.col("hash")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    votes = grams.join(there, same).select("doc_id", "key", "template", "label", "n_words", "at", "place")
    doc = ["doc_id", "key", "template", "label", "n_words"]
    lines = votes.groupBy(*doc, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    enough = lambda covered: covered >= F.col("n_words") * F.lit(COVER)
    # Most documents share a phrase with a template and no more: all their votes together cover too little.
    everywhere = F.collect_list("places").over(W.partitionBy(*doc))
    lines = lines.withColumn("everywhere", _any_order(F.flatten(everywhere))).where(enough(F.col("everywhere"))).drop("everywhere")
    # A span begins at one of its diagonals and drifts no further than this.
    drift = (DRIFT + F.floor(F.col("n_words") * F.lit(1 - COVER))).cast("int")
    line = F.transform("places", lambda p: F.struct((p + F.col("diagonal")).alias("at"), (-p).alias("back")))
    anchored = lines.withColumn("anchor", F.explode(F.sequence(F.col("diagonal") - drift, F.col("diagonal"))))
    merged = anchored.groupBy(*doc, "anchor").agg(F.sort_array(F.flatten(F.collect_list(line))).alias("votes"), F.max(F.col("diagonal") == F.col("anchor")).alias("own"))
    merged = merged.where(F.col("own") & enough(_any_order(F.transform("votes", lambda v: -v["back"]))))
    found = merged.withColumn("covered", in_order(F.col("votes"), F.col("n_words"))).where(enough(F.col("covered")))
    found = found.select(*doc, "anchor", F.col("votes")[0]["at"].alias("first"), (F.element_at("votes", -1)["at"] + (GRAM - 1)).alias("last"), (F.col("covered") / F.col("n_words")).alias("cover"))
    # Neighbouring beginnings are one copy: the best of them is its span.
    order = W.partitionBy(*doc).orderBy("anchor")
    apart = F.coalesce(F.col("anchor") - F.lag("anchor").over(order) > drift, F.lit(True))
    copies = found.withColumn("copy", F.sum(apart.cast("int")).over(order))
    best = copies.groupBy(*doc, "copy").agg(F.max_by(F.struct("first", "last", "cover"), F.struct("cover", -F.col("anchor"))).alias("s"))
    return best.select("doc_id", "key", "template", "label", "s.*")


def base_places(words: Column, phrase: str) -> Column:
    """Positions (from 0) where the words of ``phrase`` stand consecutively."""
    parts = phrase.split()
    all_there = F.lit(True)
    for p in parts:
        all_there = all_there & F.array_contains(words, p)

    def here(i: Column) -> Column:
        found = F.lit(True)
        for k, p in enumerate(parts):
            found = found & (F.get(words, i + k) == p)
        return found

    return F.when(all_there, F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: tuple[tuple[str, str], ...] | DataFrame = TEMPLATES) -> DataFrame:
    """One row for each document: doc_id, n_words, places (base places of each phrase), spans (accepted template spans, with
    label, first and last word and cover), base_labels and labels (sorted arrays), score.

    The score is 1 where a base phrase stands, else the best cover of an accepted span, else 0.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), words_of(F.col(text)).alias("words"))
    found = spans(texts, templates).groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("first", "last", "label", "cover"))).alias("spans"))
    found = found.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "spans")
    places = F.array(*[F.struct(F.lit(label).alias("label"), base_places(F.col("words"), phrase).alias("at")) for phrase, label in BASE])
    rows = texts.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), places.alias("places"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    none = F.array().cast("array<struct<first:int,last:int,label:string,cover:double>>")
    rows = rows.withColumn("spans", F.coalesce("spans", none))
    base = F.transform(F.filter("places", lambda p: F.size(p.at) > 0), lambda p: p.label)
    rows = rows.withColumn("base_labels", F.array_sort(F.array_distinct(base)))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("spans", lambda s: s.label))))
    best = F.array_max(F.transform("spans", lambda s: s.cover))
    score = F.when(F.size("base_labels") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0)))
    return rows.select("doc_id", "n_words", "places", "spans", "base_labels", labels.alias("labels"), score.alias("score"))
