"""License scans by diagonal voting, in DataFrame operations only.

All rolling word pairs of a text meet the word pairs of the templates in an equi-join; a hit at word p of the text and
word t of a template votes for the diagonal p - t.  Votes are summed by diagonal, diagonals at most JITTER apart are
merged (a word put in or left out shifts the rest by one).  A merged span is verified by aligning its words with the
template: its score is the part of the template's pairs that it has, words put in counting like missing pairs, and it
counts from COVER on.  Where spans of several templates overlap, the best one stays (the higher score, then the longer
template), and so do those that do not touch it: a notice of a license with more conditions is no notice of the license
without them.  The short base phrases are templates too, need every pair on one diagonal and stay in any case.  Hash hits
are checked against the words themselves.

Word pairs of function words alone carry no evidence and are no template positions.  Every template has words that too
few of its pairs do without; a text with none of these cannot have a hit and is not exploded - that loses nothing.  The templates are fixed, so their table is
broadcast.  Votes are partitioned by text and template, so neither a frequent license line nor a long text gathers in
one task.

Defined results: null text counts as empty; repeated rows each get the same result; a null doc_id is kept; further
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

COVER, JITTER = 0.7, 2
#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Wording of common license notices and the labels of the method.
NOTICES = {
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "licensed under the apache license version 2 0": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-text",
    "licensed under the gnu general public license version 3": "gpl-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-text",
    "this source code form is subject to the terms of the mozilla public license": "mpl-notice",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "creative commons attribution license": "cc-by",
    "all rights reserved": "reserved",
}
#: Words that carry no evidence.
FUNCTION_WORDS = set("a all and any are at by for free in is it may may not of on or or out out the that these this to under use with work you your from as be can".split())
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _templates() -> list[tuple]:
    """(first word, second word, template, place, pairs that count, words, label, base)."""
    rows = []
    for k, (wording, label, base) in enumerate([*((w, x, True) for w, x in BASE.items()), *((w, x, False) for w, x in NOTICES.items())]):
        words = wording.split()
        pairs = [(a, b, i) for i, (a, b) in enumerate(zip(words, words[1:])) if not {a, b} <= FUNCTION_WORDS]
        rows += [(a, b, k, i, len(pairs), len(words), label, base) for a, b, i in pairs]
    return rows


def _telling() -> list[str]:
    """Words of which every text with a hit has one.

    For each template its long words, then shorter ones, until the pairs without any of them are too few for a hit.
    """
    out: set[str] = set()
    for k in {r[2] for r in _templates()}:
        rows = [r for r in _templates() if r[2] == k]
        share = 1.0 if rows[0][7] else COVER
        for w in sorted({w for r in rows for w in r[:2]} - FUNCTION_WORDS, key=lambda w: (-len(w), w)):
            if len(w) < 5 and sum(not {r[0], r[1]} & out for r in rows) < share * len(rows):
                break
            out.add(w)
    return sorted(out)


def words(text):
    """The words of a text column, A-Z as a-z and no other letter changed."""
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), SPLIT), "")


def license_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as (doc_id, _text, n_words, _words), and the spans found.

    The spans are (doc_id, _text, template, label, base, first_word, last_word, score), the words being numbered from 0
    and last_word the last one of the span; _text is the hash of the text.
    """
    spark = docs.sparkSession
    template = spark.createDataFrame(_templates(), "w1 string, w2 string, template int, place int, pairs int, wide int, label string, base boolean")
    template = F.broadcast(template.withColumn("gram", F.xxhash64("w1", "w2")))  # fixed size
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"), words(F.coalesce("text", F.lit(""))).alias("_words"))
    telling_words = F.array(*[F.lit(w) for w in _telling()])
    rows = cut(rows.select("doc_id", "_text", F.size("_words").cast("long").alias("n_words"), F.when(F.arrays_overlap("_words", telling_words), F.col("_words")).alias("_words")))
    grams = F.expr("transform(sequence(1, size(_words) - 1), i -> struct(i - 1 AS p, _words[i - 1] AS a, _words[i] AS b, xxhash64(_words[i - 1], _words[i]) AS gram))")
    rolled = rows.where("size(_words) > 1").select("doc_id", "_text", F.inline(grams))
    hits = rolled.join(template, "gram").where("a = w1 AND b = w2")
    hits = hits.select("doc_id", "_text", "template", "label", "base", "pairs", "wide", "p", "place").distinct()
    by = ["doc_id", "_text", "template", "label", "base", "pairs", "wide"]
    voted = hits.withColumn("diagonal", F.col("p") - F.col("place")).groupBy(*by, "diagonal").agg(
        F.count("*").alias("votes"), F.min("p").alias("first"), (F.max("p") + 1).alias("last"), F.collect_set("place").alias("places")
    )
    line = Window.partitionBy(*by).orderBy("diagonal")
    gap = F.when(F.col("base") | (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(line), F.lit(-10)) > JITTER), 1).otherwise(0)
    merged = voted.withColumn("_new", gap).withColumn("_group", F.sum("_new").over(line))
    spans = merged.groupBy(*by, "_group").agg(
        F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes")
    )
    put_in = F.greatest(F.col("last_word") - F.col("first_word") + 1 - F.col("wide"), F.lit(0))
    spans = spans.withColumn("score", F.when(F.col("base"), F.col("votes") / F.col("pairs")).otherwise(F.col("votes") / (F.col("pairs") + put_in)))
    spans = spans.where(F.col("score") >= F.when(F.col("base"), 1.0).otherwise(COVER))
    # Runs of overlapping spans, the best of each run, and what does not touch it.
    text = Window.partitionBy("doc_id", "_text", "base")
    reach = F.max("last_word").over(text.orderBy("first_word", "last_word", "template").rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("base") | (F.col("first_word") > F.coalesce(reach, F.lit(-1))), 1).otherwise(0)
    spans = spans.withColumn("_new", new).withColumn("_run", F.sum("_new").over(text.orderBy("first_word", "last_word", "template")))
    best = F.max(F.struct("score", "wide", F.col("first_word").alias("f"), F.col("last_word").alias("l"), "template")).over(Window.partitionBy("doc_id", "_text", "base", "_run"))
    spans = spans.withColumn("_best", best)
    touching = (F.col("first_word") <= F.col("_best.l")) & (F.col("last_word") >= F.col("_best.f")) & (F.col("template") != F.col("_best.template"))
    spans = spans.where(F.col("base") | ~touching)
    return rows, spans.select("doc_id", "_text", "template", "label", "base", "first_word", "last_word", "score")


def license_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for all rows of ``docs(doc_id, text)``.

    n_base counts the places of the base phrases, first_word and last_word are the smallest and largest of their
    starts; score is the largest part of a template that was found.
    """
    rows, spans = license_spans(docs)
    base = F.col("base")
    found = spans.groupBy("doc_id", "_text").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    found = found.withColumnsRenamed({"doc_id": "_id", "_text": "_hash"})
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    return rows.join(found, on, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
