"""Passage analysis: sentences are tagged, parsed and scored by both language models, and a rule gives the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lm, pcfg, tagging


def numbered_sentences(passages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, sentence_idx, sentence_text, words): sentences count from 1, and those without a word are left out."""
    said = passages.select(key, F.posexplode(pcfg.split_sentences(F.col(text))).alias("at", "sentence_text"))
    return said.select(key, (F.col("at") + 1).cast("long").alias("sentence_idx"), "sentence_text", pcfg.plain_words(F.col("sentence_text")).alias("words")).where(F.size("words") > 0)


def attributed(sents: DataFrame, alerts: DataFrame, key: str) -> DataFrame:
    """(key, sentence_idx, merges_resolved, spelling_corrections): a passage's alerts whose replacement a sentence holds.

    alerts(key, badge, replacement array<string>); an alert counts if any part of it is in the sentence.
    """
    inside = lambda x: F.contains(F.lower("sentence_text"), F.lower(x))
    pairs = sents.select(key, "sentence_idx", "sentence_text").join(alerts.select(key, "badge", "replacement"), key, "left")
    hit = F.coalesce(F.exists("replacement", inside), F.lit(False))
    of = lambda badge: F.count(F.when(hit & (F.col("badge") == badge), 1))
    return pairs.groupBy(key, "sentence_idx").agg(of("SEGMENT").alias("merges_resolved"), of("SPELL").alias("spelling_corrections"))


def analysed(passages: DataFrame, key: str, tagged: DataFrame | tagging.Counts, grammar: DataFrame, train: DataFrame | lm.Tables, alerts: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(key, sentence_idx, sentence_text, pcfg_status, pcfg_logp, pcfg_tree, bigram_logp, trigram_logp, chosen_method,
    final_verdict, merges_resolved, spelling_corrections) for every sentence with a word of passages(key, text)."""
    sents = numbered_sentences(passages, key, text)
    by = [key, "sentence_idx"]
    tags = tagging.viterbi(sents.withColumnRenamed("words", "w"), tagged)
    parses = pcfg.parsed(tags.select(*by, F.col("w").alias("words"), F.transform("tags", tagging.reconcile).alias("tags")), grammar)
    lower = sents.select(*by, F.transform("words", lambda x: F.lower(x)).alias("w"))
    model = lm.tables(train)
    bigram = lm.sentence_scores(lower, by, model).select(*by, F.col("logp").alias("bigram_logp"))
    trigram = lm.trigram_sentence_scores(lower, by, model).select(*by, F.col("logp").alias("trigram_logp"))
    none = alerts if alerts is not None else passages.select(key, F.lit("").alias("badge"), F.array().cast("array<string>").alias("replacement")).limit(0)
    out = sents.join(parses.select(*by, "parse"), by).join(bigram, by).join(trigram, by).join(attributed(sents, none, key), by)
    score: Column = F.col("parse.logp")
    method, said = pcfg.verdict(F.col("parse.status"), F.size("words"), score, F.col("trigram_logp"), F.col("bigram_logp"))
    return out.select(
        *by, "sentence_text", F.col("parse.status").alias("pcfg_status"), score.alias("pcfg_logp"), F.col("parse.tree").alias("pcfg_tree"), "bigram_logp", "trigram_logp",
        method.alias("chosen_method"), said.alias("final_verdict"), "merges_resolved", "spelling_corrections",
    )
