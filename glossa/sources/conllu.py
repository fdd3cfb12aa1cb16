"""CoNLL-U treebanks as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_treebank(spark: SparkSession, path: str, columns: int = 8, exact: bool = False, root: bool = False, max_sentences: int | None = None) -> DataFrame:
    """(file, sent, sent_id, text, tokens array<struct<id, form, lemma, upos, xpos, feats, head, deprel>>).

    A blank line ends a sentence, so a large file is read by many tasks; ``sent`` is its place in the order of the file.
    Lines with fewer than ``columns`` columns (``exact``: another number), and ids with - or . are skipped; a head that is
    no number is 0; sentences without tokens are dropped.  ``root`` puts a token <ROOT> with id 0 first;
    ``max_sentences`` keeps the first of all files in order.  A path without files raises an error.
    """
    blocks = spark.read.text(path, lineSep="\n\n").select("_metadata.file_path", F.regexp_replace("value", "\r\n?", "\n").alias("v"), F.monotonically_increasing_id().alias("at"))
    parts = blocks.select(F.col("file_path").alias("file"), "at", F.posexplode(F.split("v", r"\n[ \t]*(?:\n[ \t]*)+")).alias("part", "block"))
    lines = F.split("block", "\n")
    meta = lambda key: F.nullif(F.regexp_extract("block", rf"(?m)^#\s*{key}\s*=\s*(.*)$", 1), F.lit(""))
    wide = lambda c: F.size(c) == columns if exact else F.size(c) >= columns
    cells = F.filter(F.transform(lines, lambda x: F.split(x, "\t")), lambda c: wide(c) & ~F.get(c, F.lit(0)).rlike(r"[-.]|^#"))
    tokens = F.transform(cells, _token)
    if root:
        tokens = F.when(F.size(tokens) > 0, F.concat(F.array(_root()), tokens)).otherwise(tokens)
    out = parts.select("file", F.struct("at", "part").alias("sent"), meta("sent_id").alias("sent_id"), meta("text").alias("text"), tokens.alias("tokens")).where(F.size("tokens") > 0)
    return out if max_sentences is None else out.orderBy("file", "sent").limit(max_sentences)


def _token(c: Column) -> Column:
    at = lambda k: F.get(c, F.lit(k))
    return F.struct(
        at(0).try_cast("int").alias("id"), at(1).alias("form"), at(2).alias("lemma"), at(3).alias("upos"), at(4).alias("xpos"), at(5).alias("feats"),
        F.coalesce(at(6).try_cast("int"), F.lit(0)).alias("head"), at(7).alias("deprel"),
    )


def _root() -> Column:
    mark = F.lit("<ROOT>")
    return F.struct(
        F.lit(0).alias("id"), mark.alias("form"), mark.alias("lemma"), mark.alias("upos"), mark.alias("xpos"), F.lit("_").alias("feats"), F.lit(-1).alias("head"), F.lit("").alias("deprel"),
    )


def tagged_sentences(treebank: DataFrame, morphology: bool = False, plain: bool = False, fewest: int = 1) -> DataFrame:
    """(file, sent, tokens array<struct<form, tag>>); ``morphology`` adds gender and number to the tag.

    ``plain`` keeps words of letters only, in lower case; sentences of fewer than ``fewest`` tokens are dropped.
    """
    from ..operators.tagging import feats_tag

    tag = lambda t: feats_tag(t["upos"], t["feats"]) if morphology else t["upos"]
    kept = F.filter("tokens", lambda t: t["form"].rlike(r"^\p{L}+$")) if plain else F.col("tokens")
    form = lambda t: F.lower(t["form"]) if plain else t["form"]
    pairs = F.transform(kept, lambda t: F.struct(form(t).alias("form"), tag(t).alias("tag")))
    return treebank.select("file", "sent", pairs.alias("tokens")).where(F.size("tokens") >= fewest)
