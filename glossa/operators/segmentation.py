"""Words of text without spaces, and simulated typing that loses spaces."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import draw
from . import lm
from .corpus import collected

LONGEST, MISSING, PER_LETTER = 25, 3.0, 1.2


def greedy(text: str, vocab: set[str], longest: int, exact: bool = False) -> list[str]:
    """The longest vocabulary word at each place, else one character; ``exact`` looks words up in their own case."""
    fold = str if exact else str.lower
    out, i = [], 0
    while i < len(text):
        n = next((n for n in range(min(longest, len(text) - i), 1, -1) if fold(text[i : i + n]) in vocab), 1)
        out.append(text[i : i + n])
        i += n
    return out


class Model:
    """Interpolated trigram model for the decoder; holds the n-grams of the training sentences it is given.

    With ``texts`` it holds only those n-grams that some segmentation of the texts can ask for, found by joins; the
    totals are still those of all sentences, so these texts get the same segmentations.
    """

    def __init__(self, sents: DataFrame, texts: DataFrame | None = None):
        if texts is not None:
            self._joined(sents, texts)
            return
        self.tri = {(r[0], r[1], r[2]): r[3] for r in collected(lm.counts(sents, 3, 2))}
        self.bi = {(r[0], r[1]): r[2] for r in collected(lm.counts(sents, 2, 1))}
        self.context: dict[str, int] = {}
        for (a, _), c in self.bi.items():
            self.context[a] = self.context.get(a, 0) + c
        uni = {r[0]: r[1] for r in collected(sents.select(F.explode(F.concat("w", F.array(F.lit(lm.CLOSE)))).alias("w")).groupBy("w").count())}
        self.uni, self.total = uni, sum(uni.values())
        self.vocab = set(uni) - {lm.CLOSE}
        self.types = len(self.vocab)
        self.longest = min(LONGEST, max(map(len, self.vocab), default=1))

    def _joined(self, sents: DataFrame, texts: DataFrame) -> None:
        words = sents.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("c")).persist()
        total, types, longest = words.agg(F.sum("c"), F.count("*"), F.max(F.length("w"))).first()
        self.total, self.types, self.longest = (total or 0) + sents.count(), types, min(LONGEST, longest or 1)
        pieces = _pieces(texts, words, self.longest).persist()
        asked = pieces.select("w").distinct().persist()
        self.uni = {r[0]: r[1] for r in collected(words.join(asked, "w"))}
        self.vocab = set(self.uni)
        self.uni[lm.CLOSE] = self.total - (total or 0)
        # Every word and every opening mark begins one bigram.
        self.context = {w: c for w, c in self.uni.items() if w != lm.CLOSE} | {lm.OPEN: self.uni[lm.CLOSE]}
        after = pieces.select("id", F.col("s").alias("e"), F.col("e").alias("end"), F.col("w").alias("w2"))
        pairs = pieces.withColumnRenamed("w", "w1").join(after, ["id", "e"])
        of = lambda w: F.broadcast(asked.withColumnRenamed("w", w))
        bi = sents.select(F.inline(lm.grams(2, 1))).join(of("w1"), "w1", "left_semi").join(of("w2"), "w2", "left_semi").groupBy("w1", "w2").agg(F.count("*").alias("c"))
        held = bi.join(pairs.select("w1", "w2").distinct(), ["w1", "w2"]).persist()
        self.bi = {(r[0], r[1]): r[2] for r in collected(held.select("w1", "w2", "c"))}
        # A trigram in the sentences has both its bigrams there, but for the double boundary.
        opened = sents.sparkSession.createDataFrame([(lm.OPEN, lm.OPEN)], "w1 string, w2 string")
        pairs = pairs.join(held.select("w1", "w2").unionByName(opened), ["w1", "w2"])
        more = pairs.select("id", F.col("s").alias("e"), F.col("e").alias("end"), F.col("w1").alias("w2"), F.col("w2").alias("w3"))
        triples = pairs.join(more, ["id", "e", "end", "w2"]).select("w1", "w2", "w3").distinct()
        tri = sents.select(F.inline(lm.grams(3, 2))).join(F.broadcast(triples), ["w1", "w2", "w3"], "left_semi")
        self.tri = {(r[0], r[1], r[2]): r[3] for r in collected(tri.groupBy("w1", "w2", "w3").agg(F.count("*").alias("c")))}
        for df in (words, pieces, asked, held):
            df.unpersist()

    def logp(self, a: str, b: str, c: str) -> float:
        a, b, c = a.lower(), b.lower(), c.lower()
        part = lambda n, d: n / d if d else 0.0
        w = lm.LAMBDAS
        p = w[0] * part(self.tri.get((a, b, c), 0), self.bi.get((a, b), 0)) + w[1] * part(self.bi.get((b, c), 0), self.context.get(b, 0))
        p += w[2] * part(self.uni.get(c, 0), self.total) + w[3] / max(1, self.types)
        unknown = 0.0 if c in self.vocab or c == lm.CLOSE else MISSING + PER_LETTER * len(c)
        return (math.log(p) if p > 0 else -50.0) - unknown

    def segment(self, text: str, beam: int | None = 40, covered: bool = False) -> list[str]:
        """The best segmentation; ``beam`` None keeps all states, and ``covered`` takes vocabulary words only, or nothing."""
        text = "".join(text.split())
        chart: list[dict] = [{} for _ in range(len(text) + 1)]
        chart[0][lm.OPEN, lm.OPEN] = (0.0, ())
        for i in range(len(text)):
            for (a, b), (s, path) in sorted(chart[i].items(), key=lambda x: -x[1][0])[:beam]:
                for n in range(1, min(self.longest, len(text) - i) + 1):
                    word = text[i : i + n]
                    if n == 1 and not covered or word.lower() in self.vocab:
                        v, cell = s + self.logp(a, b, word), chart[i + n]
                        if (b, word) not in cell or v > cell[b, word][0]:
                            cell[b, word] = (v, (*path, word))
        ends = [(s + self.logp(a, b, lm.CLOSE), path) for (a, b), (s, path) in chart[-1].items()]
        return list(max(ends, key=lambda x: x[0])[1]) if text and ends else []


def _pieces(texts: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """(id, s, e, w): the places of known words and single characters in ``texts(text)``, and of the boundaries."""
    bare = texts.select(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)[\s\x1c-\x1f]+", "").alias("text")).distinct()
    bare = bare.select(F.xxhash64("text").alias("id"), "text", F.length("text").alias("n")).where("n > 0")
    starts = bare.select("id", "text", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("s"))
    ends = starts.select("id", "text", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + longest, F.col("n") + 1))).alias("e"))
    some = ends.select("id", "s", "e", F.lower(F.substring("text", F.col("s"), F.col("e") - F.col("s"))).alias("w"))
    known = some.join(words.select("w", F.lit(True).alias("known")), "w", "left").where("known OR e = s + 1").select("id", "s", "e", "w")
    mark = lambda s, w: bare.select("id", s.alias("s"), (s + 1).alias("e"), F.lit(w).alias("w"))
    return known.unionByName(mark(F.lit(-1), lm.OPEN)).unionByName(mark(F.lit(0), lm.OPEN)).unionByName(mark(F.col("n") + 1, lm.CLOSE))


def segmented(rows: DataFrame, text: str, sents: DataFrame, beam: int = 40) -> DataFrame:
    """Adds ``words``: the best segmentation under the trigram model."""
    sent = rows.sparkSession.sparkContext.broadcast(Model(sents, rows.select(F.col(text).alias("text"))))

    @F.pandas_udf("array<string>")
    def decode(x: pd.Series) -> pd.Series:
        return x.map(lambda t: sent.value.segment(t or "", beam))

    return rows.withColumn("words", decode(text))


def greedy_segmented(rows: DataFrame, text: str, vocab: DataFrame) -> DataFrame:
    """Adds ``words``: the longest vocabulary word at each place, else one character."""
    words = {r[0] for r in collected(vocab.select(F.lower("w")).distinct())}
    sent = rows.sparkSession.sparkContext.broadcast((words, max(map(len, words), default=1)))

    @F.pandas_udf("array<string>")
    def decode(x: pd.Series) -> pd.Series:
        return x.map(lambda t: greedy(t or "", *sent.value))

    return rows.withColumn("words", decode(text))


def typing_merges(sents: DataFrame, key: list[str], p: float = 0.08, seed: int = 42) -> DataFrame:
    """(key, pos, token): a word whose draw is below p takes in the next one, left to right.

    In each run of words drawn below p the odd ones merge; the last word of a sentence never does.
    """
    places = F.transform("w", lambda x, i: F.struct((i + 1).cast("long").alias("pos"), x.alias("word"), F.get("w", i + 1).alias("next")))
    rows = sents.select(*key, F.inline(places))
    line = Window.partitionBy(*key).orderBy("pos")
    low = (draw(seed, *[F.col(k) for k in key], F.col("pos")) < p) & F.col("next").isNotNull()
    rows = rows.withColumn("_low", low.cast("int")).withColumn("_run", F.sum(1 - F.col("_low")).over(line))
    rows = rows.withColumn("_at", F.sum("_low").over(Window.partitionBy(*key, "_run").orderBy("pos")))
    fuse = (F.col("_low") == 1) & (F.col("_at") % 2 == 1)
    rows = rows.withColumn("_fuse", fuse).withColumn("_gone", F.coalesce(F.lag("_fuse").over(line), F.lit(False)))
    return rows.where(~F.col("_gone")).select(*key, "pos", F.when(F.col("_fuse"), F.concat("word", "next")).otherwise(F.col("word")).alias("token"))


def acceptable(parts: Column, known: Column) -> Column:
    """Whether a split counts: two parts or more, each known and of two letters or more, or a or i."""
    return (F.size(parts) >= 2) & F.forall(parts, lambda x: F.array_contains(known, F.lower(x)) & ((F.length(x) >= 2) | F.lower(x).isin("a", "i")))


def tried(token: Column, known: Column, longest: int = 12) -> Column:
    """Whether a split is tried: the token is unknown, or long."""
    return ~F.array_contains(known, F.lower(token)) | (F.length(token) >= longest)
