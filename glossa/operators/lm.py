"""n-gram models as tables, and scores by joins with them.

Counting pads each sentence's array and explodes its n-grams, so the only shuffle is that of the partial counts.  Scores
take either training sentences or ``Tables``, which hold the counts of a corpus once for all scores that need them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import narrowed, stored

OPEN, CLOSE = "<s>", "</s>"
LAMBDAS = (0.60, 0.25, 0.14, 0.01)


def grams(n: int, opened: int) -> Column:
    """array of structs w1 .. wn over the padded sentence ``w``."""
    padded = F.concat(F.array(*[F.lit(OPEN)] * opened), F.col("w"), F.array(F.lit(CLOSE)))
    held = F.array(padded)
    size = F.size("w") + opened + 1
    return F.flatten(
        F.transform(held, lambda p: F.transform(F.sequence(F.lit(0), size - n), lambda i: F.struct(*[F.get(p, i + k).alias(f"w{k + 1}") for k in range(n)])))
    )


def counts(sents: DataFrame, n: int, opened: int) -> DataFrame:
    """(w1 .. wn, c); sentences too short for one n-gram do not exist, as a boundary is always there."""
    return sents.select(F.inline(grams(n, opened))).groupBy(*[f"w{k + 1}" for k in range(n)]).agg(F.count("*").alias("c"))


def padded_unigrams(sents: DataFrame) -> DataFrame:
    """Counts of words and of one opening and closing mark for each sentence."""
    marked = sents.select(F.explode(F.concat(F.array(F.lit(OPEN)), "w", F.array(F.lit(CLOSE)))).alias("w"))
    return marked.groupBy("w").agg(F.count("*").alias("c"))


class Tables:
    """Counts of training sentences, made when they are first asked for; ``keep`` may write them, so they are made once."""

    def __init__(self, sents: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.sents, self.keep = sents, keep

    @cached_property
    def words(self) -> DataFrame:
        """(w, c) without marks."""
        return self.keep(self.sents.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("c")))

    @cached_property
    def marked(self) -> DataFrame:
        """(w, c) with one opening and one closing mark for each sentence."""
        n = self.sents.agg(F.count("*").alias("c")).where("c > 0")
        marks = n.select(F.explode(F.array(F.lit(OPEN), F.lit(CLOSE))).alias("w"), "c")
        return self.keep(self.words.unionByName(marks))

    @cached_property
    def closed(self) -> DataFrame:
        """(w, c) with closing marks only."""
        return self.marked.where(F.col("w") != OPEN)

    @cached_property
    def pairs(self) -> DataFrame:
        """(w1, w2, c)."""
        return self.keep(counts(self.sents, 2, 1))

    @cached_property
    def triples(self) -> DataFrame:
        """(w1, w2, w3, c)."""
        return self.keep(counts(self.sents, 3, 2))

    def some_words(self, asked: DataFrame) -> DataFrame:
        """The rows of ``marked`` of words asked(w)."""
        return narrowed(self.marked, asked, ["w"])

    def some_pairs(self, asked: DataFrame) -> DataFrame:
        """The rows of ``pairs`` asked for, (w1, w2); if the table is not made, only these are counted."""
        return self._some("pairs", asked, 2, 1)

    def some_triples(self, asked: DataFrame) -> DataFrame:
        """As ``some_pairs``."""
        return self._some("triples", asked, 3, 2)

    def _some(self, name: str, asked: DataFrame, n: int, opened: int) -> DataFrame:
        keys = [f"w{k + 1}" for k in range(n)]
        if name in self.__dict__:
            return narrowed(self.__dict__[name], asked, keys)
        return narrowed(self.sents.select(F.inline(grams(n, opened))), asked, keys).groupBy(*keys).agg(F.count("*").alias("c"))


def tables(train: DataFrame | Tables) -> Tables:
    return train if isinstance(train, Tables) else Tables(train)


def totals(unigrams: DataFrame) -> DataFrame:
    """(n, v): tokens and types; one row."""
    return unigrams.agg(F.sum("c").alias("n"), F.count("*").alias("v"))


def unigram_probabilities(train: DataFrame | Tables) -> DataFrame:
    uni = tables(train).words
    return uni.join(F.broadcast(totals(uni))).select("w", "c", ((F.col("c") + 1) / (F.col("n") + F.col("v"))).alias("p"))


def relative_frequencies(train: DataFrame | Tables) -> DataFrame:
    """(w, c, p) without smoothing."""
    uni = tables(train).words
    return uni.join(F.broadcast(totals(uni))).select("w", "c", (F.col("c") / F.col("n")).alias("p"))


def addk_scores(pairs: DataFrame, train: DataFrame | Tables, k: float = 0.05) -> DataFrame:
    """Adds ln((c(w1,w2) + k) / (c(w1) + k V)) to rows with w1 and w2."""
    t, pairs = tables(train), stored(pairs)
    size = F.broadcast(t.marked.agg(F.count("*").alias("v")))
    left = t.some_words(pairs.select(F.col("w1").alias("w"))).select(F.col("w").alias("w1"), F.col("c").alias("c1"))
    out = pairs.join(t.some_pairs(pairs), ["w1", "w2"], "left").join(left, "w1", "left").join(size)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.withColumn("logp", F.ln((zero("c") + k) / (zero("c1") + k * F.col("v")))).drop("c", "c1", "v")


def addk_row_scores(pairs: DataFrame, train: DataFrame | Tables, k: float = 0.01) -> DataFrame:
    """``addk_scores`` whose context is the sum of its row of pairs, over all words and both marks."""
    t = tables(train)
    size = F.broadcast(t.words.agg((F.count("*") + 2).alias("v")))
    row = t.pairs.groupBy("w1").agg(F.sum("c").alias("c1"))
    out = pairs.join(t.pairs, ["w1", "w2"], "left").join(row, "w1", "left").join(size)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.withColumn("logp", F.ln((zero("c") + k) / (zero("c1") + k * F.col("v")))).drop("c", "c1", "v")


def interpolated_scores(triples: DataFrame, train: DataFrame | Tables, lambdas: tuple = LAMBDAS) -> DataFrame:
    """Adds the interpolated log-probability of w3 after w1 and w2; words outside the vocabulary pay by their length."""
    m, triples = tables(train), stored(triples)
    both = F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))
    tri, bi = m.some_triples(triples), stored(m.some_pairs(triples.select(F.inline(both))))
    some, uni = stored(m.some_words(triples.select(F.explode(F.array("w2", "w3")).alias("w")))), m.closed
    all_ = F.broadcast(uni.agg(F.sum("c").alias("t"), F.count(F.when(F.col("w") != CLOSE, 1)).alias("v")))
    out = triples.join(tri.withColumnRenamed("c", "c3"), ["w1", "w2", "w3"], "left")
    out = out.join(bi.select("w1", "w2", F.col("c").alias("c12")), ["w1", "w2"], "left")
    out = out.join(bi.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("c").alias("c23")), ["w2", "w3"], "left")
    # Every word and every opening mark begins one pair.
    context = some.where(F.col("w") != CLOSE).select(F.col("w").alias("w2"), F.col("c").alias("x2"))
    out = out.join(context, "w2", "left")
    out = out.join(some.where(F.col("w") != OPEN).select(F.col("w").alias("w3"), F.col("c").alias("c3u")), "w3", "left").join(all_)
    part = lambda a, b: F.coalesce(F.try_divide(F.coalesce(a, F.lit(0)), b), F.lit(0.0))
    a, b, c, d = lambdas
    p = a * part("c3", "c12") + b * part("c23", "x2") + c * part("c3u", F.col("t")) + d / F.col("v")
    unknown = F.when(F.col("c3u").isNull() & (F.col("w3") != CLOSE), 3.0 + 1.2 * F.length("w3")).otherwise(0.0)
    return out.withColumn("logp", F.when(p > 0, F.ln(p)).otherwise(-50.0) - unknown).select(*triples.columns, "logp")


def laplace_scores(train: DataFrame | Tables) -> DataFrame:
    """(w1, w2, w3, logp) with (c3 + 1) / (c2 + V); the double boundary is counted as a context."""
    t = tables(train)
    context = t.triples.groupBy("w1", "w2").agg(F.sum("c").alias("c2"))
    size = F.broadcast(t.marked.agg(F.count("*").alias("v")))
    return t.triples.join(context, ["w1", "w2"]).join(size).select("w1", "w2", "w3", F.ln((F.col("c") + 1) / (F.col("c2") + F.col("v"))).alias("logp"))


def sentence_scores(queries: DataFrame, key: list[str], train: DataFrame | Tables) -> DataFrame:
    """(key, n, logp, perplexity) of sentences under the add-k bigram model."""
    pairs = queries.select(*key, F.size("w").alias("n"), F.inline(grams(2, 1)))
    out = addk_scores(pairs, train).groupBy(*key, "n").agg(F.sum("logp").alias("logp"))
    average = F.col("logp") / F.col("n")
    return out.withColumn("perplexity", F.when(average > -20, F.exp(-average)).otherwise(9999.0))


def trigram_sentence_scores(queries: DataFrame, key: list[str], train: DataFrame | Tables) -> DataFrame:
    """(key, n, logp) of sentences under the interpolated trigram model, the closing mark included."""
    triples = queries.select(*key, F.size("w").alias("n"), F.inline(grams(3, 2)))
    return interpolated_scores(triples, train).groupBy(*key, "n").agg(F.sum("logp").alias("logp"))
