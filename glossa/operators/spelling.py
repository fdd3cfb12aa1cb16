"""Edit-distance-1 spelling correction as similarity joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PROTECTED, alnum_core, context_clean, deletes, edits1, restore_case, tail, variants, within_one
from . import lm
from .corpus import narrowed, stored


def index(vocab: DataFrame) -> DataFrame:
    """(variant, word): the symmetric-delete index of vocab(w)."""
    return vocab.select(F.explode(variants(F.col("w"))).alias("variant"), F.col("w").alias("word"))


def candidates_b(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(q, word) within distance 1, by an equi-join of deletion variants and the distance as residual.

    Words that differ by a swap share a variant too: without the earlier of the two letters they are the same.  The
    variants meet by their hashes; a wrong meeting is dropped by the residual.
    """
    hashed = lambda rows, w, name: rows.select(w, F.explode(F.transform(variants(F.col(w)), lambda x: F.xxhash64(x))).alias("variant")).withColumnRenamed(w, name)
    met = hashed(queries, "q", "q").join(hashed(vocab, "w", "word"), "variant").select("q", "word")
    return met.where(within_one(F.col("q"), F.col("word"))).distinct()


def candidates_a(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(q, word): every a-z edit that is in the vocabulary."""
    return queries.select("q", F.explode(edits1(F.lower("q"))).alias("word")).join(vocab.select(F.col("w").alias("word")), "word", "left_semi").select("q", "word")


def best(cands: DataFrame, vocab: DataFrame) -> DataFrame:
    """(q, correction, n_candidates): the most frequent candidate, ties to the smaller word."""
    scored = cands.join(vocab.select(F.col("w").alias("word"), "c"), "word")
    return scored.groupBy("q").agg(F.min_by("word", F.struct(-F.col("c"), F.col("word"))).alias("correction"), F.count("*").alias("n_candidates"))


def corrupted(vocab: DataFrame) -> DataFrame:
    """(w, wrong): the first one-letter deletion outside the vocabulary, else the first replacement outside it.

    Nearly every word's very first deletion is outside, so the others are made only for words whose first is a word, and
    the replacements only for words all of whose deletions are.
    """
    long_ = vocab.where(F.length("w") >= 3).select("w")
    known = vocab.select(F.col("w").alias("wrong"), F.lit(True).alias("known"))
    first = stored(long_.select("w", F.substring("w", F.lit(2), F.length("w")).alias("wrong")).join(known, "wrong", "left").select("w", "wrong", "known"))

    def outside(tried: DataFrame) -> DataFrame:
        """(w, wrong) of tried(w, rank, wrong): the first that is no word."""
        words = narrowed(vocab.select(F.col("w").alias("wrong")), tried, ["wrong"])
        return stored(tried.join(words, "wrong", "left_anti").groupBy("w").agg(F.min_by("wrong", "rank").alias("wrong")))

    hard = first.where("known").select("w")
    dropped = outside(hard.select("w", F.posexplode(deletes(F.col("w"))).alias("rank", "wrong")))
    letters = F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"])
    replace = F.flatten(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.transform(letters, lambda c: F.concat(F.substring("w", F.lit(1), i - 1), c, F.substring("w", i + 1, F.length("w"))))))
    rest = stored(hard.join(dropped, "w", "left_anti"))
    replaced = outside(rest.select("w", F.posexplode(replace).alias("rank", "wrong")))
    return first.where("known is null").select("w", "wrong").unionByName(dropped).unionByName(replaced)


def candidates_unverified(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(q, word) that share a deletion, or one of them a deletion of the other; neither verified nor complete."""
    cuts = lambda rows, name: rows.select(name, F.explode(F.array_distinct(deletes(F.col(name)))).alias("variant"))
    words = vocab.select(F.col("w").alias("word"))
    asked = queries.select("q", F.explode(F.array_union(F.array("q"), deletes(F.col("q")))).alias("variant"))
    return asked.join(cuts(words, "word"), "variant").select("q", "word").distinct()


def misspelt(words: DataFrame, vocab: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """(w, wrong): ``most`` words in the order of their hashes, each with the edit outside the vocabulary of smallest hash."""
    mark = lambda *key: F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *key).cast("binary")), 1, 12)
    drawn = words.select("w").orderBy(mark("w"), "w").limit(most)
    edits = drawn.select("w", F.explode(edits1(F.col("w"))).alias("wrong")).join(vocab.select(F.col("w").alias("wrong")), "wrong", "left_anti")
    return edits.groupBy("w").agg(F.min_by("wrong", F.struct(mark("w", "wrong"), F.col("wrong"))).alias("wrong"))


def realword_independent(sents: DataFrame, key: list[str], train: DataFrame | lm.Tables, vocab: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(key, pos, w, correction, gain): each word against its original neighbours."""
    train = lm.tables(train)
    around = F.transform("w", lambda x, i: F.struct((i + 1).cast("long").alias("pos"), F.coalesce(F.get("w", i - 1), F.lit(lm.OPEN)).alias("prev"), x.alias("word"), F.coalesce(F.get("w", i + 1), F.lit(lm.CLOSE)).alias("next")))
    tokens = sents.select(*key, F.inline(around)).withColumnRenamed("word", "w")
    known = tokens.join(vocab.select("w"), "w", "left_semi").where((F.length("w") > 1) & ~F.col("w").isin(PROTECTED))
    pairs = candidates_b(known.select(F.col("w").alias("q")).distinct(), vocab).select(F.col("q").alias("w"), F.col("word").alias("cand"))
    trial = known.join(pairs, "w")
    # Both neighbours' pairs are scored in one pass over the counts.
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("prev").alias("w1"), F.col("cand").alias("w2")), F.struct(F.lit(1).alias("side"), F.col("cand").alias("w1"), F.col("next").alias("w2")))
    scored = lm.addk_scores(trial.select(*key, "pos", "w", "cand", F.inline(sides)), train)
    logp = lambda side: F.sum(F.when(F.col("side") == side, F.col("logp")))
    scored = scored.groupBy(*key, "pos", "w", "cand").agg(F.round(logp(0) + logp(1), 9).alias("s"))
    own = F.max(F.when(F.col("cand") == F.col("w"), F.col("s")))
    out = scored.groupBy(*key, "pos", "w").agg(F.min_by("cand", F.struct(-F.col("s"), F.col("cand"))).alias("correction"), (F.max("s") - own).alias("gain"))
    return out.where(F.col("gain") >= threshold)


def realword_serial(sents: DataFrame, train: DataFrame | lm.Tables, vocab: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Adds ``corrected`` to rows with tokens ``w``: left to right, the left neighbour being corrected already.

    Equal sentences are corrected once.  The candidates of the distinct words come from the similarity join, and the
    pairs of neighbours that may be asked for are listed before they are counted: each candidate of a word beside each
    candidate of the next.  The serial pass is a vectorised UDF over the sentence with the scores it can need.
    """
    k, t = 0.05, lm.tables(train)
    said = sents.select("w").distinct().withColumn("id", F.xxhash64("w"))
    types = said.select(F.explode("w").alias("q")).distinct()
    own = types.join(t.words.select(F.col("w").alias("q")), "q", "left_semi").where((F.length("q") > 1) & ~F.col("q").isin(PROTECTED))
    lists = candidates_b(own, vocab).where("q <> word").groupBy("q").agg(F.sort_array(F.collect_set("word")).alias("cands"))  # bounded by the neighbours of a word
    places = said.select("id", F.posexplode("w").alias("pos", "q")).join(lists, "q", "left").select("id", "pos", "q", F.coalesce("cands", F.array().cast("array<string>")).alias("cands"))
    tried = places.select("id", "pos", "q", F.explode(F.concat(F.array("q"), "cands")).alias("x"))
    edge = lambda pos, w: said.select("id", pos.alias("pos"), F.lit(w).alias("x"))
    here = tried.select("id", "pos", "x").unionByName(edge(F.lit(-1), lm.OPEN)).unionByName(edge(F.size("w"), lm.CLOSE))
    after = here.select("id", (F.col("pos") - 1).alias("pos"), F.col("x").alias("w2"))
    asked = here.withColumnRenamed("x", "w1").join(after, ["id", "pos"]).select("id", "w1", "w2").distinct()
    scores = lm.addk_scores(asked, t, k).groupBy("id").agg(F.collect_list(F.struct("w1", "w2", "logp")).alias("_scores"))
    cands = places.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cands"))), lambda x: x["cands"]).alias("_cands"))
    ready = said.join(scores, "id", "left").join(cands, "id", "left")

    @F.pandas_udf("array<string>")
    def correct(w: pd.Series, cands: pd.Series, scores: pd.Series) -> pd.Series:
        def one(words, cands, scores) -> list[str]:
            out, logp = list(words), {(s["w1"], s["w2"]): s["logp"] for s in scores if s is not None}
            for i, word in enumerate(out):
                prev, nxt = out[i - 1] if i else lm.OPEN, words[i + 1] if i + 1 < len(words) else lm.CLOSE
                base, gain = logp[prev, word] + logp[word, nxt], threshold
                for c in cands[i]:
                    if (g := logp[prev, c] + logp[c, nxt] - base) > gain:
                        out[i], gain = c, g
            return out

        return pd.Series([one(w, c if c is not None else [], s if s is not None else []) for w, c, s in zip(w, cands, scores)])

    done = ready.select(F.col("w").alias("_w"), correct("w", "_cands", "_scores").alias("corrected"))
    return sents.join(done, F.col("w") == F.col("_w"), "left").select(*sents.columns, F.coalesce("corrected", "w").alias("corrected"))


def corrected_sentences(rows: DataFrame, text: str, train: DataFrame | lm.Tables, vocab: DataFrame, threshold: float = 2.5) -> DataFrame:
    """Adds ``corrected`` and ``changes`` (array of pairs) to rows with a text, in two steps.

    A token's letters and digits, where they hold a letter and are unknown, become the most frequent word within one edit,
    in the token's case, and its other characters follow; then words are held against their neighbours, serially.
    """
    t = lm.tables(train)
    said = rows.select(text).distinct().withColumn("_tokens", F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    tokens = said.select(text, F.posexplode("_tokens").alias("pos", "token")).withColumn("core", alnum_core(F.col("token")))
    asked = tokens.where(F.col("core").rlike(r"\p{L}")).select(F.lower("core").alias("q")).distinct().join(t.words.select(F.col("w").alias("q")), "q", "left_anti")
    fixed = best(candidates_b(asked, vocab), vocab).select("q", "correction")
    tokens = tokens.join(fixed, F.lower("core") == F.col("q"), "left")
    tokens = tokens.withColumn("first", F.when(F.col("correction").isNull(), F.col("token")).otherwise(F.concat(restore_case(F.col("correction"), F.col("core")), tail(F.col("token")))))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token", "first", context_clean(F.col("first")).alias("w"))))
    lines = tokens.groupBy(text).agg(ordered.alias("_t")).withColumn("w", F.transform("_t", lambda x: x["w"]))
    lines = realword_serial(lines, t, vocab, threshold)
    second = lambda x, i: F.when(F.get("corrected", i) == x["w"], x["first"]).otherwise(F.concat(restore_case(F.get("corrected", i), alnum_core(x["first"])), tail(x["first"])))
    lines = lines.select(F.col(text).alias("_text"), "_t", F.transform("_t", second).alias("_out"))
    changed = F.filter(F.transform("_t", lambda x, i: F.struct(x["token"].alias("old"), F.get("_out", i).alias("new"))), lambda c: c["old"] != c["new"])
    lines = lines.select("_text", F.array_join("_out", " ").alias("corrected"), changed.alias("changes"))
    none = F.array().cast("array<struct<old:string,new:string>>")
    return rows.join(lines, F.col(text) == F.col("_text"), "left").select(*rows.columns, F.coalesce("corrected", F.lit("")).alias("corrected"), F.coalesce("changes", none).alias("changes"))


def highlighted(corrected: Column, changes: Column) -> Column:
    """The corrected text with changed words between double asterisks."""
    new = F.transform(changes, lambda c: c["new"])
    return F.array_join(F.transform(F.split(corrected, " "), lambda x: F.when(F.array_contains(new, x), F.concat(F.lit("**"), x, F.lit("**"))).otherwise(x)), " ")
