"""Part-of-speech tagging: counts and log-probabilities as tables, a beam decoder as a vectorised UDF."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_features
from .corpus import narrowed, stored

START, END = "<s>", "</s>"
#: Tags of the Brown corpus and their Penn Treebank counterparts.
BROWN_TO_PENN = {
    "AT": "DT", "NN": "NN", "NNS": "NNS", "NP": "NNP", "NP$": "NNP", "NP-TL": "NNP", "NPS": "NNPS", "NPS-TL": "NNPS",
    "NR": "NN", "JJ": "JJ", "JJ-TL": "JJ", "JJR": "JJR", "JJS": "JJS", "RB": "RB", "RB-TL": "RB", "RBR": "RBR",
    "RBS": "RBS", "VB": "VB", "VBD": "VBD", "VBG": "VBG", "VBN": "VBN", "VBP": "VBP", "VBZ": "VBZ", "IN": "IN",
    "IN-TL": "IN", "CS": "IN", "CC": "CC", "CC-TL": "CC", "CD": "CD", "CD-TL": "CD", "PP$": "PRP$", "PPS": "PRP",
    "PPSS": "PRP", "PPO": "PRP", "PN": "NN", "QL": "RB", "MD": "MD", "BE": "VB", "BED": "VBD", "BEDZ": "VBD",
    "BEG": "VBG", "BEN": "VBN", "BER": "VBP", "BEZ": "VBZ", "DO": "VB", "DOD": "VBD", "DOZ": "VBZ", "HV": "VB",
    "HVD": "VBD", "HVZ": "VBZ", "WDT": "WDT", "WP": "WP", "WP$": "WP$", "WRB": "WRB", ".": ".", ",": ",",
    ":": ":", "(": "-LRB-", ")": "-RRB-", "``": "``", "''": "''",
}
#: Valid Penn tags.
PENN = [
    "CC", "CD", "DT", "EX", "FW", "IN", "JJ", "JJR", "JJS", "LS", "MD", "NN", "NNS", "NNP",
    "NNPS", "PDT", "POS", "PRP", "PRP$", "RB", "RBR", "RBS", "RP", "SYM", "TO", "UH", "VB", "VBD",
    "VBG", "VBN", "VBP", "VBZ", "WDT", "WP", "WP$", "WRB", ".", ",", ":",
]


def reconcile(tag: Column) -> Column:
    """Brown tag to Penn tag: mapped, else valid as it is, else valid before the first hyphen, else NN."""
    table = F.create_map(*[F.lit(x) for kv in BROWN_TO_PENN.items() for x in kv])
    head = F.when(F.isnull(F.try_element_at(table, tag)), F.substring_index(tag, "-", 1)).otherwise(tag)
    return F.coalesce(F.try_element_at(table, head), F.when(tag.isin(PENN), tag), F.when(head.isin(PENN), head), F.lit("NN"))


def english_morph(word: Column, tag: Column) -> Column:
    ends = lambda s: word.endswith(s)
    return (
        F.when(tag == "NOUN", F.when(ends("s") & ~ends("ss"), "NOUN-Pl").otherwise("NOUN-Sg"))
        .when(tag == "VERB", F.when(ends("ed"), "VERB-Past").when(ends("ing"), "VERB-Prog").when(ends("s"), "VERB-3Sg").otherwise(tag))
        .when(tag == "ADJ", F.when(ends("er"), "ADJ-Comp").when(ends("est"), "ADJ-Sup").otherwise(tag))
        .otherwise(tag)
    )


def feats_tag(upos: Column, feats: Column) -> Column:
    """UPOS with the first four letters of Gender and Number, where FEATS has them."""
    of = lambda k: F.nullif(F.regexp_extract(feats, rf"(?:^|\|){k}=([^|]*)", 1), F.lit(""))
    return F.concat_ws("-", upos, F.left(of("Gender"), F.lit(4)), F.left(of("Number"), F.lit(4)))


def tokens(tagged: DataFrame) -> DataFrame:
    """(w, tag, form) of tagged(sent, tokens array<struct<form, tag>>)."""
    return tagged.select(F.explode("tokens").alias("t")).select(F.lower("t.form").alias("w"), "t.tag", "t.form")


class Counts:
    """Counts of a tagged corpus, from which all its tables are made; ``keep`` may write them, so they are made once.

    A corpus is read once for its words and once for its tags, and only counts are joined.  ``forms`` may be given.
    """

    def __init__(self, tagged: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df, forms: DataFrame | None = None):
        self.tagged, self.keep = tagged, keep
        if forms is not None:
            self.forms = forms

    @cached_property
    def forms(self) -> DataFrame:
        """(form, w, tag, c)."""
        said = self.tagged.select(F.explode("tokens").alias("t")).groupBy(F.col("t.form").alias("form"), F.col("t.tag").alias("tag")).agg(F.count("*").alias("c"))
        return self.keep(said.select("form", F.lower("form").alias("w"), "tag", "c"))

    @cached_property
    def moves(self) -> DataFrame:
        """(t1, t2, t3, opens, closes, c): each tag after the two before it, and whether it is a sentence's first or last."""
        padded = F.concat(F.array(F.lit(START), F.lit(START)), F.transform("tokens", lambda t: t["tag"]))
        place = lambda p, i: F.struct(F.get(p, i - 2).alias("t1"), F.get(p, i - 1).alias("t2"), F.get(p, i).alias("t3"), (i == 2).alias("opens"), (i == F.size("tokens") + 1).alias("closes"))
        grams = F.transform(F.array(padded), lambda p: F.transform(F.sequence(F.lit(2), F.size("tokens") + 1), lambda i: place(p, i)))
        return self.keep(self.tagged.where(F.size("tokens") > 0).select(F.inline(F.flatten(grams))).groupBy("t1", "t2", "t3", "opens", "closes").agg(F.count("*").alias("c")))

    @cached_property
    def weights(self) -> DataFrame:
        """(feature, tag, weight) of ``feature_weights``."""
        return self.keep(_weights(self.forms, 5))


def counted(tagged: DataFrame | Counts, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Counts:
    return tagged if isinstance(tagged, Counts) else Counts(tagged, keep)


def transition_counts(tagged: DataFrame | Counts, closed: bool = False) -> DataFrame:
    """(t1, t2, t3, c) with two opening marks, and with a closing one if ``closed``."""
    moves = counted(tagged).moves
    rows = moves.select("t1", "t2", "t3", "c")
    if closed:
        rows = rows.unionByName(moves.where("closes").select(F.col("t2").alias("t1"), F.col("t3").alias("t2"), F.lit(END).alias("t3"), "c"))
    return rows.groupBy("t1", "t2", "t3").agg(F.sum("c").alias("c"))


def tag_counts(tagged: DataFrame | Counts) -> DataFrame:
    return counted(tagged).forms.groupBy("tag").agg(F.sum("c").alias("n"))


def transition_probs(tagged: DataFrame | Counts, alpha: float = 0.1, closed: bool = False) -> DataFrame:
    """(t1, t2, t3, p) of what was observed; anything else is 1 / number of tags."""
    tagged = counted(tagged)
    c = transition_counts(tagged, closed)
    context = c.groupBy("t1", "t2").agg(F.sum("c").alias("n"))
    k = F.broadcast(tag_counts(tagged).agg(F.count("*").alias("k")))
    return c.join(context, ["t1", "t2"]).join(k).select("t1", "t2", "t3", ((F.col("c") + alpha) / (F.col("n") + alpha * F.col("k"))).alias("p"))


def transitions(tagged: DataFrame | Counts, alpha: float = 0.1, closed: bool = False) -> DataFrame:
    """(t1, t2, t3, logp) of what was observed; anything else is ln(1 / number of tags)."""
    return transition_probs(tagged, alpha, closed).select("t1", "t2", "t3", F.ln("p").alias("logp"))


def start_end_probs(tagged: DataFrame | Counts, alpha: float = 0.1) -> DataFrame:
    """(tag, start_p, end_p)."""
    tagged = counted(tagged)
    moves, n = tagged.moves, tag_counts(tagged)
    sents = moves.where("opens").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("sents"))
    all_ = F.broadcast(sents.join(n.agg(F.count("*").alias("k"))))
    first = moves.where("opens").groupBy(F.col("t3").alias("tag")).agg(F.sum("c").alias("s"))
    last = moves.where("closes").groupBy(F.col("t3").alias("tag")).agg(F.sum("c").alias("e"))
    out = n.join(first, "tag", "left").join(last, "tag", "left").join(all_).na.fill(0, ["s", "e"])
    return out.select("tag", ((F.col("s") + alpha) / (F.col("sents") + alpha * F.col("k"))).alias("start_p"), ((F.col("e") + alpha) / (F.col("n") + 2 * alpha)).alias("end_p"))


def start_end(tagged: DataFrame | Counts, alpha: float = 0.1) -> DataFrame:
    """(tag, start_logp, end_logp)."""
    return start_end_probs(tagged, alpha).select("tag", F.ln("start_p").alias("start_logp"), F.ln("end_p").alias("end_logp"))


def word_tags(forms: DataFrame) -> DataFrame:
    """(w, tag, c) of ``Counts.forms``."""
    return forms.groupBy("w", "tag").agg(F.sum("c").alias("c"))


def emission_probs(tagged: DataFrame | Counts, asked: DataFrame | None = None) -> DataFrame:
    """(w, tag, p), of words asked(w) only if given."""
    tagged = counted(tagged)
    forms = tagged.forms if asked is None else narrowed(tagged.forms, asked, ["w"])
    return word_tags(forms).join(F.broadcast(tag_counts(tagged)), "tag").select("w", "tag", (F.col("c") / F.col("n")).alias("p"))


def emissions(tagged: DataFrame | Counts) -> DataFrame:
    """(w, tag, logp)."""
    return emission_probs(tagged).select("w", "tag", F.ln("p").alias("logp"))


def laplace_emissions(tagged: DataFrame | Counts) -> DataFrame:
    """(w, tag, logp) with (c + 1) / (n + different pairs of word and tag)."""
    tagged = counted(tagged)
    c = word_tags(tagged.forms)
    size = F.broadcast(c.agg(F.count("*").alias("v")))
    return c.join(F.broadcast(tag_counts(tagged)), "tag").join(size).select("w", "tag", F.ln((F.col("c") + 1) / (F.col("n") + F.col("v"))).alias("logp"))


def _weights(forms: DataFrame, rare: int) -> DataFrame:
    often = forms.groupBy("w").agg(F.sum("c").alias("n"))
    weighed = forms.join(often, "w").select(F.explode(word_features(F.col("form"))).alias("feature"), "tag", (F.when(F.col("n") <= rare, 3).otherwise(1) * F.col("c")).alias("weight"))
    return weighed.groupBy("feature", "tag").agg(F.sum("weight").alias("weight"))


def feature_weights(tagged: DataFrame | Counts, rare: int = 5) -> DataFrame:
    """(feature, tag, weight): each occurrence of a rare word counts three times."""
    tagged = counted(tagged)
    return tagged.weights if rare == 5 else _weights(tagged.forms, rare)


def morph_scores(forms: DataFrame, tagged: DataFrame | Counts, beta: float = 0.1) -> DataFrame:
    """(form, tag, logp): sum of ln((c + beta) / (total + beta F)) over the word's features, by the root of their number."""
    weights = feature_weights(tagged)
    total = weights.groupBy("tag").agg(F.sum("weight").alias("total"))
    size = weights.select("feature").distinct().agg(F.count("*").alias("f"))
    asked = forms.select("form", F.explode(word_features(F.col("form"))).alias("feature"))
    every = asked.join(F.broadcast(total.join(size)))  # one row per tag: the tag set is fixed
    out = every.join(weights, ["feature", "tag"], "left")
    term = F.ln((F.coalesce("weight", F.lit(0)) + beta) / (F.col("total") + beta * F.col("f")))
    return out.groupBy("form", "tag").agg((F.sum(term) / F.sqrt(F.count("*"))).alias("logp"))


def baseline_tags(forms: DataFrame, tagged: DataFrame | Counts) -> DataFrame:
    """Adds ``tag`` to rows with ``form``: the word's most frequent one, else that of the corpus, else NOUN."""
    tagged = counted(tagged)
    common = F.broadcast(tag_counts(tagged).agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("_common")))
    best = most_frequent_tags(tagged).withColumnRenamed("w", "_w")
    return forms.join(best, F.lower("form") == F.col("_w"), "left").join(common).select(*forms.columns, F.coalesce("best", "_common", F.lit("NOUN")).alias("tag"))


def most_frequent_tags(tagged: DataFrame | Counts) -> DataFrame:
    """(w, best): ties to the smaller tag."""
    return word_tags(counted(tagged).forms).groupBy("w").agg(F.min_by("tag", F.struct(-F.col("c"), F.col("tag"))).alias("best"))


class Chain:
    """Transitions, starts and ends; their size depends on the tag set alone.

    The decoder takes logarithms by ``math.log``: Spark's ``ln`` may differ in the last bit, and that decides between paths
    of the same factors in another order.
    """

    def __init__(self, tagged: DataFrame | Counts, beam: int = 40):
        tagged = counted(tagged, stored)
        rows = lambda df: [tuple(r) for r in df.collect()]
        self.trans = {r[:3]: math.log(r[3]) for r in rows(transition_probs(tagged))}
        ends = rows(start_end_probs(tagged))
        self.start, self.end = {r[0]: math.log(r[1]) for r in ends}, {r[0]: math.log(r[2]) for r in ends}
        self.tags, self.beam = sorted(self.start), beam

    def best(self, emitted: list[dict[str, float]]) -> list[str]:
        """The best tags for the emission scores of a sentence's words; of equal states the smaller tags go on."""
        if not emitted or not self.tags:
            return []
        unseen = math.log(1 / len(self.tags))
        # A path is its last tag and the path before it, so long sentences copy none.
        states = {(START, t): (self.start[t] + emitted[0][t], (t, None)) for t in self.tags}
        for e in emitted[1:]:
            new: dict = {}
            for (a, b), (s, path) in states.items():
                for t in self.tags:
                    v = s + self.trans.get((a, b, t), unseen) + e[t]
                    if (b, t) not in new or v > new[b, t][0]:
                        new[b, t] = (v, (t, path))
            states = dict(sorted(sorted(new.items(), key=lambda x: (-x[1][0], x[0]))[: self.beam]))
        path, out = max(states.values(), key=lambda x: x[0] + self.end[x[1][0]])[1], []
        while path:
            out.append(path[0])
            path = path[1]
        return out[::-1]


class Decoder(Chain):
    """A tagger in memory: the chain and the emissions of all training words, for single sentences and small models."""

    def __init__(self, tagged: DataFrame | Counts, beam: int = 40):
        tagged = counted(tagged, stored)
        super().__init__(tagged, beam)
        rows = lambda df: [tuple(r) for r in df.collect()]
        self.emit: dict[str, dict[str, float]] = {}
        for w, tag, p in rows(emission_probs(tagged)):
            self.emit.setdefault(w, {})[tag] = math.log(p)
        weights = rows(feature_weights(tagged))
        self.weight = {(f, t): w for f, t, w in weights}
        self.total: dict[str, int] = {}
        for _, t, w in weights:
            self.total[t] = self.total.get(t, 0) + w
        self.features = len({f for f, _, _ in weights})

    def shape(self, word: str) -> list[str]:
        low, n = word.lower(), len(word)
        out = [f"suf_{low[-k:]}" for k in (1, 2, 3, 4) if n > k] + [f"pref_{low[:k]}" for k in (2, 3) if n > k + 1]
        out += ["shape_has_digit"] * any(c.isdigit() for c in word) + ["shape_has_hyphen"] * ("-" in word)
        kind = "all_caps" if word.isupper() and n > 1 else "capitalized" if word[:1].isupper() and (n == 1 or word[1:].islower()) else "all_lower" if word.islower() else ""
        return out + [f"shape_{kind}"] * bool(kind)

    def emission(self, word: str) -> dict[str, float]:
        if (known := self.emit.get(word.lower())) is not None:
            return {t: known.get(t, -25.0) for t in self.tags}
        fs = self.shape(word)
        if not fs:
            return dict.fromkeys(self.tags, -10.0)
        return {t: sum(math.log((self.weight.get((f, t), 0) + 0.1) / (self.total.get(t, 0) + 0.1 * self.features)) for f in fs) / math.sqrt(len(fs)) for t in self.tags}

    def score(self, words: list[str], tags: tuple[str, ...]) -> float:
        e = [self.emission(w) for w in words]
        total = self.start[tags[0]] + e[0][tags[0]] + self.end[tags[-1]]
        for i in range(1, len(tags)):
            total += self.trans.get((tags[i - 2] if i > 1 else START, tags[i - 1], tags[i]), math.log(1 / len(self.tags))) + e[i][tags[i]]
        return total

    def exhaustive(self, words: list[str]) -> list[str]:
        return list(max(product(self.tags, repeat=len(words)), key=lambda t: self.score(words, t))) if words else []

    def decode(self, words: list[str]) -> list[str]:
        return self.best([self.emission(w) for w in words])


def emission_scores(forms: DataFrame, tagged: DataFrame | Counts) -> DataFrame:
    """(form, scores map<tag, logp>) of forms(form): known words by the table or -25, others by their features or -10."""

    @F.pandas_udf("double")
    def log(p: pd.Series) -> pd.Series:  # as in Chain
        return p.map(math.log)

    tagged = counted(tagged, stored)
    asked = stored(forms.select("form").distinct())
    tags = tag_counts(tagged).select("tag")
    known = stored(emission_probs(tagged, asked.select(F.lower("form").alias("w"))).select("w", "tag", log("p").alias("logp")))
    seen = asked.join(known.select(F.col("w").alias("_w")).distinct(), F.lower("form") == F.col("_w"), "left_semi")
    of_known = seen.join(F.broadcast(tags)).withColumn("w", F.lower("form")).join(known, ["w", "tag"], "left").select("form", "tag", F.coalesce("logp", F.lit(-25.0)).alias("logp"))
    new = asked.join(seen, "form", "left_anti")
    bare = new.where(F.size(word_features(F.col("form"))) == 0).join(F.broadcast(tags)).select("form", "tag", F.lit(-10.0).alias("logp"))
    every = of_known.unionByName(morph_scores(new, tagged)).unionByName(bare)
    return every.groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("tag", "logp"))).alias("scores"))


def viterbi(sents: DataFrame, tagged: DataFrame | Counts, beam: int = 40) -> DataFrame:
    """Adds ``tags`` to rows with ``w``, an array of words; equal sentences are decoded once.

    Emission scores are joined to a sentence's different words, so only the chain is broadcast, which the tag set bounds.
    """
    tagged = counted(tagged, stored)
    sent = sents.sparkSession.sparkContext.broadcast(Chain(tagged, beam))
    said = stored(sents.select("w").where("size(w) > 0").distinct().withColumn("_id", F.monotonically_increasing_id()))
    placed = said.select("_id", F.explode(F.array_distinct("w")).alias("form"))
    held = placed.join(emission_scores(placed, tagged), "form").groupBy("_id").agg(F.collect_list(F.struct("form", F.map_entries("scores").alias("e"))).alias("_e"))

    @F.pandas_udf("array<string>")
    def decode(words: pd.Series, emitted: pd.Series) -> pd.Series:
        def one(w, e) -> list[str]:
            scores = {x["form"]: {y["key"]: y["value"] for y in x["e"]} for x in e}
            return sent.value.best([scores[x] for x in w if x in scores])

        return pd.Series([one(w, e) for w, e in zip(words, emitted)])

    done = said.join(held, "_id").select(F.col("w").alias("_w"), decode("w", "_e").alias("tags"))
    return sents.join(done, F.col("w") == F.col("_w"), "left").select(*sents.columns, F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
