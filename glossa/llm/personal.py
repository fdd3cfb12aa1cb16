"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.  DataFrame operations only.

Base spans come from the four regular expressions of the contract, written so that they run in linear time (possessive
quantifiers; a match may only begin where a run of its characters begins or where the last match ended - beginning
later inside a run could not succeed where its beginning fails).

Seeds are the base spans and tokens that look like keys (SECRET: at least 20 characters that mix letters and digits).
Every token with a digit or @ is an instance; its patterns are the two words before it and, where the word before is a
label (it ends in : = or #), that word alone.  Words with a digit or @ stand in patterns as marks.  Instances, patterns
and shapes of instances (letters and digits replaced by marks) form a graph, which is scored in turns: a pattern is as
good as the mean of its different instances, counted with a doubt of DOUBT unknown ones, and a shape likewise; an
instance is as good as its best pattern, or nearly as good as its shape (LIKENESS); seeds stay at 1.  So confidence goes
from seeds to patterns, to unseen instances after these, to others of their shape, and on to further patterns.
Patterns of GOOD or better with at least SUPPORT different instances mark the tokens after them that look like
identifiers as spans of kind ``context``.  Frequent patterns are pre-aggregated; no group is gathered.

Defined results: null text counts as empty; repeated rows each get their spans; a null doc_id is kept; overlapping
spans of different kinds all stand (masking merges them); further columns, whatever their names, are ignored by
``personal_data`` and kept by ``mask``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut

#: The base kinds in order, as regular expressions for Java.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
KINDS = ["email", "ip", "card", "phone", "context"]
TOKEN = r"(?:\G|(?<![^\x20\x09-\x0D]))[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: What looks like a key; and what looks like an identifier, if a good pattern stands before it.
SECRET = r"^(?=(?:[^0-9]*[0-9]){4})(?=(?:[^A-Za-z]*[A-Za-z]){4})[A-Za-z0-9_+/=-]{20,}$"
LIKELY = "length({0}) >= 6 AND length(regexp_replace({0}, '[^0-9]', '')) >= 4"
ROUNDS, GOOD, SUPPORT, DOUBT, LIKENESS = 4, 0.8, 4, 0.5, 0.9
CHUNK = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def two_words(text: Column) -> Column:
    """The last two words in lower case, those with a digit or @ as the marks 0 and @; empty where there are fewer."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    mark = lambda w: F.when(F.instr(w, "@") > 0, "@").when(w.rlike("[0-9]"), "0").otherwise(F.lower(w))
    return let(F.slice(F.concat(F.array(F.lit(""), F.lit("")), words), -2, 2), lambda x: F.when(F.get(x, F.lit(0)) == "", "").otherwise(F.array_join(F.transform(x, mark), " ")))


def matches(text: Column, pattern: str, words: bool = False) -> Column:
    """array<struct<s, e, m, before>>: start and end (code points) of all matches, the match, and the two words before.

    ``split`` gives what lies between the matches, so the starts are running sums of lengths; the sums are made in
    chunks, which keeps long lists linear.  With ``words`` every match must be a whole word: then the two words before
    lie in the gap or in the two matches before it.  Without, ``before`` is empty.
    """
    near = lambda p, i: F.concat_ws("", F.get(p, i - 2)["hit"], F.get(p, i - 1)["gap"], F.get(p, i - 1)["hit"], F.get(p, i)["gap"])
    pairs = let(F.split(text, pattern, -1), lambda gaps: F.filter(F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit")), lambda x: x["hit"].isNotNull()))
    whole = lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("long")
    zero = F.lit(0).cast("long")

    def chunked(p: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda c: F.slice(p, c * CHUNK + 1, CHUNK))
        return let(chunks, lambda cs: let(F.transform(cs, lambda x: F.aggregate(x, zero, lambda a, y: a + whole(y))), lambda sums: F.flatten(F.transform(cs, lambda x, k: located(x, F.aggregate(F.slice(sums, 1, k), zero, lambda a, y: a + y))))))

    def located(x: Column, begin: Column) -> Column:
        none = F.array().cast("array<struct<s:bigint,e:bigint,m:string,before:string>>")
        step = lambda a, y: F.struct(
            (a["at"] + whole(y)).alias("at"),
            F.array_append(a["out"], F.struct((a["at"] + F.length(y["gap"])).alias("s"), (a["at"] + whole(y)).alias("e"), y["hit"].alias("m"), y["before"].alias("before"))).alias("out"),
        )
        return F.aggregate(x, F.struct(begin.alias("at"), none.alias("out")), step)["out"]

    empty = F.array().cast("array<struct<s:bigint,e:bigint,m:string,before:string>>")
    context = lambda p, i: two_words(near(p, i)) if words else F.lit("")
    pairs = let(pairs, lambda p: F.transform(p, lambda x, i: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), context(p, i).alias("before"))))
    return let(pairs, lambda p: F.when(F.size(p) > 0, chunked(p)).otherwise(empty))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    turned = F.reverse(number)
    at = lambda i: F.substring(turned, i, F.lit(1)).cast("int")
    double = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, double(at(i))).otherwise(at(i)))
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e>> of the base spans, k being the number of the kind; sorted by start, then kind."""

    def of(kind: int, pattern: str, possible: Column, valid) -> Column:
        none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")
        kept = lambda: F.transform(F.filter(matches(text, pattern), lambda x: valid(x["m"])), lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))
        return F.when(possible, kept()).otherwise(none)

    numbers = lambda x, low, high: F.length(digits(x)).between(low, high)
    return F.array_sort(
        F.concat(
            of(0, EMAIL, F.instr(text, "@") > 0, lambda m: F.lit(True)),
            of(1, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
            of(2, CARD, text.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"), lambda m: F.when(numbers(m, 14, 19), luhn(digits(m))).otherwise(False)),
            of(3, PHONE, F.instr(text, "+") > 0, lambda m: numbers(m, 10, 15)),
        )
    )


def _annotated(docs: DataFrame) -> DataFrame:
    """(_doc, text, _base, _tokens) of rows with a digit or @: base spans, and the tokens in question with their patterns."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.where(text.rlike("[0-9@]")).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_doc"), text.alias("text"))
    rows = rows.withColumn("_base", base_spans(F.col("text")))
    lead = lambda m: F.length(F.regexp_extract(m, "^[^A-Za-z0-9+]*", 0))
    core = lambda m: F.regexp_replace(m, r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$", "")
    # The instance of a token that opens a base span is the whole span; tokens inside a span are part of it.
    opened = lambda x: F.get(F.filter("_base", lambda b: (b["s"] >= x["s"]) & (b["s"] < x["e"])), F.lit(0))
    entity = lambda b: F.substring("text", (b["s"] + 1).cast("int"), (b["e"] - b["s"]).cast("int"))
    token = lambda x: F.struct(
        (x["s"] + lead(x["m"])).alias("s"), (x["s"] + lead(x["m"]) + F.length(core(x["m"]))).alias("e"), x["before"].alias("pattern"),
        F.coalesce(entity(opened(x)), core(x["m"])).alias("instance"), F.exists("_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])).alias("known"),
        F.exists("_base", lambda b: (b["s"] < x["s"]) & (x["s"] < b["e"])).alias("inside"),
    )
    tokens = F.filter(F.transform(matches(F.col("text"), TOKEN, True), token), lambda x: (x["pattern"] != "") & (x["instance"] != "") & ~x["inside"])
    return rows.withColumn("_tokens", tokens)


def _patterns(before: Column) -> Column:
    """The patterns of a token with these two words before it."""
    last = F.substring_index(before, " ", -1)
    return F.array_compact(F.array(before, F.when(last.rlike("[a-z].*[:=#]$"), last)))


def _shape(instance: Column) -> Column:
    return F.when(instance.rlike(SECRET), "key").otherwise(F.regexp_replace(F.regexp_replace(instance, "[^0-9@.:/+() _-]+", "a"), "[0-9]", "0"))


def _good_patterns(found: DataFrame) -> DataFrame:
    """(pattern, score) of the patterns that extract personal data."""
    tokens = found.select(F.explode("_tokens").alias("t")).select("t.pattern", "t.instance", (F.col("t.known") | F.col("t.instance").rlike(SECRET)).cast("double").alias("seed"))
    tokens = tokens.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    links = cut(tokens.select(F.explode(_patterns(F.col("pattern"))).alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    own = cut(links.groupBy("instance").agg(F.max("seed").alias("seed")).withColumn("shape", _shape(F.col("instance"))))
    scores = own.select("instance", "shape", "seed", F.col("seed").alias("score"))
    mean = (F.sum("score") / (F.count("*") + DOUBT)).alias("good")
    for _ in range(ROUNDS):
        patterns = cut(links.join(scores.select("instance", "score"), "instance").groupBy("pattern").agg(mean, F.count("*").alias("n")))
        shapes = scores.groupBy("shape").agg(mean).select("shape", (LIKENESS * F.col("good")).alias("like"))
        met = links.join(patterns, "pattern").groupBy("instance").agg(F.max("good").alias("good"))
        scores = cut(own.join(met, "instance").join(shapes, "shape").select("instance", "shape", "seed", F.greatest("seed", "good", "like").alias("score")))
    return patterns.where((F.col("good") >= GOOD) & (F.col("n") >= SUPPORT)).select("pattern", F.col("good").alias("score"))


def found_spans(docs: DataFrame) -> DataFrame:
    """(_doc, text, _base, _spans) of the rows of ``docs`` with a digit or @.

    _doc is the row without its text, _base and _spans are array<struct<s, k, e>>: the base spans and all spans, by start and kind.
    """
    found = cut(_annotated(docs).withColumn("_row", F.monotonically_increasing_id()))  # written, so the numbers stay
    good = _good_patterns(found)
    fresh = found.select("_row", F.explode("_tokens").alias("t")).where("NOT t.known").where(LIKELY.format("t.instance"))
    fresh = fresh.select("_row", F.explode(_patterns(F.col("t.pattern"))).alias("pattern"), "t.s", "t.e")
    more = fresh.join(good, "pattern").groupBy("_row").agg(F.collect_set(F.struct("s", F.lit(4).alias("k"), "e")).alias("_more"))
    spans = F.array_sort(F.concat("_base", F.coalesce("_more", F.array().cast("array<struct<s:bigint,k:int,e:bigint>>"))))
    return found.join(more, "_row", "left").select("_doc", "text", "_base", spans.alias("_spans"))


def _shown(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for all rows of ``docs(doc_id, text)``."""
    rows = docs.select("doc_id", "text")
    found = found_spans(rows)
    of = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long")
    some = found.select("_doc.doc_id", *[of(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])], F.sha2(_shown(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _shown(F.col("_spans")).alias("spans"))
    none = rows.where(~F.coalesce("text", F.lit("")).rlike("[0-9@]"))
    zero = F.lit(0).cast("long")
    return some.unionByName(none.select("doc_id", *[zero.alias(f"n_{name}") for name in KINDS[:4]], F.sha2(F.lit("").cast("binary"), 256).alias("base_sha256"), F.lit("").alias("spans")))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one, of the first kind."""
    found = found_spans(docs)
    kinds = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")

    def join(a: Column, x: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        both = F.struct(last["s"].alias("s"), last["k"].alias("k"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when((F.size(a) > 0) & (x["s"] < last["e"]), F.array_append(F.slice(a, 1, F.size(a) - 1), both)).otherwise(F.array_append(a, x))

    found = found.withColumn("_merged", F.aggregate("_spans", none, join))
    text = F.col("text")

    def cover(spans: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(spans, k - 1)["e"]).otherwise(F.lit(0))
        parts = F.transform(spans, lambda x, k: F.concat(F.substring(text, (before(k) + 1).cast("int"), (x["s"] - before(k)).cast("int")), F.get(kinds, x["k"])))
        rest = F.substring(text, (F.get(spans, F.size(spans) - 1)["e"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    masked = F.when(F.size("_merged") > 0, cover(F.col("_merged"))).otherwise(text)
    kept = found.select(*[masked.alias(c) if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
    return kept.unionByName(docs.where(~F.coalesce("text", F.lit("")).rlike("[0-9@]")))
