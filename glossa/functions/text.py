"""Column functions on words and texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that context correction leaves alone.
PROTECTED = [
    "a", "i", "the", "in", "on", "at", "to", "me", "it", "is", "be", "as", "of", "or", "and",
    "by", "for", "with", "he", "she", "we", "my", "so", "an", "us", "if", "no", "not", "do",
]
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_tokens(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, strip), lambda t: t != "")


def alnum_core(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N}]", "")


def tail(x: Column) -> Column:
    return F.regexp_replace(x, r"[\p{L}\p{N}]", "")


def context_clean(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}_]", ""))


def capitalized(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))


def restore_case(word: Column, model: Column) -> Column:
    first = F.substring(model, 1, 1)
    return F.when((F.upper(model) == model) & (F.lower(model) != model), F.upper(word)).when((F.upper(first) == first) & (F.lower(first) != first), capitalized(word)).otherwise(F.lower(word))


def _over(n: Column, low: int, body) -> Column:
    """``body`` of the places low .. n; no rows where n < low (a descending sequence is never made)."""
    return F.when(n >= low, F.transform(F.sequence(F.lit(low), F.greatest(n, F.lit(low))), body)).otherwise(F.array().cast("array<string>"))


def _part(w: Column, start, length) -> Column:
    return F.substring(w, start if isinstance(start, Column) else F.lit(start), length if isinstance(length, Column) else F.lit(length))


def deletes(w: Column) -> Column:
    return _over(F.length(w), 1, lambda i: F.concat(_part(w, 1, i - 1), _part(w, i + 1, F.length(w))))


def swaps(w: Column) -> Column:
    return _over(F.length(w) - 1, 1, lambda i: F.concat(_part(w, 1, i - 1), _part(w, i + 1, 1), _part(w, i, 1), _part(w, i + 2, F.length(w))))


def edits1(w: Column) -> Column:
    """All words one a-z edit away, the word itself included."""
    letters = F.array(*[F.lit(c) for c in LETTERS])
    put = lambda low, skip, n: F.flatten(
        F.transform(F.sequence(F.lit(low), n), lambda i: F.transform(letters, lambda c: F.concat(_part(w, 1, i - 1), c, _part(w, i + skip, F.length(w)))))
    )
    replaced = F.when(F.length(w) > 0, put(1, 1, F.greatest(F.length(w), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(deletes(w), swaps(w), replaced, put(1, 0, F.length(w) + 1)))


def variants(w: Column) -> Column:
    """Keys of the symmetric-delete index: the word and every deletion."""
    return F.array_distinct(F.concat(F.array(w), deletes(w)))


def within_one(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein distance of at most 1."""
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & F.array_contains(swaps(a), b))


def osa_distance(a: Column, b: Column) -> Column:
    """Edits between two words: insertions, deletions, replacements and swaps of neighbours; no letter is edited twice."""

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s: str, t: str) -> int:
            older, old = [], [*range(len(t) + 1)]
            for i, c in enumerate(s, 1):
                new = [i]
                for j, d in enumerate(t, 1):
                    best = min(old[j] + 1, new[-1] + 1, old[j - 1] + (c != d))
                    if i > 1 and j > 1 and c == t[j - 2] and s[i - 2] == d:
                        best = min(best, older[j - 2] + 1)
                    new.append(best)
                older, old = old, new
            return old[-1]

        return pd.Series([None if s is None or t is None else one(s, t) for s, t in zip(x, y)])

    return distance(a, b)


def draw(seed: int, *key: Column) -> Column:
    """A number in [0, 1) for a key; the same on every engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def word_features(w: Column) -> Column:
    """Suffixes, prefixes and shape of a word."""
    low, n, first, rest = F.lower(w), F.length(w), F.substring(w, 1, 1), F.substring(w, F.lit(2), F.length(w))
    cased = lambda x: F.upper(x) != F.lower(x)
    ends = [F.when(n > k, F.concat(F.lit("suf_"), F.right(low, F.lit(k)))) for k in (1, 2, 3, 4)]
    heads = [F.when(n > k + 1, F.concat(F.lit("pref_"), F.left(low, F.lit(k)))) for k in (2, 3)]
    shape = (
        F.when((F.upper(w) == w) & cased(w) & (n > 1), "shape_all_caps")
        .when((F.upper(first) == first) & cased(first) & ((n == 1) | ((F.lower(rest) == rest) & cased(rest))), "shape_capitalized")
        .when((F.lower(w) == w) & cased(w), "shape_all_lower")
    )
    marks = [F.when(w.rlike(r"\p{Nd}"), "shape_has_digit"), F.when(F.instr(w, "-") > 0, "shape_has_hyphen")]
    return F.array_compact(F.array(*ends, *heads, *marks, shape))
