"""Probabilistic context-free grammars: induction from trees, CKY parsing, and the verdict on sentences."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BACKOFF, UNKNOWN, NEVER, PASSES = -12.0, -15.0, -100.0, 5


def read_tree(text: str) -> list:
    """A bracketed tree as nested lists [label, child, ...]; leaves are strings."""
    stack: list[list] = [[]]
    for t in re.findall(r"\(|\)|[^\s()]+", text):
        if t == "(":
            stack.append([])
        elif t == ")":
            done = stack.pop()
            stack[-1].append(done if done and isinstance(done[0], str) else ["", *done])
        else:
            stack[-1].append(t)
    tree = stack[0][0]
    return tree[1] if tree[0] == "" and len(tree) == 2 else tree


def normal_form(tree: list, markov: int = 2, root: bool = True) -> list:
    """Unary chains joined with + (not at the root, not above words), long rules binarised to the right."""
    label, kids = tree[0], tree[1:]
    if all(isinstance(k, str) for k in kids):
        return tree
    while not root and len(kids) == 1 and isinstance(kids[0], list) and not all(isinstance(k, str) for k in kids[0][1:]):
        label, kids = f"{label}+{kids[0][0]}", kids[0][1:]
    kids = [normal_form(k, markov, False) if isinstance(k, list) else k for k in kids]
    if len(kids) < 3:
        return [label, *kids]
    names = [k[0] if isinstance(k, list) else k for k in kids]

    def rest(i: int) -> list:
        if i == len(kids) - 1:
            return kids[i]
        return [f"{label}|<{'-'.join(names[i : i + markov])}>", kids[i], rest(i + 1)]

    return [label, kids[0], rest(1)]


def productions(tree: list) -> list[tuple[str, list[str], bool]]:
    """(left side, right side, whether it is lexical)."""
    kids = tree[1:]
    lexical = all(isinstance(k, str) for k in kids)
    out = [(tree[0], [k if isinstance(k, str) else k[0] for k in kids], lexical)]
    for k in kids:
        if isinstance(k, list):
            out += productions(k)
    return out


def rules(trees: DataFrame) -> DataFrame:
    """(lhs, rhs, lexical, c, p) by relative frequency from trees(tree string)."""

    @F.pandas_udf("array<struct<lhs:string,rhs:array<string>,lexical:boolean>>")
    def read(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [dict(zip(("lhs", "rhs", "lexical"), p)) for p in productions(normal_form(read_tree(t)))])

    # Equal trees are read once.
    different = trees.groupBy("tree").agg(F.count("*").alias("times"))
    counts = different.select("times", F.inline(read("tree"))).groupBy("lhs", "rhs", "lexical").agg(F.sum("times").alias("c"))
    total = counts.groupBy("lhs").agg(F.sum("c").alias("n"))
    return counts.join(total, "lhs").select("lhs", "rhs", "lexical", "c", (F.col("c") / F.col("n")).alias("p"))


class Parser:
    """CKY for rules (lhs, rhs, lexical, p).  Symbols are numbers, and a span's cell is an array of log-probabilities.

    All splits of a span and all binary rules are tried at once; where a score came from is found again while the one
    tree is read off, so no back-pointers are kept but for unary rules.
    """

    def __init__(self, rows: list[tuple[str, list[str], bool, float]], start: str = "S"):
        rows = sorted((lhs, tuple(rhs), lexical and len(rhs) == 1, math.log(p) if p > 0 else NEVER) for lhs, rhs, lexical, p in rows)
        self.start = start
        self.symbols = sorted({s for lhs, rhs, lexical, _ in rows for s in (lhs, *(() if lexical else rhs))} | {start, "NN"})
        self.number = {s: k for k, s in enumerate(self.symbols)}
        of = lambda n: [(self.number[lhs], *(self.number[x] for x in rhs), p) for lhs, rhs, lexical, p in rows if not lexical and len(rhs) == n]
        self.binary, self.unary = (tuple(np.array(c, float if k == n + 1 else np.int64) for k, c in enumerate(zip(*of(n)))) or tuple(np.zeros(0, np.int64) for _ in range(n + 2)) for n in (2, 1))
        self.words: dict[str, list[tuple[int, float]]] = {}
        for lhs, rhs, lexical, p in rows:
            if lexical:
                self.words.setdefault(rhs[0].lower(), []).append((self.number[lhs], p))

    def close(self, cell: np.ndarray, below: np.ndarray) -> None:
        """Unary rules, a few times over; ``below`` notes what a symbol was made from."""
        a, b, p = self.unary
        for _ in range(PASSES):
            score = cell[b] + p
            better = np.flatnonzero(score > cell[a])
            if not len(better):
                break
            for r in better:
                if score[r] > cell[a[r]]:
                    cell[a[r]], below[a[r]] = score[r], b[r]

    def parse(self, words: list[str], tags: list[str] | None = None) -> dict:
        n = len(words)
        if not n:
            return {"tree": None, "logp": None, "status": "empty"}
        # Tags that the grammar does not know have numbers of their own in this sentence.
        strange = sorted({t for t in tags or () if t} - set(self.symbols))
        symbols, number = self.symbols + strange, self.number | {s: len(self.symbols) + k for k, s in enumerate(strange)}
        chart = np.full((n, n + 1, len(symbols)), -np.inf)
        below = np.full(chart.shape, -1, np.int32)
        for i, w in enumerate(words):
            cell = chart[i, i + 1]
            for s, p in self.words.get(w.lower(), ()):
                cell[s] = max(cell[s], p)
            if tags and tags[i] and cell[number[tags[i]]] == -np.inf:
                cell[number[tags[i]]] = BACKOFF
            if not np.isfinite(cell).any():
                cell[number["NN"]] = UNKNOWN
            self.close(cell, below[i, i + 1])
        a, b, c, p = self.binary
        for width in range(2, n + 1):
            for i in range(n - width + 1):
                j, cell = i + width, chart[i, i + width]
                if len(a):
                    np.maximum.at(cell, a, (chart[i, i + 1 : j][:, b] + chart[i + 1 : j, j][:, c]).max(axis=0) + p)
                self.close(cell, below[i, j])
        top = chart[0, n]
        if not np.isfinite(top).any():
            return {"tree": None, "logp": None, "status": "unparseable"}
        whole = np.isfinite(top[number[self.start]])
        root = number[self.start] if whole else min(range(len(symbols)), key=lambda s: (-top[s], symbols[s]))
        return {"tree": self._tree(chart, below, symbols, words, 0, n, root), "logp": float(top[root]), "status": "parsed" if whole else "partial_parse"}

    def _tree(self, chart: np.ndarray, below: np.ndarray, symbols: list[str], words: list[str], i: int, j: int, sym: int) -> str:
        heads = []
        while below[i, j, sym] >= 0 and sym not in heads:
            heads.append(sym)
            sym = below[i, j, sym]
        if j == i + 1:
            inner = f"({symbols[sym]} {words[i]})"
        else:
            a, b, c, p = self.binary
            rules = np.flatnonzero(a == sym)
            score = chart[i, i + 1 : j][:, b[rules]] + chart[i + 1 : j, j][:, c[rules]] + p[rules]
            split, r = np.unravel_index(int(np.argmax(score)), score.shape)
            k, r = i + 1 + int(split), rules[r]
            inner = f"({symbols[sym]} {self._tree(chart, below, symbols, words, i, k, b[r])} {self._tree(chart, below, symbols, words, k, j, c[r])})"
        return "".join(f"({symbols[s]} " for s in heads) + inner + ")" * len(heads)


def parsed(rows: DataFrame, grammar: DataFrame, words: str = "words", tags: str | None = "tags") -> DataFrame:
    """Adds ``parse`` (tree, logp, status); the grammar's size does not depend on the rows."""
    sent = rows.sparkSession.sparkContext.broadcast(Parser([(r.lhs, list(r.rhs), r.lexical, r.p) for r in grammar.select("lhs", "rhs", "lexical", "p").collect()]))

    @F.pandas_udf("struct<tree:string,logp:double,status:string>")
    def run(w: pd.Series, t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.parse(list(x), list(y) if y is not None else None) for x, y in zip(w, t)], columns=["tree", "logp", "status"])

    return rows.withColumn("parse", run(words, tags if tags else F.lit(None).cast("array<string>")))


def verdict(status: Column, n: Column, pcfg: Column, trigram: Column, bigram: Column) -> tuple[Column, Column]:
    """Method and verdict: the rules in order, on averages per word."""
    rule = [
        ((status == "parsed") & (pcfg / n >= -11.0), "PCFG (Constituency)", "Grammatical (Valid Structure)"),
        (trigram / n >= -6.8, "Trigram LM", "Grammatical (Fluent Local Sequence)"),
        (status == "partial_parse", "PCFG (Partial)", "Marginally Grammatical"),
        (bigram / n >= -7.8, "Bigram LM", "Marginally Grammatical"),
    ]
    method, said = F.lit("Fallback N-Gram"), F.lit("Likely Ungrammatical / Outlier")
    for when, a, b in reversed(rule):
        method, said = F.when(when, a).otherwise(method), F.when(when, b).otherwise(said)
    return method, said


def split_sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"(?<=[.?!])\s+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b[A-Za-z0-9'-]+\b"), 0)
