"""Transition-based dependency parsing: static oracle, features, a linear classifier and the greedy parser."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD, ROOT, LONG = "<PAD>", "<ROOT>", 10
STEP = "struct<step:int,names:array<string>,stack:int,buffer:int,transition:string>"


class State:
    """Stack, buffer and arcs; token 0 is the root."""

    def __init__(self, n: int):
        self.stack, self.next, self.n, self.arcs = [0], 1, n, []

    @property
    def buffered(self) -> int:
        return self.n - self.next + 1

    def legal(self, move: str) -> bool:
        if move == "SHIFT":
            return self.buffered > 0
        return len(self.stack) > 1 and (move.startswith("RIGHT") or self.stack[-2] != 0)

    def apply(self, move: str) -> None:
        """Makes a legal move; an illegal one changes nothing."""
        if not self.legal(move):
            return
        kind, _, label = move.partition(":")
        if kind == "SHIFT":
            self.stack.append(self.next)
            self.next += 1
        else:
            dep = self.stack.pop(-2 if kind == "LEFT-ARC" else -1)
            self.arcs.append((self.stack[-1], label or "dep", dep))

    @property
    def done(self) -> bool:
        return not self.buffered and len(self.stack) < 2

    def tags(self, tags: list[str]) -> list[str]:
        """The tags of the two upper words of the stack and the two next ones; NULL where there is none."""
        s = [self.stack[-1 - k] if len(self.stack) > k else None for k in (0, 1)]
        b = [self.next + k if self.buffered > k else None for k in (0, 1)]
        return [f"{p}={'NULL' if k is None else tags[k]}" for p, k in zip(("s0", "s1", "b0", "b1"), s + b)]

    def features(self, forms: list[str], tags: list[str]) -> tuple[list[str], int, int]:
        """One-hot names of 4 tags, 4 forms and 3 tag pairs, and the lengths of stack and buffer (at most LONG)."""
        at = lambda x, k: x[k] if k is not None else PAD
        s = [self.stack[-1 - k] if len(self.stack) > k else None for k in (0, 1)]
        b = [self.next + k if self.buffered > k else None for k in (0, 1)]
        t = [at(tags, k) for k in s + b]
        names = [f"{p}_pos={x}" for p, x in zip(("s0", "s1", "b0", "b1"), t)] + [f"{p}_form={at(forms, k).lower()}" for p, k in zip(("s0", "s1", "b0", "b1"), s + b)]
        names += [f"s0_s1={t[0]}|{t[1]}", f"s0_b0={t[0]}|{t[2]}", f"s1_s0_b0={t[1]}|{t[0]}|{t[2]}"]
        return names, min(len(self.stack), LONG), min(self.buffered, LONG)


def oracle(heads: list[int], labels: list[str], forms: list[str], tags: list[str], strict: bool = False, tags_only: bool = False) -> list[tuple]:
    """(step, names, stack, buffer, transition) that build the tree; stuck trees are forced to the right.

    ``strict``: a left arc waits for all children too, and a tree that cannot be built ends the list.
    ``tags_only``: the names are four tags.
    """
    n = len(heads)
    head = [-1, *heads]
    label = ["", *labels]
    state, out = State(n), []
    forms, tags = [ROOT, *forms], [ROOT, *tags]
    missing = np.bincount([h for h in heads if 0 <= h <= n], minlength=n + 1)
    for step in range(4 * n + 10):
        if state.done:
            break
        move = "SHIFT"
        if len(state.stack) > 1:
            below, top = state.stack[-2:]
            if below and head[below] == top and (not strict or not missing[below]):
                move = f"LEFT-ARC:{label[below]}"
            elif head[top] == below and not missing[top]:
                move = f"RIGHT-ARC:{label[top]}"
            elif not state.buffered:
                if strict:
                    break
                move = f"RIGHT-ARC:{label[top]}"
        names, stack, buffer = state.features(forms, tags)
        out.append((step, state.tags(tags) if tags_only else names, stack, buffer, move))
        before = len(state.arcs)
        state.apply(move)
        if len(state.arcs) > before and 0 <= head[state.arcs[-1][2]] <= n:
            missing[head[state.arcs[-1][2]]] -= 1
    return out


def transitions(trees: DataFrame, key: str, strict: bool = False, tags_only: bool = False) -> DataFrame:
    """(key, step, names, stack, buffer, transition) of trees(key, tokens)."""

    @F.pandas_udf(f"array<{STEP}>")
    def steps(tokens: pd.Series) -> pd.Series:
        def one(ts) -> list[dict]:
            rows = oracle([t["head"] for t in ts], [t["deprel"] for t in ts], [t["form"] for t in ts], [t["upos"] for t in ts], strict, tags_only)
            return [dict(zip(("step", "names", "stack", "buffer", "transition"), r)) for r in rows]

        return tokens.map(one)

    return trees.select(key, F.inline(steps("tokens")))


class Classifier:
    """Multinomial logistic regression over one-hot names and two numbers, held as numpy arrays."""

    def __init__(self, steps: DataFrame, max_iter: int = 250, c: float = 1.0):
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import CountVectorizer, StringIndexer, VectorAssembler

        n = max(1, steps.count())
        parts = [
            CountVectorizer(inputCol="names", outputCol="hot", binary=True, minDF=1.0, vocabSize=1 << 20),
            VectorAssembler(inputCols=["hot", "stack", "buffer"], outputCol="x"),
            StringIndexer(inputCol="transition", outputCol="y"),
            LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", standardization=False, regParam=1.0 / (c * n), maxIter=max_iter),
        ]
        model = Pipeline(stages=parts).fit(steps.cache())
        self.place = {w: k for k, w in enumerate(model.stages[0].vocabulary)}
        self.classes = list(model.stages[2].labels)
        self.weights, self.bias = model.stages[3].coefficientMatrix.toArray(), model.stages[3].interceptVector.toArray()
        steps.unpersist()

    def ranked(self, names: list[str], stack: int, buffer: int) -> list[str]:
        hot = [self.place[x] for x in names if x in self.place]
        s = self.bias + self.weights[:, hot].sum(axis=1) + self.weights[:, -2] * stack + self.weights[:, -1] * buffer
        return [self.classes[k] for k in np.argsort(-s, kind="stable")]


def parse(model: Classifier, forms: list[str], tags: list[str], repair: bool = True) -> list[tuple[int, str, int]]:
    """Arcs (head, label, dependent); a token left over hangs on the root.

    Without ``repair`` the first illegal move that the model prefers ends the parse, and tokens left over have no arc.
    """
    n = len(forms)
    state, forms, tags = State(n), [ROOT, *forms], [ROOT, *tags]
    for _ in range(4 * n + 10):
        if state.done:
            break
        ranked = model.ranked(*state.features(forms, tags))
        if not repair and not (ranked and state.legal(ranked[0])):
            break
        state.apply(next((m for m in ranked if state.legal(m)), "SHIFT" if state.buffered else "RIGHT-ARC:dep"))
    found = {d: (h, x, d) for h, x, d in state.arcs}
    return [found.get(k, (0, "root", k)) for k in range(1, n + 1) if repair or k in found]


def parsed(trees: DataFrame, model: Classifier) -> DataFrame:
    """Adds ``arcs`` to rows with tokens; one row stays one row, so nothing is shuffled."""
    sent = trees.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<head:int,label:string,dep:int>>")
    def arcs(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: [dict(zip(("head", "label", "dep"), a)) for a in parse(sent.value, [t["form"] for t in ts], [t["upos"] for t in ts])])

    return trees.withColumn("arcs", arcs("tokens"))


def tree_lines(rows: DataFrame, key: str) -> DataFrame:
    """(key, dep, line): one text line for each token of rows(key, tokens, arcs).

    A token without an arc hangs on the root by ``root``; a head that is no token is <UNK>.
    """
    tokens = rows.select(key, F.inline(F.transform("tokens", lambda t: F.struct(t["id"].alias("dep"), t["form"].alias("form"), t["upos"].alias("upos")))))
    arcs = rows.select(key, F.inline("arcs")).select(key, "dep", "head", "label")
    heads = tokens.select(key, F.col("dep").alias("head"), F.col("form").alias("head_form"))
    out = tokens.join(arcs, [key, "dep"], "left").withColumn("head", F.coalesce("head", F.lit(0))).join(heads, [key, "head"], "left")
    named = F.when(F.col("head") == 0, "ROOT").otherwise(F.coalesce("head_form", F.lit("<UNK>")))
    return out.select(key, "dep", F.format_string("%-4d %-15s %-6s %4d %-15s %s", "dep", "form", "upos", "head", named, F.coalesce("label", F.lit("root"))).alias("line"))
