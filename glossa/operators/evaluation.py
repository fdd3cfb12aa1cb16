"""Evaluation measures as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ends(words: Column) -> Column:
    """End offsets of the words, in characters without spaces; one running sum."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.array_append(a["out"], a["at"] + F.length(x)).alias("out"))
    return F.aggregate(words, none, step)["out"]


def spans(words: Column) -> Column:
    return F.transform(F.arrays_zip(ends(words).alias("e"), words.alias("w")), lambda x: F.struct((x["e"] - F.length(x["w"])).alias("s"), x["e"].alias("e")))


def f1(reference: Column, predicted: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two arrays as sets."""
    both, ref, got = F.size(F.array_intersect(reference, predicted)), F.size(F.array_distinct(reference)), F.size(F.array_distinct(predicted))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return zero(both, got), zero(both, ref), zero(2 * both, ref + got)


def confusion(pairs: DataFrame) -> DataFrame:
    """(gold, pred, n) of wrong pairs."""
    return pairs.where("gold <> pred").groupBy("gold", "pred").agg(F.count("*").alias("n"))


def confusion_cells(counts: DataFrame, top: int = 10) -> DataFrame:
    """(gold, pred, n) for every two of the tags with most errors in row and column; 0 where there is none."""
    both = counts.select(F.col("gold").alias("tag"), "n").unionByName(counts.select(F.col("pred").alias("tag"), "n"))
    tags = both.groupBy("tag").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tag").limit(top).select("tag")
    grid = tags.select(F.col("tag").alias("gold")).join(F.broadcast(tags.select(F.col("tag").alias("pred"))))  # top x top cells
    return grid.join(counts, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_grid(counts: DataFrame, top: int = 10) -> DataFrame:
    """``confusion_cells`` with a column for each predicted tag."""
    cells = confusion_cells(counts, top)
    tags = sorted(r[0] for r in cells.select("gold").distinct().collect())
    return cells.groupBy("gold").pivot("pred", tags).agg(F.sum("n")).na.fill(0) if tags else cells.select("gold")


def confusion_markdown(counts: DataFrame, top: int = 10) -> str:
    """The grid as a Markdown table, rows in order of the tags; a sentence if there are no errors."""
    grid = confusion_grid(counts, top)
    rows = sorted(tuple(r) for r in grid.collect())  # top x top cells
    if not rows:
        return "No errors."
    head = ["gold \\ predicted", *grid.columns[1:]]
    return "\n".join("| " + " | ".join(map(str, r)) + " |" for r in [head, ["---"] * len(head), *rows])


def attachment(gold: DataFrame, predicted: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """(n, uas, las) of (key, dep, head, label) rows; what is missing counts as attached to the root by ``dep``.

    ``strict``: what is missing is wrong.
    """
    got = predicted.select(key, "dep", F.col("head").alias("h"), F.col("label").alias("l"))
    both = gold.join(got, [key, "dep"], "left")
    h, l = (F.coalesce("h", F.lit(-1)), F.coalesce("l", F.lit(""))) if strict else (F.coalesce("h", F.lit(0)), F.coalesce("l", F.lit("dep")))
    head = h == F.col("head")
    return both.agg(F.count("*").alias("n"), F.avg(head.cast("double")).alias("uas"), F.avg((head & (l == F.col("label"))).cast("double")).alias("las"))


def pipeline_errors(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """(correct, genuine, segmentation) of (key, s, e, tag) spans."""
    both = gold.join(predicted.withColumnRenamed("tag", "got"), [key, "s", "e"], "left")
    count = lambda c: F.count(F.when(c, 1))
    return both.agg(count(F.col("got") == F.col("tag")).alias("correct"), count(F.col("got") != F.col("tag")).alias("genuine"), count(F.col("got").isNull()).alias("segmentation"))


def error_shares(errors: DataFrame) -> DataFrame:
    """Adds the shares of ``pipeline_errors`` among all errors, in percent."""
    wrong = F.col("genuine") + F.col("segmentation")
    share = lambda c: F.coalesce(F.try_divide(100.0 * F.col(c), wrong), F.lit(0.0))
    return errors.select("*", share("genuine").alias("genuine_pct"), share("segmentation").alias("segmentation_pct"))


def segmentation_summary(rows: DataFrame, reference: Column, predicted: Column) -> DataFrame:
    """(n, prec, rec, f1, exact): means over the rows in percent, for boundaries; exact: all words are right."""
    p, r, f = f1(ends(reference), ends(predicted))
    mean = lambda c: F.coalesce(100.0 * F.avg(c.cast("double")), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), mean(p).alias("prec"), mean(r).alias("rec"), mean(f).alias("f1"), mean(reference == predicted).alias("exact"))


def tagging_accuracy(pairs: DataFrame) -> DataFrame:
    """(n, accuracy, known, accuracy_known, accuracy_oov) of rows (gold, pred, known)."""
    ok = (F.col("gold").eqNullSafe(F.col("pred"))).cast("double")
    return pairs.agg(F.count("*").alias("n"), F.avg(ok).alias("accuracy"), F.count(F.when(F.col("known"), 1)).alias("known"), F.avg(F.when(F.col("known"), ok)).alias("accuracy_known"), F.avg(F.when(~F.col("known"), ok)).alias("accuracy_oov"))
