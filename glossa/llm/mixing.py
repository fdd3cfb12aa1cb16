"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Sources in order of code points (null last) weigh 1, 2, 3, 1, 2, 3 ... and share all words by weight; a target stops at
CEILING times its source's words, and what is above goes to the others by weight until none is above.  That fixed
point is min(ceiling, weight x level) for one level, which sorting the sources by ceiling / weight gives at once.

A source's target is met by whole epochs first - every document once each - and then by a fraction: documents in order
of their exponential keys, -ln(u) / quality, summed until the budget is reached.  The document at the edge is taken if
that comes closer to the budget.  Documents are never cut.  Keys are hashes of the doc_id, so reruns agree.

The prefix sums are two-level: keys fall into buckets by their logarithm (STEPS to an octave; whatever the weights are, a
bucket holds less than 0.07 % of the rows of a source), bucket totals are summed up for each source, and only the bucket
in which the budget ends is looked into: its different keys are summed up, and of the rows that share the key at the
edge - repeated rows, in a number without bound - as many are taken as fit, counted in SALTS parts.

Defined results: null text has size 0; documents without words are taken once per epoch and count nothing; a null
source is a source of its own; a null doc_id has the key of its text; equal rows are separate rows (their order among
themselves is open, but not what is taken of them together); different rows may share a doc_id; further columns,
whatever their names, are ignored here and kept by ``mix``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

CEILING, STEPS, SALTS = 3, 512, 1024
WORD = r"[^\x20\x09-\x0D]+"


def quality(text: Column) -> Column:
    """A document's weight in its source: 0.1 to 1, falling with the share of characters that prose hardly has."""
    n = F.length(text)
    plain = F.length(F.translate(text, "*#$%&|!<>{}[]=\\^~_@0123456789", ""))
    return F.when(n > 0, F.round(0.1 + 0.9 * plain / n, 6)).otherwise(F.lit(0.1))


def uniform(key: Column) -> Column:
    """A number above 0 and below 1 for a key, the same on every engine: 48 bits of its MD5 digest."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size) -> (source, source_size, target); one row per source comes in and goes out."""
    every = Window.partitionBy()
    weighed = sizes.withColumn("_w", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    weighed = weighed.withColumn("_cap", (ceiling * F.col("source_size")).cast("double")).withColumn("_all", F.sum("source_size").over(every).cast("double"))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    below = rising.rowsBetween(Window.unboundedPreceding, -1)
    from_here = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = weighed.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))) / F.sum("_w").over(from_here))
    # The first source, in rising order, whose ceiling is not reached sets the level of all that follow.
    level = level.withColumn("_free", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(every))
    level = level.withColumn("_at", F.col("_free").getField("_level"))
    return level.select("source", "source_size", F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_at") * F.col("_w"))).alias("target"))


def _mixed(docs: DataFrame, carried: Column) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, doc) with ``carried`` as doc."""
    text = F.coalesce("text", F.lit(""))
    key = -F.ln(uniform(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(text.cast("binary")))))) / quality(text)
    rows = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"), carried.alias("doc"))
    # Written, so the number of a row stays.
    rows = cut(rows.withColumn("bucket", F.floor(STEPS * F.log2("key")).cast("int")).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")))
    slim = rows.select("source", "size", "key", "bucket", "part")
    parts = cut(slim.groupBy("source", "bucket").agg(F.sum("size").alias("total")))
    plan = source_targets(parts.groupBy("source").agg(F.sum("total").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))

    def edge(sums: DataFrame, unit: str, plan: DataFrame) -> DataFrame:
        """``plan`` with the first unit (bucket, key, part) that does not go in whole, and with what goes before it."""
        ahead = F.coalesce(F.sum("total").over(Window.partitionBy("source").orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        base = F.col("ahead") if "ahead" in plan.columns else F.lit(0)
        sums = sums.withColumn("before", ahead).withColumnsRenamed({"source": "of"})
        both = plan.join(sums, plan["source"].eqNullSafe(sums["of"]), "left")
        over = base + F.col("before") + F.col("total") > F.col("budget")
        first = both.groupBy(*plan.columns).agg(F.min(F.when(over, F.struct(unit, "before"))).alias("first"))
        return first.select(*[c for c in plan.columns if c != "ahead"], F.col(f"first.{unit}").alias(f"last_{unit}"), (base + F.coalesce("first.before", F.lit(0))).alias("ahead"))

    plan = cut(edge(parts, "bucket", plan))
    near = slim.join(plan.select(F.col("source").alias("of"), "last_bucket"), F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("last_bucket"))).select("source", "size", "key", "part")
    plan = cut(edge(near.groupBy("source", "key").agg(F.sum("size").alias("total")), "key", plan))
    near = near.join(plan.select(F.col("source").alias("of"), "last_key"), F.col("source").eqNullSafe(F.col("of")) & (F.col("key") == F.col("last_key"))).select("source", "size", "part")
    plan = cut(edge(near.groupBy("source", "part").agg(F.sum("size").alias("total")), "part", plan)).withColumnRenamed("source", "of")
    # One row for each source; the row at the edge is taken if more than half of it fits.
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    place, last = F.struct("bucket", "key", "part"), F.struct(F.col("last_bucket").alias("bucket"), F.col("last_key").alias("key"), F.col("last_part").alias("part"))
    at = F.coalesce(place == last, F.lit(False))
    order = Window.partitionBy("source").orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.where(at).withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    fits = (F.col("ahead") + F.col("size") / 2 <= F.col("budget")) & (F.col("ahead") < F.col("budget"))
    whole = (F.col("budget") > 0) & F.when(F.col("last_bucket").isNull(), True).otherwise(place < last)
    out = edges.withColumn("more", fits).unionByName(rows.where(~at).withColumn("more", whole))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") + F.when(F.col("more"), 1).otherwise(0)).cast("long").alias("copies"), "doc")


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for all rows of ``docs(doc_id, text, source)``."""
    out = _mixed(docs, F.lit(None).cast("boolean"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``."""
    out = _mixed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns])).where("copies > 0")
    out = out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
