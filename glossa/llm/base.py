"""Shared plumbing of the training-data operators: scratch tables, safe identifiers, connected components."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  A folder of our own only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if (own := getattr(scratch_dir, "own", None)) is None:
        own = scratch_dir.own = "file://" + tempfile.mkdtemp(prefix="glossa-")
    return own


BATCH = 2000  # rows of an Arrow batch while a table is written: bounds what a Python worker and its task hold
PARTS = 4096  # a key with more than 1 / PARTS of all rows is spread; at most PARTS keys are that frequent


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Ends the lineage, so a lost executor costs one read and not a recomputation, and gives the optimizer true sizes
    for its choice between broadcast and shuffle.  All tables of an application lie in one folder, glossa-<its id>,
    which whoever owns the shared folder may delete when the application has ended.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/glossa-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what ``cut`` wrote for ``df``; for tables of a loop that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def frequent(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _parts) of the keys with more than 1 / PARTS of all rows; at most PARTS rows, so fit to be broadcast.

    A part has at least 256 rows.
    """
    return frequent_of(rows.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "_n")


def frequent_of(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``frequent`` from a table that holds each key once with its number of rows."""
    total = counts.agg(F.sum(n).alias("_all"))
    hot = counts.where(F.col(n) > 256).join(F.broadcast(total)).where(F.col(n) * PARTS > F.col("_all"))
    parts = F.least(F.ceil(F.col(n) * PARTS / F.col("_all")), F.ceil(F.col(n) / 256))
    return cut(hot.select(*keys, parts.cast("int").alias("_parts")).where("_parts > 1"))


def any_frequent(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """``frequent``, or None if no key is."""
    return any_frequent_of(rows.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "_n")


def any_frequent_of(counts: DataFrame, keys: list[str], n: str) -> DataFrame | None:
    """``frequent_of``, or None if no key is: of most tables this takes one row to tell, and no table is written."""
    most, total = counts.agg(F.max(n), F.sum(n)).first()
    return frequent_of(counts, keys, n) if most is not None and most > 256 and most * PARTS > total else None


def salted(rows: DataFrame, hot: DataFrame, keys: list[str], by: str | list[str]) -> DataFrame:
    """``rows`` with _salt: rows of a frequent key are dealt over its parts by the hash of the columns ``by``."""
    parts, by = F.coalesce("_parts", F.lit(1)), [by] if isinstance(by, str) else by
    return rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")


def repeated(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with _salt: once for each part of their key.  An equi-join with ``salted`` rows gathers no frequent key."""
    return rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")


def spread(rows: DataFrame, hot: DataFrame | None, keys: list[str], by: str | list[str], other: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``other`` by the keys; rows of a frequent key are dealt over its parts by the hash of the columns ``by``.

    Without frequent keys it is a plain join.  Every broadcast takes the driver some megabytes until its garbage is
    collected, and a loop of many small queries makes them faster than that.
    """
    if hot is None:
        return rows.join(other, keys, how)
    return salted(rows, hot, keys, by).join(repeated(other, hot, keys), [*keys, "_salt"], how).drop("_salt")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def frugal(work):
    """``work`` of ``mapInArrow``, giving memory back to the system now and then and when its task ends.

    Python workers are used again by later tasks, of other operators too, and would keep what their largest batch took.
    """

    def run(batches):
        try:
            for k, out in enumerate(work(batches), 1):
                yield out
                if not k % 16:
                    _release()
        finally:
            _release()

    return run


def _release() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (a, b) long pairs -> (node, comp), comp being the smallest node.

    Alternating large-star and small-star steps.  Every step is an aggregation with map-side combine and one join, so
    a hub with most of the edges is never gathered in one task; the number of steps is logarithmic in the diameter.
    """

    def minima(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("low"))

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = minima(both).select("u", F.least("u", "low").alias("low"))
        out = both.join(low, "u").where("v > u and v <> low").select(F.col("v").alias("a"), F.col("low").alias("b"))
        return out.distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = minima(down)
        out = down.join(low, "u").where("v <> low").select(F.col("v").alias("a"), F.col("low").alias("b"))
        return out.unionByName(low.select(F.col("u").alias("a"), F.col("low").alias("b"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(now)
    while before[0]:
        old, now = now, cut(small(large(now)))
        discard(old)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()


def forest_roots(parents: DataFrame) -> DataFrame:
    """Roots of a forest: (a, b) long, b being the one parent of a -> (node, comp) for all that have a parent.

    Pointer jumping: every step is one join and halves the depth.  The pairs must hold no cycle.
    """
    now = cut(parents.select(F.col("a").alias("node"), F.col("b").alias("comp"), F.lit(True).alias("moved")))
    while now.where("moved").take(1):
        above = now.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        both = spread(now, any_frequent(now, ["comp"]), ["comp"], "node", above, "left")
        old, now = now, cut(both.select("node", F.coalesce("next", "comp").alias("comp"), F.col("next").isNotNull().alias("moved")))
        discard(old)
    return now.select("node", "comp")


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after joining the components of every link (ca, cb).

    A node that ``comps`` does not list is a component of its own.  Only the links between components are searched,
    which are few when ``comps`` is nearly complete.
    """
    links = cut(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if not links.take(1):
        return comps
    joined = connected_components(links).withColumnRenamed("comp", "whole")
    moved = comps.join(joined.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("whole", "comp").alias("comp"))
    own = joined.select("node", F.col("whole").alias("comp"))
    return cut(moved.unionByName(own.join(comps.select("node"), "node", "left_anti")))
