"""Sentences, tokens and splits."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 4096
MOST = 5_000_000  # rows of a model that may be collected and broadcast
FEW = 500_000  # keys that are broadcast to a larger table, so that only its rows with these keys are shuffled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the folder that spark.checkpoint.dir names, and read back.

    A local session that names none gets a folder of its own.  Whoever owns the folder may delete glossa-<application id>
    in it when the application has ended.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = stored.own = getattr(stored, "own", None) or "file://" + tempfile.mkdtemp(prefix="glossa-")
    path = f"{base.rstrip('/')}/glossa-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collected(df: DataFrame, most: int = MOST) -> list:
    """The rows of a table that is to be broadcast; an error, before anything is collected, if it has more than ``most``."""
    rows = stored(df)  # counted and then read, not made twice
    n = rows.count()
    if n > most:
        raise ValueError(f"{n} rows are too many to collect and broadcast (at most {most}): train on fewer sentences")
    return rows.collect()


def narrowed(rows: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is among those asked for; up to FEW keys are broadcast, so ``rows`` are not shuffled."""
    keys = stored(asked.select(*on).distinct())
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, on, "left_semi")


def state_of(spark: SparkSession, path: str) -> tuple:
    """What tells one content of a folder or file from another: its size and its last change."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return path, fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()


def first_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows in the order of a key; Spark cuts every task's rows before it merges them."""
    return rows.orderBy(key).limit(n)


def sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, w): the lower-cased words of every line that has any."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line", "said"))
    return lines.select(key, (F.col("line") + 1).cast("long").alias("line"), F.regexp_extract_all(F.lower("said"), F.lit(r"\p{L}+"), 0).alias("w")).where(F.size("w") > 0)


def words(sents: DataFrame) -> DataFrame:
    return sents.select(F.explode("w").alias("w"))


def vocabulary(sents: DataFrame) -> DataFrame:
    return words(sents).groupBy("w").agg(F.count("*").alias("c"))


def ordered_prefix(rows: DataFrame, key: str, ratio: float) -> DataFrame:
    """The first floor(ratio x n) rows in the order of an integer key that is unique.

    Rows are counted in buckets of the key's range; only the bucket in which the prefix ends is ranked.
    """
    low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    if not n:
        return rows
    width = max(1, -(-(high - low + 1) // BUCKETS))
    counts = dict(rows.groupBy(F.floor((F.col(key) - low) / width).alias("b")).count().collect())  # at most BUCKETS rows
    left, edge = int(ratio * n), 0
    for edge in sorted(counts):
        if left <= counts[edge]:
            break
        left -= counts[edge]
    start = low + edge * width
    inside = rows.where(F.col(key).between(start, start + width - 1)).select(key, F.row_number().over(Window.orderBy(key)).alias("_n")).where(F.col("_n") <= left)
    last = inside.agg(F.max(key)).first()[0]
    return rows.where(F.col(key) <= (start - 1 if last is None else last))
