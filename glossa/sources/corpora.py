"""Loading corpora in order, and models as folders of Parquet tables that are built once and read by any session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_tokens
from ..operators import lm, spelling
from ..operators.corpus import first_rows, ordered_prefix

PARTS = ["words", "marked", "pairs", "triples"]


def tidy(sents: DataFrame, fewest: int = 1, plain: bool = False) -> DataFrame:
    """Rows with tokens ``w`` stripped and empty ones dropped; ``plain``: words of letters only, in lower case."""
    w = clean_tokens(F.col("w"))
    if plain:
        w = F.transform(F.filter(w, lambda x: x.rlike(r"^\p{L}+$")), lambda x: F.lower(x))
    return sents.withColumn("w", w).where(F.size("w") >= fewest)


def split(sents: DataFrame, key: str, ratio: float = 0.8, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The first part and the rest, in the order of an integer key; of the first ``most`` rows if that is given."""
    rows = sents if most is None else first_rows(sents, key, most)
    head = ordered_prefix(rows, key, ratio)
    return head, rows.join(head.select(key), key, "left_anti")


def words_after(sents: DataFrame, key: str, skip: int, n: int) -> DataFrame:
    """(key, pos, w): the first ``n`` words after the first ``skip`` sentences, in order."""
    rows = sents.orderBy(key).offset(skip).select(key, F.posexplode("w").alias("pos", "w"))
    return rows.orderBy(key, "pos").limit(n)


def build_models(sents: DataFrame, folder: str) -> None:
    """Writes the counts of training sentences and the deletion index of their words under ``folder``."""
    made = lm.Tables(sents)
    for part in PARTS:
        getattr(made, part).write.mode("overwrite").parquet(f"{folder}/{part}")
    words = sents.sparkSession.read.parquet(f"{folder}/words")
    spelling.index(words).write.mode("overwrite").parquet(f"{folder}/index")


def load_models(spark: SparkSession, folder: str) -> lm.Tables:
    """The counts that ``build_models`` wrote, for every score that takes ``Tables``."""
    out = lm.Tables(None)
    for part in PARTS:
        out.__dict__[part] = spark.read.parquet(f"{folder}/{part}")
    return out
