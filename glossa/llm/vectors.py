"""What both vector searches share: usable vectors, and equal vectors as one class with its smallest ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of vectors that are neither null, empty nor zero and hold only finite numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").where((F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0))


def first_ids(rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The ``keep`` rows of smallest vec_id (null last) for each key, numbered by _n.

    Spark cuts the groups before the shuffle as well (window group limit), so a class with a third of all rows sends
    ``keep`` rows from each task and is never gathered.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("vec_id").asc_nulls_last())
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep)
