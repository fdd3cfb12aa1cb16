"""Exact top-k search over binary codes by incremental multi-index hashing, in DataFrame operations.

A code is one or more words of 64 bits, each cut into segments of 16 bits, and the index holds each code under each of its
segments.  In round r a query looks up, for every segment, the values at Hamming distance exactly r from its own.  After
round r every code within distance (number of segments) x (r + 1) - 1 has been met (pigeonhole), so a query is done once
its kth verified distance is no larger; the others go on.  A code is met in the round of its best segment and taken under
the first such segment, so every pair is verified once.

Equal codes are one entry with their smallest ids, so one code with a third of all rows is compared once; its queries
share one list.  A segment value that very many codes share is dealt over many tasks, and the probes for it with it.

Defined results: codes are the signs of ``embedding``, a component that a shorter vector lacks counting as not positive
(null, empty, zero and non-finite vectors and rows without vec_id take no part); ties go to the smaller vec_id; fewer than
k other rows give all of them; repeated ids are repeated candidates; further columns, whatever their names, are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, frequent, repeated, salted
from .vectors import first_ids, usable

BITS, WIDE = 64, 16


def sign_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code0, code1, ...): bit i of word w is set where component 64 w + i is positive."""
    rows = usable(vectors).where("vec_id is not null")
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    words = []
    for w in range(-(-longest // BITS)):
        code = F.lit(0).cast("long")
        for i in range(BITS):
            bit = F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")
            code = code.bitwiseOR(F.when(F.get("embedding", F.lit(BITS * w + i)) > 0, bit).otherwise(F.lit(0).cast("long")))
        words.append(code.alias(f"code{w}"))
    return rows.select("vec_id", *words)


def _segments(names: list[str]) -> list:
    return [F.shiftrightunsigned(F.col(c), s).bitwiseAND(F.lit((1 << WIDE) - 1)) for c in names for s in range(0, BITS, WIDE)]


def top_k(codes: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, distance) of the k rows of ``codes(vec_id, code0, ...)`` nearest to each of ``queries(vec_id)``."""
    spark = codes.sparkSession
    names = [c for c in codes.columns if c != "vec_id"]
    asks = [f"query{w}" for w in range(len(names))]
    rows = cut(codes)
    total = rows.count()
    asked = cut(rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi"))
    members = cut(first_ids(rows, names, k + 1).select(*names, "vec_id", "_n"))
    weight = members.groupBy(*names).agg(F.max("_n").alias("n"), F.min("vec_id").alias("low"))
    index = cut(weight.select(*names, "n", "low", F.posexplode(F.array(*_segments(names))).alias("seg", "value")))
    hot = frequent(index, ["seg", "value"])
    index = salted(index, hot, ["seg", "value"], names)
    open_ = cut(asked.select(*[F.col(c).alias(q) for c, q in zip(names, asks)]).distinct())
    best = spark.createDataFrame([], ", ".join(f"{c} long" for c in asks + names) + f", distance int, n int, low {codes.schema['vec_id'].dataType.simpleString()}")
    done = best
    apart = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(_segments(asks), _segments(names))]
    distance = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(asks[1:], names[1:])), F.bit_count(F.col(asks[0]).bitwiseXOR(F.col(names[0]))))
    for r in range(WIDE + 1):
        masks = [sum(1 << b for b in bits) for bits in combinations(range(WIDE), r)]
        own = open_.select(*asks, F.posexplode(F.array(*_segments(asks))).alias("seg", "mine"))
        # The same masks for every query: at most 12,870 numbers, in one array literal.
        probes = own.select(*asks, "seg", "mine", F.explode(F.from_json(F.lit(str(masks)), "array<long>")).alias("mask"))
        probes = repeated(probes.select(*asks, "seg", F.col("mine").bitwiseXOR(F.col("mask")).alias("value")), hot, ["seg", "value"])
        # Spark would take the probes for as small as the queries they are made from, and broadcast them.
        met = probes.hint("merge").join(index, ["seg", "value", "_salt"])
        first = F.lit(True)
        for s, d in enumerate(apart):
            first = first & F.when(F.col("seg") > s, d > r).otherwise(d >= r)
        met = met.where(first).select(*asks, *names, distance.alias("distance"), "n", "low")
        pool = met.unionByName(best)
        # The first row of every class before one comes before all rows of that one, so k + 1 classes are enough; Spark
        # cuts them in each task before the shuffle.
        near = Window.partitionBy(*asks).orderBy("distance", "low", *names)
        state = cut(pool.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k + 1).drop("_n"))
        reach = len(apart) * (r + 1) - 1
        closed = state.where(F.col("distance") <= reach).groupBy(*asks).agg(F.sum("n").alias("n")).where(F.col("n") >= min(k + 1, total)).select(*asks)
        done = done.unionByName(state.join(closed, asks, "left_semi"))
        best = state.join(closed, asks, "left_anti")
        open_ = cut(open_.join(closed, asks, "left_anti"))
        if not open_.take(1):
            break
    else:
        done = done.unionByName(best)
    by_row = Window.partitionBy(*asks).orderBy("distance", "vec_id")
    lists = done.select(*asks, *names, "distance").join(members.select(*names, "vec_id"), names).withColumn("_r", F.row_number().over(by_row)).where(F.col("_r") <= k + 1)
    out = asked.select(F.col("vec_id").alias("query_id"), *[F.col(c).alias(q) for c, q in zip(names, asks)]).join(cut(lists.select(*asks, "vec_id", "distance")), asks).where("vec_id <> query_id")
    each = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return out.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))
