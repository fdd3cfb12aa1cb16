"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

A document's key on the ring is the hash of its text, so equal texts fall together; the shard owning the next virtual
node clockwise takes it.  A shard takes no more than the mean load (plus SLACK); keys that meet a full shard continue
clockwise to the next virtual node whose shard has room.

The ring is cut into cells, and a cell that holds more than its part of the bytes (one text copied a million times is
one point of the ring) is cut further by the hash of the doc_id, and what is still too large then - whole rows that are
repeated - by the number of the row.  Only the cells' byte and row totals reach the driver - at most CELLS + 3 x FINE
rows whatever the input is - where the loads are settled; documents find their cell's shard by an equi-join.  Larger cells are settled before smaller ones, which leaves the even filling to the small.

Defined results: null text has no bytes and size 1; null doc_ids are sharded by their text; equal rows are separate
rows; further columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

SHARDS, NODES = 8, 64
CELLS, FINE = 1 << 14, 1 << 12  # cells of the ring; parts of the whole load above which a cell is cut further
SLACK = 0.001


def _ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(cell after which the node stands, shard), clockwise."""
    place = lambda s, k: int(hashlib.md5(f"shard {s} node {k}".encode()).hexdigest()[:8], 16) % CELLS
    return sorted((place(s, k), s) for s in range(shards) for k in range(nodes))


def settle(cells: list[tuple[int, int, int, int]], shards: int, nodes: int = NODES) -> list[int]:
    """The shard of each cell (ring place, part, piece, load); loads are bounded by the mean and SLACK."""
    ring = _ring(shards, nodes)
    places = [p for p, _ in ring]
    bound = sum(c[3] for c in cells) / shards * (1 + SLACK)
    load, out = [0] * shards, [0] * len(cells)
    for k in sorted(range(len(cells)), key=lambda k: (-cells[k][3], cells[k][:3])):
        place, _, _, size = cells[k]
        at = bisect.bisect_left(places, place)
        for step in range(len(ring)):
            s = ring[(at + step) % len(ring)][1]
            if load[s] + size <= bound:
                break
        else:  # no shard has that much room left: the emptiest
            s = min(range(shards), key=lambda s: (load[s], s))
        load[s] += size
        out[k] = s
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for all rows of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.when(F.col("text").isNotNull(), F.crc32(text.cast("binary"))).otherwise(F.crc32(F.lit("").cast("binary"))).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
    )
    placed = rows.select("*", F.pmod("_key", F.lit(CELLS)).cast("int").alias("_cell"), F.pmod(F.xxhash64("doc_id", "_key"), F.lit(1 << 20)).alias("_fine"))
    kept = cut(placed.drop("_key").withColumn("_row", F.monotonically_increasing_id()))  # written, so the numbers stay

    def finer(rows: DataFrame, keys: list[str], by: str, name: str) -> DataFrame:
        """``rows`` with the part of their cell: one for nearly all cells, together at most cells + FINE."""
        totals = rows.groupBy(*keys).agg(F.sum("size").alias("_load"))
        parts = totals.select(*keys, F.ceil(F.col("_load") * FINE / F.sum("_load").over(Window.partitionBy())).cast("int").alias("_parts"))
        return rows.join(F.broadcast(parts), keys).withColumn(name, F.pmod(by, "_parts").cast("int")).drop("_parts")

    cells = finer(finer(kept, ["_cell"], "_fine", "_part"), ["_cell", "_part"], "_row", "_piece")
    stats = cells.groupBy("_cell", "_part", "_piece").agg(F.sum("size").alias("load"), F.count("*").alias("n"))
    found = sorted(tuple(r) for r in stats.collect())
    owner = settle([c[:4] for c in found], shards)
    begun, settled = [0] * shards, []
    for (cell, part, piece, _, n), s in zip(found, owner):
        settled.append((cell, part, piece, s, begun[s]))
        begun[s] += n
    plan = spark.createDataFrame(settled, "_cell int, _part int, _piece int, shard int, _begin long")
    order = Window.partitionBy("_cell", "_part", "_piece").orderBy("doc_id", "text_crc32", "size")
    out = cells.withColumn("_at", F.row_number().over(order) - 1).join(F.broadcast(plan), ["_cell", "_part", "_piece"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_begin") + F.col("_at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
