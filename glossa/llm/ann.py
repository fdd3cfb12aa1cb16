"""Approximate nearest neighbours by inner product: inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample (SAMPLE vectors of smallest hash); every vector is indexed.
A query's inner product with a vector is that with its centroid plus, for each subspace, an entry of the query's table
of products with the codebook (asymmetric distances: the query itself is not quantised).  For many queries and the codes
of a block, making the tables, looking the codes up in them and summing is one matrix product of the queries with the
codes' entries of the codebooks.  How many lists a query probes
is measured, since it depends on the data: clustered vectors need few lists, vectors without structure most of them.
PROBED_BY of the queries that are asked are held against every entry, one pass whose cost is that of PROBED_BY products an
entry, and so many lists are probed that AIM of all their true neighbours lie in them, and 0.9 of each one's for all but
one in a hundred.

Equal vectors are one entry of the index with their smallest ids, so a vector copied a million times is compared once.
The number of lists grows with the root of the number of vectors, as far as the sample can place centroids (LISTS).
Lists are dealt into blocks of about BLOCK entries, and a list above that is cut into several.  A query goes to the blocks
that hold a list it probes; no vector is copied.  A task holds the entries of one block and lets the queries stream past
it, so its memory is bounded.  Within a block the best SHORT entries of each query by table, all that tie with the last
of them, and all whose known quantisation error could bring them among the best (SURE standard deviations of an error in a
random direction), are ranked exactly, in double precision, ties by vec_id, and the best of all blocks are kept.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors are
compared with vectors of their own length; ties go to the smaller vec_id, a null vec_id being the largest; a vec_id
that occurs twice is two candidates, though not for itself; fewer candidates than wanted give all of them; further
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, frugal
from .vectors import first_ids, usable

SAMPLE, PROBED_BY = 20_000, 400  # vectors that train the index; queries that set the number of probes
AIM, SURE = 0.975, 4.0  # part of those queries' true neighbours in the probed lists; standard deviations of a table's error
LISTS = 1024  # at most: the sample has about 20 vectors for each; below, half the root of the number of vectors
SUBSPACE, CODES = 2, 256  # dimensions of a subspace; entries of its codebook
BLOCK, CHUNK, SHORT = 16_384, 256, 250  # entries of a block at most; queries compared at once; entries ranked exactly
TASKS = 32  # blocks at least, if there are entries enough


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    centers = x[np.random.default_rng(7).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        n = np.bincount(near, minlength=len(centers))
        for d in range(x.shape[1]):
            s = np.bincount(near, x[:, d], len(centers))
            centers[n > 0, d] = s[n > 0] / n[n > 0]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centers.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


class Index:
    """Centroids (lists x d), codebooks (subspaces x codes x SUBSPACE) and the number of lists to probe (at first all)."""

    def __init__(self, sample: np.ndarray, total: int):
        self.d = sample.shape[1]
        self.pad = -self.d % SUBSPACE
        self.centers = _kmeans(sample, max(1, min(LISTS, int(total**0.5 / 2), len(sample))))
        near = _nearest(sample, self.centers)
        rest = self.parts(sample - self.centers[near])
        self.books = np.stack([_kmeans(rest[:, m], CODES, 6) for m in range(rest.shape[1])])
        self.probes = len(self.centers)

    def measure(self, queries: np.ndarray, row: np.ndarray, lists: np.ndarray) -> None:
        """Sets the number of probes by the lists in which true neighbours of queries lie."""
        if not len(row):
            return
        place = np.argsort(np.argsort(-(queries @ self.centers.T), axis=1, kind="stable"), axis=1)  # of each list among a query's
        needed = place[row, lists]
        each = [np.quantile(needed[row == q], 0.9, method="higher") for q in np.unique(row)]
        self.probes = int(max(np.quantile(needed, AIM, method="higher"), np.quantile(each, 0.99, method="higher"))) + 1

    def parts(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pad))).reshape(len(x), -1, SUBSPACE)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = _nearest(x, self.centers)
        rest = self.parts(x - self.centers[lists])
        return lists, np.stack([_nearest(rest[:, m], book) for m, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """queries x lists: whether the query looks into the list."""
        products = q @ self.centers.T
        edge = -np.partition(-products, self.probes - 1, axis=1)[:, self.probes - 1, None]
        return products >= edge - 1e-9 * np.abs(edge)  # lists that tie with the last one are probed too

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What centroid and codes stand for, entries x d."""
        rest = self.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)[:, : self.d]
        return (self.centers[lists] + rest).astype(np.float32)

    def search(self, q: np.ndarray, lists: np.ndarray, near: np.ndarray, x: np.ndarray, error: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, entry row, exact score) of the best k entries a query finds in its probed lists; ties by ``low``.

        ``near`` is what the entries' codes stand for, ``x`` the entries themselves, ``error`` the lengths of their differences.
        """
        score = q.astype(np.float32) @ near.T
        score[~self.probed(q)[:, lists]] = -np.inf
        short = min(max(SHORT, 2 * k), len(lists))
        edge = np.partition(score, len(lists) - short, axis=1)[:, len(lists) - short, None]
        close = score >= edge - 1e-5 * np.abs(np.where(np.isfinite(edge), edge, 0))
        if len(lists) > short:
            off = np.linalg.norm(q, axis=1).astype(np.float32)[:, None] * (SURE / self.d**0.5 * error).astype(np.float32)
            sure = np.partition(score - off, len(lists) - k, axis=1)[:, len(lists) - k, None]  # k entries are at least this good
            close |= score + off >= sure
        row, at = np.nonzero(close & np.isfinite(score))
        exact = np.concatenate([np.einsum("ed,ed->e", q[row[i : i + 65536]], x[at[i : i + 65536]]) for i in range(0, len(row), 65536)] or [np.zeros(0)])
        order = np.lexsort((low[at], -exact, row))
        row, at, exact = row[order], at[order], exact[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[kept], at[kept], exact[kept]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(flat), -1)


def _true_lists(coded: DataFrame, queries: np.ndarray, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, list) of the true k nearest of at most PROBED_BY queries among all entries, each task keeping its best."""
    sent = coded.sparkSession.sparkContext.broadcast((queries, nodes))

    def best(batches):
        q, own = sent.value
        score, lists = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int32)
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                new = q @ _matrix(b.column("embedding")).T
                new[own[:, None] == b.column("node").to_numpy()] = -np.inf
                score, lists = np.hstack([score, new]), np.hstack([lists, np.broadcast_to(b.column("list").to_numpy(), new.shape)])
                if score.shape[1] > k:
                    at = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score, lists = np.take_along_axis(score, at, axis=1), np.take_along_axis(lists, at, axis=1)
        row = np.repeat(np.arange(len(q)), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(score.ravel()), pa.array(lists.ravel(), pa.int32())], ["row", "score", "list"])

    order = Window.partitionBy("row").orderBy(F.desc("score"), "list")
    top = coded.select("node", "list", "embedding").mapInArrow(frugal(best), "row int, score double, list int").where(F.col("score") > float("-inf"))
    got = top.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("row", "list").toArrow()  # PROBED_BY x k rows
    return got["row"].to_numpy(), got["list"].to_numpy()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of ``vectors(vec_id, embedding)``, the query's row left out.

    ``queries(vec_id)`` names rows of ``vectors``.
    """
    rows = cut(usable(vectors).withColumn("node", F.xxhash64("embedding")))
    wanted = queries.select("vec_id").where("vec_id is not null").distinct()
    lengths = sorted(r[0] for r in rows.select(F.size("embedding")).distinct().collect())
    found = [_nearest_alike(rows.where(F.size("embedding") == n), wanted, k) for n in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _nearest_alike(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``nearest`` for rows (vec_id, embedding, node) of vectors of one length."""
    spark = rows.sparkSession
    asked = cut(rows.join(queries, "vec_id", "left_semi").select("vec_id", "node"))
    members = cut(first_ids(rows, ["node"], k + 1).select("node", "vec_id", "_n", "embedding"))
    entries = members.where("_n = 1").select("node", "vec_id", "embedding")
    total = entries.count()
    sample = entries.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").toArrow()
    fitted = Index(_matrix(sample["embedding"]), total)
    first_index = spark.sparkContext.broadcast(fitted)  # at most LISTS centroids and d x CODES numbers

    def encode(batches):
        for b in batches:
            lists, codes = first_index.value.encode(_matrix(b.column("embedding")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], [*b.schema.names, "list", "code"])

    vector = rows.schema["embedding"].dataType.simpleString()
    coded = cut(entries.mapInArrow(frugal(encode), f"node long, vec_id long, embedding {vector}, list int, code binary"))
    asking = coded.join(asked.select("node").distinct(), "node", "left_semi").orderBy(F.xxhash64("node", F.lit(2)), "node").limit(PROBED_BY).select("node", "embedding").toArrow()
    if asking.num_rows:
        queries, nodes = _matrix(asking["embedding"]), asking["node"].to_numpy()
        fitted.measure(queries, *_true_lists(coded, queries, nodes, k))
    index = spark.sparkContext.broadcast(fitted)
    sizes = {r[0]: r[1] for r in coded.groupBy("list").count().collect()}  # at most LISTS rows
    lists = len(index.value.centers)
    most = max(1, min(BLOCK, -(-total // TASKS)))
    first, cuts, at, room = np.zeros(lists, np.int64), np.ones(lists, np.int64), -1, 0
    for c in range(lists):
        n = sizes.get(c, 0)
        if n > most:
            cuts[c] = -(-n // most)
            first[c], at, room = at + 1, at + cuts[c], 0
        else:
            if n > room or at < 0:
                at, room = at + 1, most
            first[c], room = at, room - n
    blocks = at + 1
    layout = spark.createDataFrame([(c, int(first[c]), int(cuts[c])) for c in range(lists)], "list int, first long, cuts long")
    block = (F.col("first") + F.pmod(F.xxhash64("node", F.lit(1)), F.col("cuts"))).alias("block")
    dealt = coded.join(F.broadcast(layout), "list").select(block, "node", "vec_id", "list", "code", "embedding")
    wanted = coded.join(asked.select("node").distinct(), "node", "left_semi").select("node", "embedding")

    def route(batches):
        """A query once for each block that holds a list it probes."""
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                b = whole.slice(i, CHUNK)
                q, c = np.nonzero(index.value.probed(_matrix(b.column("embedding"))))
                many = cuts[c]
                q, at = np.repeat(q, many), np.repeat(first[c], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                q, at = np.divmod(np.unique(q * blocks + at), blocks)
                out = b.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([pa.array(at), *out.columns], ["block", *out.schema.names])

    sent = wanted.mapInArrow(frugal(route), f"block long, node long, embedding {vector}")
    sent = sent.select("block", "node", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("int").alias("list"), F.lit(None).cast("binary").alias("code"), "embedding")
    # The entries of a block come before its queries.
    stream = dealt.unionByName(sent).repartition("block").sortWithinPartitions("block", F.col("list").asc_nulls_last())

    def match(batches):
        names, here, held, entries = ["node", "found", "low", "score"], None, [], None

        def found(part: pa.RecordBatch) -> pa.RecordBatch:
            out = [[], [], [], []]
            node, lists, near, x, error, low, shown = entries
            asked = part.column("node").to_numpy()
            for i in range(0, part.num_rows, CHUNK):
                row, at, score = index.value.search(_matrix(part.column("embedding").slice(i, CHUNK)), lists, near, x, error, low, k + 1)
                for kept, new in zip(out, (asked[i + row], node[at], np.asarray(shown)[at], score)):
                    kept.append(new)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t, from_pandas=True) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names)

        for b in batches:
            block = b.column("block").to_numpy()
            turns = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
            for i, j in zip(turns, turns[1:]):
                if i == j:
                    continue
                if block[i] != here:
                    here, held, entries = block[i], [], None
                part = b.slice(i, j - i)
                many = len(part) - part.column("list").null_count
                if many:
                    held.append(part.slice(0, many))
                if many < len(part) and held:
                    if entries is None:
                        t = pa.Table.from_batches(held)
                        low = t["vec_id"].to_numpy().astype(float)
                        lists, codes = t["list"].to_numpy(), np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(t), -1)
                        near, x = index.value.decoded(lists, codes), _matrix(t["embedding"])
                        entries = t["node"].to_numpy(), lists, near, x, np.linalg.norm(x - near, axis=1), np.where(np.isnan(low), np.inf, low), low
                    yield found(part.slice(many))

    best = Window.partitionBy("node").orderBy(F.desc("score"), F.col("low").asc_nulls_last(), "found")
    top = stream.mapInArrow(frugal(match), "node long, found long, low double, score double").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    ids = members.select(F.col("node").alias("found"), "vec_id")
    by_row = Window.partitionBy("node").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    of_class = cut(top.select("node", "found", "score").join(ids, "found").withColumn("_r", F.row_number().over(by_row)).where(F.col("_r") <= k + 1).select("node", "vec_id", "score"))
    # Each query has the list of its class, without its own row.
    out = asked.select(F.col("vec_id").alias("query_id"), "node").join(of_class, "node").where("NOT vec_id <=> query_id")
    each = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
