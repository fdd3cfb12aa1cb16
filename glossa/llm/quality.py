"""Quality classifier by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes weighted counts of hashed letter triples and of hashed quadruples of character classes, and a few shape
measures.  A bounded sample of labelled texts (the LABELLED different ones of smallest hash) gives inverse document frequencies and,
by a randomized singular value decomposition, the latent space of DIMENSIONS; both and the labelled vectors are
broadcast - their size depends on these parameters alone.  Every document is projected, its cosines with all labelled
vectors are computed in blocks of matrix products, and its NEIGHBOURS nearest vote with the weight of their cosine.

Only the text is ever an input of a score.  Learning uses rows whose crc32(doc_id as text) mod 3 is not 1.

Defined results: null and empty texts score 0, having nothing to keep; without any labelled text every score is 0.5; repeated rows get equal scores and count once in the sample; a null doc_id is not held out; further columns,
whatever their names, are ignored by ``score`` and kept by ``keep_good``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, frugal
from .shingles import slices

LABELLED, DIMENSIONS, NEIGHBOURS = 5000, 64, 15
TRIPLES, QUADS, SHAPE = 2048, 1024, 8
WIDTH = TRIPLES + QUADS + SHAPE
BLOCK = 256

_CLASS = np.arange(256, dtype=np.uint8)  # ASCII marks stand for themselves; letters, digits and white space are classes
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 97
_CLASS[[9, 11, 12, 13, 32]] = 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(raws: list[bytes]) -> np.ndarray:
    """One row of WIDTH raw counts and measures per text."""
    out = np.zeros((len(raws), WIDTH), np.float32)
    for k, raw in enumerate(raws):
        x = np.frombuffer(raw, np.uint8)
        n = len(x)
        low, kind = _LOWER[x].astype(np.uint32), _CLASS[x].astype(np.uint32)
        if n > 2:
            h = (low[:-2] * 0x9E3779B1 ^ low[1:-1] * 0x85EBCA6B ^ low[2:] * 0xC2B2AE35) >> 21
            out[k, :TRIPLES] = np.bincount(h, minlength=TRIPLES)
        if n > 3:
            h = (kind[:-3] * 0x9E3779B1 ^ kind[1:-2] * 0x85EBCA6B ^ kind[2:-1] * 0xC2B2AE35 ^ kind[3:] * 0x27D4EB2F) >> 22
            out[k, TRIPLES : TRIPLES + QUADS] = np.bincount(h, minlength=QUADS)
        if n:
            words = raw.split()
            many = max(1, len(words))
            c = np.bincount(kind, minlength=256)
            out[k, TRIPLES + QUADS :] = [
                c[65] / n,
                c[48] / n,
                (n - c[65] - c[48] - c[97] - c[32] - c[10]) / n,
                c[10] / n,
                len(set(words)) / many,
                min(1.0, n / many / 20),
                min(1.0, np.log1p(len(words)) / 10),
                len(set(raw.split(b"\n"))) / (c[10] + 1),
            ]
    return out


class Space:
    """Weights of the features and the projection on the latent space."""

    def __init__(self, x: np.ndarray):
        seen = sum((x[i : i + BLOCK, :-SHAPE] > 0).sum(axis=0) for i in range(0, len(x), BLOCK))
        self.idf = np.log((1 + len(x)) / (1 + seen)).astype(np.float32)
        a = np.empty_like(x)
        for i in range(0, len(x), BLOCK):  # in blocks: the driver holds the sample twice, not many times
            a[i : i + BLOCK] = self.weighted(x[i : i + BLOCK])
        rng = np.random.default_rng(5)
        y = a @ rng.standard_normal((a.shape[1], min(DIMENSIONS + 16, len(x)))).astype(np.float32)
        for _ in range(2):
            y = a @ (a.T @ np.linalg.qr(y)[0])
        basis = np.linalg.qr(y)[0]
        _, _, v = np.linalg.svd(basis.T @ a, full_matrices=False)
        self.axes = v[:DIMENSIONS].T.astype(np.float32)

    def weighted(self, x: np.ndarray) -> np.ndarray:
        w = np.log1p(x[:, :-SHAPE]) * self.idf
        parts = []
        for part in (w[:, :TRIPLES], w[:, TRIPLES:]):
            norm = np.linalg.norm(part, axis=1, keepdims=True)
            parts.append(part / np.where(norm > 0, norm, 1))
        return np.hstack([0.6 * parts[0], parts[1], x[:, -SHAPE:]]).astype(np.float32)

    def vectors(self, x: np.ndarray) -> np.ndarray:
        v = self.weighted(x) @ self.axes
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm > 0, norm, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Space, np.ndarray, np.ndarray] | None:
    """Space, labelled vectors and labels from a bounded sample of the rows that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("quality").alias("_label")).distinct()
    # The documented bound is taken of the rows that have a text, by their hashes, before any text leaves its task.
    text = F.coalesce("text", F.lit("")).alias("text")
    texts = docs.select(F.col("doc_id").alias("_id"), text).where("text <> ''").withColumn("_text", F.xxhash64("text"))
    chosen = texts.select("_id", "_text").join(known, "_id").select("_id", "_text", "_label", F.xxhash64("_id", "_label", "_text").alias("_hash")).distinct()
    chosen = cut(chosen.orderBy("_hash").limit(LABELLED))
    texts = texts.join(F.broadcast(chosen), ["_id", "_text"]).dropDuplicates(["_hash"])  # LABELLED rows at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, raws in slices(b.column("text")):
                x = features(raws)  # float32: counts of long texts pass the range of float16
                part = slice(first, first + len(raws))
                yield pa.RecordBatch.from_arrays([b.column("_hash")[part], b.column("_label")[part].cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["hash", "label", "x"])

    rows = texts.select("_hash", "_label", "text").mapInArrow(frugal(work), "hash long, label int, x binary").toArrow()
    if not rows.num_rows:
        return None
    order = np.argsort(rows["hash"].to_numpy())
    place, x, at = np.argsort(order), np.empty((rows.num_rows, WIDTH), np.float32), 0
    for chunk in rows["x"].chunks:
        for raw in chunk:
            x[place[at]] = np.frombuffer(raw.as_buffer(), np.float32)
            at += 1
    label = rows["label"].to_numpy().astype(np.float32)[order]
    del rows
    space = Space(x)
    return space, np.concatenate([space.vectors(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)]), label


def vote(v: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Scores of unit vectors: the mean label of the k nearest, weighted by their cosine."""
    k = min(k, len(labels))
    out = np.zeros(len(v))
    for i in range(0, len(v), BLOCK):
        s = v[i : i + BLOCK] @ vectors.T
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(s, at, axis=1), 1e-6) ** 4
        out[i : i + BLOCK] = (w * labels[at]).sum(axis=1) / w.sum(axis=1)
    return out


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for all rows of ``docs(doc_id, text)``."""
    out = docs.select("doc_id", "text").mapInArrow(frugal(_scorer(docs, labels, False)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def _scorer(docs: DataFrame, labels: DataFrame, keep: bool):
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def scores(raws: list[bytes]) -> np.ndarray:
        if sent.value is None:
            return np.full(len(raws), 0.5)
        space, vectors, labels = sent.value
        out = np.clip(vote(space.vectors(features(raws)), vectors, labels), 0, 1)
        out[[not x for x in raws]] = 0
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.concatenate([scores(raws) for _, raws in slices(b.column("text"))] or [np.zeros(0)])
            if keep:
                yield b.filter(pa.array(s >= 0.5))
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return work


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be good."""
    return docs.mapInArrow(frugal(_scorer(docs, labels, True)), docs.schema)
