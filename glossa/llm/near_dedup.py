"""Near-duplicate classes by BagMinHash: weighted-Jaccard signatures of word shingles, banded and then verified.

Exact copies collapse first (one row per different text goes on).  The signature of a text is the register-wise minimum
of Poisson processes over (shingle, weight level): the weight axis is cut into dyadic intervals [0,1), [1,2), [2,4) ...,
each with a process of its own, and every point of a wide interval falls to one of its levels by further hash bits - the
lazily split hierarchy of the method.  A point counts if its level lies below the shingle's count, so two texts agree in
a register with probability sum(min counts) / sum(max counts).  Points are made in rising order and only up to the time
by which all registers are filled, which takes about m ln m points a text instead of m for each shingle.

Candidates share a band; the multiset overlap of the whole texts decides.  No group is ever expanded into all pairs:
first every text is compared with the most central text of its buckets (the one that meets most others), which joins
nearly all of a group; then with the central texts of its other buckets, where components still differ.  Only buckets
that still hold several components go on, in blocks of BLOCK x BLOCK texts.  First the blocks see signatures alone and
send out a forest: the most alike pairs that would join all components.  What these leave is compared to the end, inside
tasks that get the texts only of those that still have a likely partner, and send out nothing but links.  A pair is
unlikely if fewer than AGREEING of its registers agree; a pair at 0.8 is so with probability 7.6e-6, less than the
chance to share no band (1.5e-5).  Buckets, central texts and copies with more than a small part of all rows are dealt
over many tasks in every join.

Texts are told apart by a 64-bit hash: 10^10 different texts hold about three pairs that it mistakes for copies.

Defined results: null text counts as empty; a text without words is linked only to equal texts; a text of one to four
words is one shingle; a null doc_id takes part and is never the class id unless the whole class has none; repeated
rows give repeated result rows; an empty table gives an empty result; further columns, whatever their names, are ignored
by ``near_duplicate_classes`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import any_frequent, any_frequent_of, cut, forest_roots, frugal, merged, spread
from .shingles import U, counted, mix, slices

WIDTH, SIMILARITY = 5, 0.8
ROWS, BANDS = 5, 28  # a pair at 0.8 shares no band with probability (1 - 0.8**5)**28 = 1.5e-5
REGISTERS = ROWS * BANDS
AGREEING = 91  # of 140 registers; at 0.8 the expected number is 112, and this is 4.4 standard deviations below
BLOCK = 1024
_GOLD = U(0x9E3779B97F4A7C15)


def bag_minhash(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures, one row per text; a text without shingles has a row of infinities."""
    out = np.full((n_docs, m), np.inf)
    weight = np.bincount(doc, count, n_docs)
    # One process for each dyadic interval [low, low + span) of levels that the count reaches.
    kind = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    item = np.repeat(np.arange(len(doc)), kind)
    j = np.arange(len(item)) - np.repeat(np.cumsum(kind) - kind, kind)
    low = np.where(j == 0, 0, 1 << np.maximum(j - 1, 0)).astype(U)
    span = np.where(j == 0, 1, 1 << np.maximum(j - 1, 0)).astype(U)
    seed = mix(shingle[item] + mix(j.astype(U) + U(1)) * _GOLD)
    owner, top = doc[item], count[item].astype(U)
    rate = span * float(m)
    todo = weight > 0
    limit = np.zeros(n_docs)
    limit[todo] = (np.log(m) + 3) / weight[todo]
    while todo.any():
        live = np.flatnonzero(todo[owner])
        out[todo] = np.inf
        begun, drawn, block = np.zeros(len(live)), 0, 1
        while len(live):
            k = np.arange(drawn, drawn + block, dtype=U)
            bits = mix(seed[live, None] + (k * U(3) + U(1)) * _GOLD)
            gap = -np.log((bits >> U(11)).astype(float) * 2.0**-53 + 2.0**-54)
            t = begun[:, None] + np.cumsum(gap, axis=1) / rate[live, None]
            row, col = np.nonzero(t < limit[owner[live], None])
            own = live[row]
            pick = mix(seed[own] + (k[col] * U(3) + U(2)) * _GOLD)
            register = ((pick >> U(32)) * U(m)) >> U(32)
            level = low[own] + (((pick & U(0xFFFFFFFF)) * span[own]) >> U(32))
            active = level < top[own]
            np.minimum.at(out.reshape(-1), owner[own[active]] * m + register[active].astype(np.int64), t[row[active], col[active]])
            begun, going = t[:, -1], t[:, -1] < limit[owner[live]]
            live, begun = live[going], begun[going]
            drawn += block
            block = min(block * 2, 64)
        todo &= ~np.isfinite(out).all(axis=1)  # rare: a register stayed empty; its text is done again, for longer
        limit[todo] *= 2
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bands, tags = [], []
        for _, raws in slices(batch.column("text")):
            doc, shingle, count = counted(raws, WIDTH)
            sig = bag_minhash(doc, shingle, count, len(raws))
            bits = mix(sig.view(U))
            keys = np.zeros((len(raws), BANDS), U)
            for r in range(ROWS):
                keys = mix(keys * _GOLD + bits[:, r::ROWS][:, :BANDS])
            keys = mix(keys + np.arange(1, BANDS + 1, dtype=U) * _GOLD).view(np.int64)
            filled = np.isfinite(sig[:, 0])
            bands += [k if ok else [] for k, ok in zip(keys, filled)]
            tags += [b.tobytes() for b in (bits >> U(56)).astype(np.uint8)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("node"), pa.array(bands, pa.list_(pa.int64())), pa.array(tags, pa.binary())], ["doc_id", "node", "bands", "tag"]
        )


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as sorted values and counts; 0 if both are empty."""
    total = a[1].sum() + b[1].sum()
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (total - both)) if total else 0.0


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        ta, tb = batch.column("ta"), batch.column("tb")
        known: dict[int, tuple] = {}
        held = 0
        keep = []
        for k in range(len(a)):
            both = []
            for node, text in ((a[k], ta), (b[k], tb)):
                if node not in known:
                    if held > 1 << 24:
                        known, held = {}, 0
                    known[node] = counted([(text[k].as_py() or "").encode("utf-8", "replace")], WIDTH)[1:]
                    held += 300 + 2 * known[node][0].nbytes
                both.append(known[node])
            keep.append(overlap(*both) >= SIMILARITY)
        yield batch.filter(pa.array(keep, pa.bool_())).drop_columns(["ta", "tb"])


def _candidates(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, agreeing registers) of the likely pairs of a block that lie in different components.

    Pairs that met in an earlier band are left to that one; 8 bits of a register stand for it.
    """
    comp, node, mine = (t[c].to_numpy() for c in ("comp", "node", "chunk"))
    i, j = t["i"][0].as_py(), t["j"][0].as_py()
    tags = np.frombuffer(b"".join(t["tag"].to_pylist()), np.uint8).reshape(-1, REGISTERS)
    banded = tags.reshape(-1, BANDS, ROWS)
    at = int(np.argmax((banded == banded[0]).all(axis=(0, 2))))  # the first band that the whole block shares
    xs, ys, ns = [], [], []
    for x in np.flatnonzero(mine == i):
        other = np.flatnonzero((mine == j) & (comp != comp[x]) & ((i != j) | (node > node[x])))
        n = (tags[other] == tags[x]).sum(axis=1)
        other, n = other[n >= AGREEING], n[n >= AGREEING]
        new = ~(banded[other, :at] == banded[x, :at]).all(axis=2).any(axis=1)
        xs.append(np.full(int(new.sum()), x))
        ys.append(other[new])
        ns.append(n[new])
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (xs, ys, ns))


def _joined(comp: np.ndarray, pairs, same=lambda x, y: True) -> Iterator[tuple[int, int]]:
    """Those pairs, in order, that join components not joined before; ``same`` has the last word."""
    comp = comp.copy()
    for x, y in pairs:
        if comp[x] != comp[y] and same(x, y):
            yield x, y
            comp[comp == comp[y]] = comp[x]


def _forest(t: pa.Table) -> pa.Table:
    """The most alike pairs that would join all components of a block that have likely pairs."""
    x, y, n = _candidates(t)
    order = np.argsort(-n, kind="stable")
    node, comp = t["node"].to_numpy(), t["comp"].to_numpy()
    kept = list(_joined(comp, zip(x[order], y[order])))
    a, b = (np.array([p[k] for p in kept], np.int64) for k in (0, 1))
    return pa.table({"a": node[a], "b": node[b], "ca": comp[a], "cb": comp[b]})


def _living(t: pa.Table) -> pa.Table:
    """The rows of a block that still have a likely partner."""
    x, y, _ = _candidates(t)
    return t.take(pa.array(np.unique(np.concatenate([x, y]))))


def _compared(t: pa.Table) -> pa.Table:
    """The components that links join within one block, by the texts."""
    x, y, n = _candidates(t)
    order = np.argsort(-n, kind="stable")
    texts, comp = t["text"], t["comp"].to_numpy()
    known: dict[int, tuple] = {}

    def bag(k: int) -> tuple:
        if k not in known:
            known[k] = counted([texts[int(k)].as_py().encode("utf-8", "replace")], WIDTH)[1:]
        return known[k]

    kept = list(_joined(comp, zip(x[order], y[order]), lambda x, y: overlap(bag(x), bag(y)) >= SIMILARITY))
    return pa.table({"ca": comp[np.array([p[0] for p in kept], np.int64)], "cb": comp[np.array([p[1] for p in kept], np.int64)]})


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(doc_id, node, row) of the rows, (node, comp, ...) of the texts, (comp, class_id, kept, class_size), frequent texts."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sig = cut(rows.mapInArrow(frugal(_signatures), f"doc_id {kind}, node long, bands array<long>, tag binary").withColumn("row", F.monotonically_increasing_id()))
    # Bands and tag follow from the text, so those of any copy will do; copies are collapsed before the shuffle.
    reps = cut(sig.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("tag").alias("tag")))
    often = any_frequent_of(reps, ["node"], "copies")
    members = reps.select("node", F.explode("bands").alias("key"))
    sizes = cut(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    hot = any_frequent_of(sizes, ["key"], "size")
    met = cut(spread(members, hot, ["key"], "node", sizes))
    met = met.join(met.groupBy("node").agg(F.sum("size").alias("score")), "node")
    central = met.groupBy("key").agg(F.max(F.struct("score", "node")).getField("node").alias("low"))
    shared = cut(spread(met, hot, ["key"], "node", central).select("node", "key", "low", "size"))
    # The texts that can be linked at all, once.
    linked = shared.select("node").distinct().join(reps, "node").select("node", "rep")
    copies = spread(rows, often, ["node"], "doc_id", linked)
    texts = cut(copies.where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text").dropDuplicates(["node"]))

    def verify(pairs: DataFrame, hubs: str = "b") -> DataFrame:
        """The pairs that are alike; ``hubs`` are the ends that one text may have in very many pairs."""
        kept = [c for c in pairs.columns if c not in ("a", "b")]
        p = pairs = cut(pairs)
        for end, other in ("ab", "ba"):
            said = texts.select(F.col("node").alias(end), F.col("text").alias(f"t{end}"))
            if end in hubs:
                p = spread(p, any_frequent(pairs, [end]), [end], other, said)
            else:
                p = p.join(said, end)
        return p.select("a", "b", *kept, "ta", "tb").mapInArrow(frugal(_verified), ", ".join(f"{c} long" for c in ["a", "b", *kept]))

    star = cut(shared.where("node <> low").groupBy(F.col("node").alias("a"), F.col("low").alias("b")).agg(F.count("*").alias("times")))
    best = star.groupBy("a").agg(F.max(F.struct("times", "b")).getField("b").alias("b"))
    # A central text ranks above all others of its bucket, so links to it hold no cycle.
    comps = forest_roots(verify(best))
    of = lambda end: comps.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}"))
    rest = spread(star.select("a", "b").join(of("a"), "a", "left"), any_frequent(star, ["b"]), ["b"], "a", of("b"), "left")
    rest = rest.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    comps = merged(comps, verify(rest.where("ca <> cb").join(best, ["a", "b"], "left_anti")))

    def blocks(comps: DataFrame) -> DataFrame:
        """(key, i, j, node, comp, chunk, tag): buckets that hold several components, in blocks."""
        placed = shared.where("size > 2").join(comps, "node", "left").select("key", "node", "size", F.coalesce("comp", "node").alias("comp"))
        mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
        chunks = F.ceil(F.col("size") / BLOCK).cast("int")
        open_ = spread(placed, hot, ["key"], "node", mixed).withColumn("chunks", chunks)
        open_ = open_.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        # A text goes to the blocks of its chunk with every chunk of the bucket, its own included; without its text.
        dealt = open_.select("key", "node", "comp", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        dealt = dealt.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "comp", "chunk")
        return dealt.join(reps.select("node", "tag"), "node").select("key", "i", "j", "node", "comp", "chunk", "tag")

    comps = merged(comps, verify(blocks(comps).groupBy("key", "i", "j").applyInArrow(_forest, "a long, b long, ca long, cb long").dropDuplicates(["a", "b"]), "ab"))
    living = cut(blocks(comps).groupBy("key", "i", "j").applyInArrow(_living, "key long, i int, j int, node long, comp long, chunk int, tag binary"))
    if living.take(1):
        comps = merged(comps, living.join(texts, "node").groupBy("key", "i", "j").applyInArrow(_compared, "ca long, cb long"))
    of_text = reps.join(comps, "node", "left").select("node", "rep", "copies", F.coalesce("comp", "node").alias("comp"))
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("first")
    classes = of_text.groupBy("comp").agg(first, F.sum("copies").alias("class_size"))
    return sig.select("doc_id", "node", "row"), of_text, cut(classes.select("comp", F.col("first.rep").alias("class_id"), F.col("first.node").alias("kept"), "class_size")), often


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size) for every row of ``docs(doc_id, text)``; class_id is the class's smallest doc_id."""
    sig, of_text, classes, often = _classes(docs)
    named = spread(of_text, any_frequent(of_text, ["comp"]), ["comp"], "node", classes).select("node", "class_id", "class_size")
    return spread(sig, often, ["node"], "row", named).select("doc_id", "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: one of its smallest doc_id, without a doc_id only if the whole class has none."""
    # Texts of different classes may have the same doc_id, so a row is told by its text and its doc_id.
    told = lambda doc_id: F.coalesce(F.col(doc_id).cast("string"), F.lit("\0")).alias("id")
    _, _, classes, _ = _classes(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), told("doc_id"))
    # Of repeated rows one stays; they are cut in each task before the shuffle.
    order = Window.partitionBy("node", "id").orderBy(F.xxhash64(F.to_json("doc")))
    one = rows.withColumn("n", F.row_number().over(order)).where("n = 1")
    kept = one.join(classes.select(F.col("kept").alias("node"), told("class_id")), ["node", "id"], "left_semi")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
