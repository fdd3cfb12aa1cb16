"""Best-fit packing of tokenised documents into sequences of a fixed length, by linear grouping.

1. Every text becomes token ids; only texts longer than a sequence are cut, into whole sequences and a rest.
2. Lengths are integers of at most ``capacity``, so their histogram has at most ``capacity`` rows whatever the input is.
   The plan is made from it alone: lengths above a third of the capacity are sorted, split into GROUPS groups of equal
   cardinality and rounded up to the largest of their group.  At most two such sizes fit a sequence, so the
   configuration program over them is a matching: the largest size takes the largest partner that fits, which is
   optimal.  The actual lengths then take the slots of their groups, which gives back the room the rounding had
   reserved; lengths that the rounding left alone in a sequence go back to the rest.  The rest and all small lengths go,
   longest first, to the fullest sequence that has room.
   The plan is a list of runs - so many sequences alike - and its size depends on the number of lengths only.
3. Each piece gets its number among the pieces of its length (prefix sums over salts; a length has the more of them the
   more pieces it has, so one length with most of the rows is never numbered in one task) and finds its run by binary
   search in the broadcast plan.

Defined results: null and empty texts are one piece with the single closing id; equal rows are packed as often as they
occur; a null doc_id is kept; further columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, frugal

CAPACITY, CLOSING = 4096, 1
GROUPS = 16384
SALTS = 1024  # salts of a length that has all pieces; all lengths together have at most capacity + SALTS
CACHED = 150_000  # words of one generation of a Python worker's memory, which holds two: about 50 MB while a task runs

#: Four separators split words in Python only; the lower case of sigma depends on its place; the others have a lower case
#: in newer versions of Unicode only.
_ODD = re.compile("[\x1c-\x1f\u0130\u03a3\u1c89\ua7cb-\ua7dc\U00010d50-\U00010d65\U00016ea0-\U00016eb8]")
_tokenizers: dict[str, tuple] = {}


def _encoder(path: str):
    """text -> ids as little-endian unsigned 32-bit bytes.

    The tokenizer composes characters, lower-cases them and never joins across white space, so the ids of a text are
    those of the words of its composed lower-case form, and each word is encoded once while it is remembered.  A word
    goes to the parts behind the normalizer: composing it again would join marks to letters that exist only in lower
    case.  Texts with characters for which Python's lower case or white space may differ are encoded whole.
    """
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = (Tokenizer.from_file(path), _Known())
    tok, known = _tokenizers[path]
    model, parts = tok.model, tok.pre_tokenizer

    def raw(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    marks = {c: raw([t.id for t in model.tokenize(c)]) for c in ".,;:!?"}
    shown = _byte_letters()

    def learn(word: str) -> bytes:
        if word.isalpha():  # one part; what byte-level models see of it is known
            return raw([t.id for t in model.tokenize(word if word.isascii() else "".join(map(shown.__getitem__, word.encode())))])
        if word[-1] in marks and word[:-1].isalpha():
            return known[word[:-1]] + marks[word[-1]]
        return raw([t.id for part, _ in parts.pre_tokenize_str(word) for t in model.tokenize(part)])

    def encode(text: str) -> bytes:
        if "<|" in text or _odd(text):
            return raw(tok.encode(text, add_special_tokens=False).ids)
        if len(known) > CACHED:
            known.older = dict(known)
            known.clear()
        return b"".join(map(known.__getitem__, unicodedata.normalize("NFC", text).lower().split()))

    known.learn = learn
    return encode


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _odd(text: str) -> bool:
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _ODD.search(text) is not None
    return any(c in text for c in "\x1c\x1d\x1e\x1f")


def _forget(path: str) -> None:
    """Empties the memory of words, which other tasks of this worker do not need."""
    known = _tokenizers[path][1]
    known.older = {}
    known.clear()


class _Known(dict):
    """Ids of words; an unknown word is learnt on the way, or taken over from the generation before."""

    older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        out = self[word] = self.learn(word) if out is None else out
        return out


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing: int = CLOSING) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of ``docs(doc_id, text)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer_path), np.array([closing], "<u4").tobytes()
        try:
            yield from encoded(batches, encode, end)
        finally:
            _forget(tokenizer_path)

    def encoded(batches: Iterator[pa.RecordBatch], encode, end: bytes) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column("text")
            for k in range(batch.num_rows):
                ids = encode(texts[k].as_py() or "") + end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((k, piece, start, len(part) // 4, zlib.crc32(part)))
            k, piece, start, length, crc = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(k, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(frugal(work), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# --- the plan, from the histogram ------------------------------------------------------------------------------------


def _configuration_program(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(k, j, times): sizes k and j share a sequence so often; sizes are descending and above a third of the capacity."""
    out, left = [], list(demand)
    for k, size in enumerate(sizes):
        at = max(k, bisect.bisect_left(sizes, size - capacity, key=lambda s: -s))  # the largest size that fits beside it
        while left[k] and at < len(sizes):
            times = left[k] // 2 if at == k else min(left[k], left[at])
            if times:
                out.append((k, at, times))
                left[k] -= times
                left[at] -= times
            at += 1
    return out


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) for a histogram length -> number of pieces.

    Every piece is placed exactly once and no sequence is longer than ``capacity``.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    large = sorted((n for n in left if n * 3 > capacity and n < capacity), reverse=True)
    runs: list[tuple[int, tuple[int, ...]]] = []
    if left.get(capacity):
        runs.append((left.pop(capacity), (capacity,)))
    # Groups of equal cardinality along the sorted lengths, as lists of [length, count]; a length may lie in several.
    total = sum(left[n] for n in large)
    share = -(-total // GROUPS)
    groups: list[list[list[int]]] = []
    room = 0
    for n in large:
        c = left[n]
        while c:
            if not room:
                groups.append([])
                room = share
            take = min(c, room)
            groups[-1].append([n, take])
            c, room = c - take, room - take
    for k, j, times in _configuration_program([g[0][0] for g in groups], [sum(c for _, c in g) for g in groups], capacity):
        # Substitution: the longest actual lengths of both groups first; a run ends where a length changes.
        while times:
            one, two = groups[k][0], groups[j][0]
            if one is two and one[1] == 1:
                two = groups[j][1]
            many = min(times, one[1] // 2 if one is two else min(one[1], two[1]))
            runs.append((many, (one[0], two[0])))
            for part in (one, two):
                part[1] -= many
                left[part[0]] -= many
            for g in {k, j}:
                groups[g] = [x for x in groups[g] if x[1]]
            times -= many
    # Best fit, longest first: the rest of the large and all small lengths.  Bins are kept as runs by free room.
    rooms: list[int] = []
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(run: tuple[int, tuple[int, ...]], free: int) -> None:
        if free not in by_room:
            by_room[free] = []
            bisect.insort(rooms, free)
        by_room[free].append(run)

    for run in runs:
        put(run, capacity - sum(run[1]))
    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        c = left[n]
        while c:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                put((-(-c // (capacity // n)), ()), capacity)
                continue
            free = rooms[at]
            times, held = by_room[free].pop()
            if not by_room[free]:
                del by_room[free]
                rooms.pop(at)
            each = min(free // n, c)
            full = min(times, c // each)
            put((full, held + (n,) * each), free - each * n)
            if times > full:
                put((times - full, held), free)
            c -= full * each
    return [run for free in rooms for run in by_room[free] if run[1]]


def _slots(plan: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """The plan as arrays sorted by (length, first rank): length, first, end, sequence, per sequence, offset.

    The piece of ``length`` and number ``first <= rank < end`` goes to sequence + (rank - first) // per and, of ``per``
    neighbours of its length there, takes place number (rank - first) % per after ``offset``.
    """
    rows, used, base = [], {}, 0
    for times, lengths in plan:
        offset = 0
        for n, same in itertools.groupby(sorted(lengths, reverse=True)):
            per = len(list(same))
            first = used.get(n, 0)
            used[n] = first + per * times
            rows.append((n, first, first + per * times, base, per, offset))
            offset += per * n
        base += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 6


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, piece, start, length, ids_crc32)."""
    spark = pieces.sparkSession
    rows = cut(pieces.withColumn("row", F.monotonically_increasing_id()))
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most capacity rows
    total = sum(histogram.values())
    salts = {n: 1 + c * SALTS // total for n, c in histogram.items()}
    dealt = spark.createDataFrame([*salts.items()], "length long, salts int")
    salted = rows.join(F.broadcast(dealt), "length").withColumn("salt", F.pmod("row", "salts").cast("int")).drop("salts")
    begun, left = {}, dict.fromkeys(histogram, 0)
    for n, salt, c in sorted(tuple(r) for r in salted.groupBy("length", "salt").count().collect()):  # at most capacity + SALTS rows
        begun[n, salt] = left[n]
        left[n] += c
    first = np.cumsum([0, *(salts.get(n, 0) for n in range(capacity + 1))])
    before = np.zeros(first[-1], np.int64)
    for (n, salt), c in begun.items():
        before[first[n] + salt] = c
    # All are bounded by the capacity: a number for each salt, and a plan of a few runs for each length.
    sent = spark.sparkContext.broadcast((_slots(packing_plan(histogram, capacity)), first, before))
    order = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (length, begin, _, sequence, per, offset), first, before = sent.value
        key = length << 40 | begin
        for batch in batches:
            n, salt = (batch.column(c).to_numpy() for c in ("length", "salt"))
            rank = before[first[n] + salt] + batch.column("rank").to_numpy()
            at = np.searchsorted(key, n << 40 | rank, "right") - 1
            along = rank - begin[at]
            out = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            seq = pa.array(sequence[at] + along // per[at])
            yield pa.RecordBatch.from_arrays([*out.columns, seq, pa.array(offset[at] + along % per[at] * n)], [*out.schema.names, "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(frugal(place), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing: int = CLOSING) -> DataFrame:
    """Packs all rows of ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens."""
    return pack(tokenized_pieces(docs, tokenizer_path, capacity, closing), capacity)
