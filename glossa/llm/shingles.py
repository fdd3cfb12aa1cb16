"""Word shingles as 64-bit numbers, computed for many texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 1 << 19  # bytes of text that are worked on at once: keeps temporaries in cache and bounded
_PRIME, _STEP = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
_INVERSE = U(pow(int(_PRIME), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_PRIME, _INVERSE)):
            x = np.full(n, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts in UTF-8) for runs of about SLICE bytes; null counts as empty.

    A batch is never turned into Python texts as a whole, since a worker keeps the memory of its largest batch.
    """
    first, held, size = 0, [], 0
    for k, x in enumerate(texts):
        raw = (x.as_py() or "").encode("utf-8", "replace")
        if held and size + len(raw) > SLICE:
            yield first, held
            first, held, size = k, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the place of its first word (one more entry than texts).

    Words are runs of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z.  Very long texts are hashed
    in parts that end between words, so the temporaries do not grow with the text.
    """
    data = _LOWER[np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)]
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + 4 * SLICE)
        while _WORD[data[to - 1]]:  # the last byte is no part of a word
            to += 1
        part = data[at:to]
        turn = np.flatnonzero(np.diff(_WORD[part], prepend=False))
        start, end = turn[::2], turn[1::2]
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum((part.astype(U) + U(1)) * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U)))
        starts.append(start + at)
        at = to
    texts = np.cumsum([0, *(len(x) + 1 for x in raws)])
    return np.concatenate(hashes or [np.zeros(0, U)]), np.searchsorted(np.concatenate(starts or [np.zeros(0, np.int64)]), texts)


def counted(raws: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), sorted by both.  A text of fewer words has one shingle of all its words."""
    words, at = word_hashes(raws)
    n = np.diff(at)
    rolled = np.zeros(max(0, len(words) - width + 1), U)
    for k in range(width):
        rolled = rolled * _STEP + words[k : k + len(rolled)]
    owner = np.repeat(np.arange(len(raws)), n)
    keep = owner[: len(rolled)] == owner[width - 1 :] if len(rolled) else np.zeros(0, bool)
    doc, sh = owner[: len(rolled)][keep], mix(rolled[keep])
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        few = []
        for d in short:
            x = U(n[d])
            with np.errstate(over="ignore"):
                for w in words[at[d] : at[d + 1]]:
                    x = x * _STEP + w
            few.append(x)
        doc, sh = np.concatenate([doc, short]), np.concatenate([sh, mix(np.array(few, U))])
    order = np.lexsort((sh, doc))
    doc, sh = doc[order], sh[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sh[1:] != sh[:-1])
    first = np.flatnonzero(new)
    return doc[first], sh[first], np.diff(np.append(first, len(doc)))
