"""Words, lines and 64-bit hashes of many texts at once, as NumPy arrays.

Arrow hands a Python task the UTF-8 bytes of a whole batch of texts in one
buffer. These helpers find the words and lines of all texts in that buffer
and hash them without a Python loop over words. Work is cut into slices of at
most ``SLICE_BYTES`` of text (a longer text is a slice of its own), so the
temporary arrays stay small whatever a batch holds.

A word is ``[^\\x20\\x09-\\x0D]+``. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (the public splitmix64 finaliser)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTE = stream(256, 11)
_PLACE = stream(4096, 12) | _U(1)
_STEP = _U(0xD1342543DE82EF95)
#: Multipliers for the words of a window, by place.
PLACE_IN_WINDOW = stream(64, 13) | _U(1)


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and ``len(texts) + 1`` offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if len(arr) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges ``[lo, hi)`` that hold at most ``limit`` bytes, or one text."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, first)``: byte spans of the words, and the index of each text's first word."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = True
    after[edges - 1] = True
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (spans are disjoint, ascending and not empty)."""
    if len(starts) == 0:
        return np.empty(0, _U)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
    raw = data[place + np.repeat(starts, lens)]
    with np.errstate(over="ignore"):
        rolled = _PLACE[place & 4095]
        if int(lens.max()) > 4096:
            rolled = rolled + (place >> 12).astype(_U) * _STEP * _U(2)
        h = np.add.reduceat(_BYTE[raw] * rolled, at)
        return mix(h + lens.astype(_U) * _STEP)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: a hash per word, and the index of each text's first word."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def owners(first: np.ndarray) -> np.ndarray:
    """For each word (or line), the index of the text that it belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, first word)`` of every window of ``width`` words that lies within one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, _U)
        for j in range(width):
            h += hashes[j : j + n] * PLACE_IN_WINDOW[j]
        at = np.flatnonzero(owner[:n] == owner[width - 1 :])
        return mix(h[at] + _U(width)), at


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per word, line or byte) for each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def with_owner(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts, so that one sort serves a whole slice."""
    with np.errstate(over="ignore"):
        return mix(hashes + owner.astype(_U) * _U(0x9E3779B97F4A7C15))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(found twice or more, not the first)`` for each key."""
    n = len(keys)
    twice, later = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        later[order[1:][same]] = True
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    return twice, later
