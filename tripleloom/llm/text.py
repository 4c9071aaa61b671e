"""Words and their hashes, for whole Arrow batches of texts at once.

Everything works on the UTF-8 bytes of a batch: word bounds come from a table
of 256 flags, word hashes from prefix sums of a polynomial modulo 2**64.  No
Python object is made per word, and temporary arrays stay a few megabytes
whatever the length of a text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that end at ASCII white space: ``[^\x20\x09-\x0D]``.
PLAIN = np.ones(256, dtype=bool)
PLAIN[9:14] = False
PLAIN[32] = False

#: Bytes of words of letters and digits: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``, after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = True
ALNUM[97:123] = True
ALNUM[128:] = True


class Words(NamedTuple):
    """Words of a batch: byte bounds, and the bounds of each text's words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the texts' offsets in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def find_words(column: pa.Array, flags: np.ndarray = PLAIN) -> Words:
    """Words of each text, A-Z lower-cased."""
    data, at = utf8(column)
    data = LOWER[data]
    inside = flags[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[at[:-1]] = False
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    after[at[1:]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly over all 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, _BASE, dtype=np.uint64)
    back = np.full(n, pow(_BASE, -1, 2**64), dtype=np.uint64)
    base[0] = back[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(back)


_SMALL = _powers(_CHUNK + 4097)


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    data, starts, ends, _ = words
    out = np.empty(len(starts), dtype=np.uint64)
    low = 0
    while low < len(starts):
        base = starts[low]
        high = max(low + 1, int(np.searchsorted(starts, base + _CHUNK)))
        size = int(ends[high - 1] - base)
        power, back = _SMALL if size < len(_SMALL[0]) else _powers(size + 1)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data[base:base + size]] * power[:size], out=sums[1:])
        b, e = starts[low:high] - base, ends[low:high] - base
        out[low:high] = (sums[e] - sums[b]) * back[b] + (e - b).astype(np.uint64) * _TABLE[0]
        low = high
    return mix(out)


_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` hashes; runs over the ends of texts included."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    total = hashes[:len(hashes) - n + 1] * _PLACES[0]
    for j in range(1, n):
        total = total + hashes[j:len(hashes) - n + 1 + j] * _PLACES[j % len(_PLACES)] * np.uint64(2 * (j // 64) + 1)
    return mix(total)


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` for each start, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
