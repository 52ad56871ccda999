"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Every word gets a
64-bit hash from a prefix sum of ``table[byte] * P**position``, so that one pass
of numpy over the bytes hashes every word, however many there are; runs of words
(shingles, windows) are hashed from the word hashes in the same way. Texts are
taken in chunks of about a megabyte, cut between words, so memory stays bounded
for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_PLAIN = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], np.uint64))[0])


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k consecutive elements."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.empty(len(hashes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * _power(_Q, len(hashes)), out=total[1:])
    return mix((total[k:] - total[:-k]) * _power(pow(_Q, -1, 1 << 64), n) + np.uint64(k))


def whole(hashes: np.ndarray) -> int:
    """The hash of the sequence of all elements."""
    return int(runs(hashes, len(hashes))[0]) if len(hashes) else 0


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(table[data] * _power(_P, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(pow(_P, -1, 1 << 64), len(data) + 1)[starts])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; a null is an empty string."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if column.null_count and (offs[1:][~np.asarray(column.is_valid())] != offs[:-1][~np.asarray(column.is_valid())]).any():
        return string_buffers(column.fill_null(""))
    return raw, offs


def _cuts(data: np.ndarray, gaps) -> Iterator[tuple[int, int]]:
    """Parts of one long text, cut where gaps(data, i, j) finds a place in i..j."""
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        while end < len(data):
            gap = gaps(data, end, min(len(data), end + CHUNK_BYTES))
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + CHUNK_BYTES)
        yield at, end
        at = end


def word_gaps(data: np.ndarray, i: int, j: int) -> np.ndarray:
    return np.flatnonzero(SPACE[data[i:j]])


def spans(data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in data; no word reaches over a break."""
    word = ~SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = word[0], word[-1]
    edge[1:-1] = word[1:] != word[:-1]
    first = np.flatnonzero(edge)
    starts, ends = first[0::2], first[1::2]
    if breaks is not None and len(breaks):
        inside = breaks[(breaks > 0) & (breaks < len(data))]
        inside = np.unique(inside[word[inside] & word[inside - 1]])
        if len(inside):
            starts = np.sort(np.concatenate([starts, inside]))
            ends = np.sort(np.concatenate([ends, inside]))
    return starts, ends


class Words:
    """The words of some rows: hashes, byte spans in ``data``, and ``first``, where each row's words begin."""

    __slots__ = ("rows", "data", "starts", "ends", "hashes", "first")

    def __init__(self, rows, data, starts, ends, hashes, first):
        self.rows, self.data, self.starts, self.ends, self.hashes, self.first = rows, data, starts, ends, hashes, first

    def of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])


def lowered(data: np.ndarray) -> np.ndarray:
    """data with the two-byte capitals of Latin-1 in lower case."""
    out = data.copy()
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    out[at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]] += 0x20
    return out


def split(column: pa.Array, lower: bool = False, spans=spans, gaps=word_gaps, fold=lambda data: data) -> Iterator[Words]:
    """The words of a string column, some rows (about a megabyte) at a time.

    spans and gaps may be others than those of words: what to hash, and where a long text may be cut. What
    fold makes of the bytes, as many, is hashed in their place.
    """
    table = _LOWER if lower else _PLAIN
    raw, offs = string_buffers(column)
    n, at = len(column), 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + CHUNK_BYTES, "right")) - 1
        end = min(n, max(end, at + 1))
        lo, hi = int(offs[at]), int(offs[end])
        data = raw[lo:hi]
        if hi == lo:
            starts = ends = np.empty(0, np.int64)
            hashes = np.empty(0, np.uint64)
        elif hi - lo <= 2 * CHUNK_BYTES:
            starts, ends = spans(data, offs[at:end] - lo)
            hashes = _hash_spans(fold(data), starts, ends, table)
        else:
            parts = []
            for a, b in _cuts(data, gaps):
                s, e = spans(data[a:b])
                parts.append((s + a, e + a, _hash_spans(fold(data[a:b]), s, e, table)))
            starts, ends, hashes = (np.concatenate(x) for x in zip(*parts))
        first = np.searchsorted(starts, offs[at : end + 1] - lo)
        yield Words(range(at, end), data, starts, ends, hashes, first)
        at = end
