"""What a SentencePiece model file says, and the pre-tokens over which its pieces are found.

No piece has the space mark after another character, so no piece reaches over
the start of a run of spaces. Each such run with what follows it up to the next
is therefore segmented by itself, and once for all its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import words

MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, i = varint(i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class Pieces:
    """The pieces of a model: strings, scores, and the ids of the single bytes."""

    NORMAL, BYTE, USER_DEFINED, UNUSED = 1, 6, 4, 5

    def __init__(self, model: bytes):
        self.text: list[str] = []
        scores, kinds = [], []
        norm = b""
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.text.append(piece.get(1, b"").decode())
                scores.append(np.frombuffer(piece[2], "<f4")[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, self.NORMAL))
            elif number == 3:
                norm = value
        self.score, self.kind = np.array(scores, np.float64), np.array(kinds)
        spec = dict(_fields(norm))
        if spec.get(2) or spec.get(4, 1) or not spec.get(3, 1) or not spec.get(5, 1) or np.isin(self.kind, (self.USER_DEFINED, self.UNUSED)).any():
            raise ValueError("only models with identity normalisation, a dummy prefix, all spaces kept and neither user-defined nor unused pieces are read")
        self.ids = {t: i for i, t in enumerate(self.text) if self.kind[i] == self.NORMAL}
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece reaches over a space")
        self.bytes = np.full(256, -1, np.int32)
        for i in np.flatnonzero(self.kind == self.BYTE):
            self.bytes[int(self.text[i][3:5], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte fallback")


@lru_cache(2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def prefixed(column: pa.Array) -> pa.Array:
    """Texts as the model's normaliser leaves them, with spaces for space marks: a null is empty, others get a space in front."""
    column = pc.fill_null(column, "")
    if pc.any(pc.match_substring(column, MARK)).as_py():
        column = pc.replace_substring(column, MARK, " ")
    return pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(pa.scalar(" ", column.type), column, pa.scalar("", column.type)))


def _gaps(data: np.ndarray, i: int, j: int) -> np.ndarray:
    part = data[i - 1 : j] == 0x20
    return np.flatnonzero(part[1:] & ~part[:-1])


def _spans(data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    space = data == 0x20
    edge = space.copy()
    edge[1:] &= ~space[:-1]
    edge[:1] = True
    if breaks is not None:
        edge[breaks[breaks < len(data)]] = True
    starts = np.flatnonzero(edge)
    return starts, np.append(starts[1:], len(data))


def pretokens(column: pa.Array) -> Iterator[words.Words]:
    """The pre-tokens of prefixed(column): every byte is in one."""
    return words.split(column, spans=_spans, gaps=_gaps)


class Known:
    """Values kept by hash: sorted hashes and the places of their values, emptied when too many."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.places, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, -1 where unknown; and which are unknown."""
        if not self.n:
            return np.full(len(hashes), -1), np.arange(len(hashes))
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        found = self.hashes[at] == hashes
        return np.where(found, self.places[at], -1), np.flatnonzero(~found)

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Places for new hashes, numbered on from the last."""
        new = np.arange(self.n, self.n + len(hashes))
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")
        self.hashes, self.places = both[order], np.concatenate([self.places, new])[order]
        self.n += len(hashes)
        return new
