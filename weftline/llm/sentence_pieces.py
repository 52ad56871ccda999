"""SentencePiece encoding and decoding: an automaton over the pieces drives a single-pass Viterbi.

An Aho-Corasick automaton reads each pre-token once. At every position its
output links give all pieces that end there, longest first, and each relaxes the
best score of that position; among equal scores the longest last piece stays. A
character without a piece of its own may be taken as its bytes, for the lowest
score of the vocabulary less UNKNOWN. The scores are those of the model file, as
a unigram model would use them, summed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lean, pieces as P

UNKNOWN = 10.0


class Segmenter:
    def __init__(self, model: bytes):
        self.p = p = P.pieces(model)
        self.automaton = ahocorasick.Automaton()
        for t, i in p.ids.items():
            self.automaton.add_word(t, (len(t), i, float(p.score[i])))
        self.automaton.make_automaton()
        self.single = {t for t in p.ids if len(t) == 1}
        self.unknown = min(p.score[i] for i in p.ids.values()) - UNKNOWN
        raw = [t.encode() for t in p.text]
        for b, i in enumerate(p.bytes):
            raw[i] = bytes([b])
        for i in np.flatnonzero((p.kind != P.Pieces.NORMAL) & (p.kind != P.Pieces.BYTE)):
            raw[i] = b""
        raw = [x.replace(P.MARK.encode(), b" ") for x in raw]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_first = np.concatenate([[0], np.cumsum([len(x) for x in raw])])

    def segment(self, t: str) -> list[int]:
        """The ids of the best segmentation of a text with space marks."""
        n = len(t)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        odd = [k for k in range(n) if t[k] not in self.single]
        waiting = iter([*odd, n])
        k = next(waiting)
        for end, (size, i, score) in self.automaton.iter(t):
            while k < end:
                if (s := best[k] + self.unknown) > best[k + 1]:
                    best[k + 1], back[k + 1] = s, (1, -1)
                k = next(waiting)
            end += 1
            if (s := best[end - size] + score) > best[end]:
                best[end], back[end] = s, (size, i)
            if k == end - 1:
                if (s := best[k] + self.unknown) > best[end]:
                    best[end], back[end] = s, (1, -1)
        while k < n:
            if (s := best[k] + self.unknown) > best[k + 1]:
                best[k + 1], back[k + 1] = s, (1, -1)
            k = next(waiting)
        out: list[int] = []
        while n:
            size, i = back[n]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.p.bytes[b] for b in reversed(t[n - 1].encode()))
            n -= size
        return out[::-1]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts whose ids lie one after another, without the space put in front."""
        size = (self.raw_first[1:] - self.raw_first[:-1])[ids]
        to = np.concatenate([[0], np.cumsum(size)])
        flat = np.arange(to[-1]) + np.repeat(self.raw_first[:-1][ids] - to[:-1], size)
        data, offs = self.raw[flat], to[first]
        some = offs[1:] > offs[:-1]
        keep = np.ones(len(data), bool)
        keep[offs[:-1][some]] = False
        return data[keep], offs - np.concatenate([[0], np.cumsum(some)])


@lru_cache(2)
def segmenter(model: bytes) -> Segmenter:
    return Segmenter(model)


def ragged(first: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts `which` of values, one after another, and where each begins."""
    size = (first[1:] - first[:-1])[which]
    to = np.concatenate([[0], np.cumsum(size)])
    return values[np.arange(to[-1]) + np.repeat(first[:-1][which] - to[:-1], size)], to


class Encoder:
    """Ids of texts, with those of the pre-tokens met last."""

    def __init__(self, model: bytes):
        self.s, self.known = segmenter(model), P.Known()
        self.ids, self.first = np.empty(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, column: pa.Array) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
        """For some rows at a time: the rows, their ids one after another, and where each row's begin."""
        for w in P.pretokens(P.prefixed(column)):
            if self.known.n > self.known.most:
                self.known.clear()
                self.ids, self.first = self.ids[:0], self.first[:1]
            hashes, at, back = np.unique(w.hashes, return_index=True, return_inverse=True)
            place, new = self.known.find(hashes)
            if len(new):
                got = [self.s.segment(w.data[w.starts[i] : w.ends[i]].tobytes().decode().replace(" ", P.MARK)) for i in at[new]]
                place[new] = self.known.add(hashes[new])
                self.ids = np.concatenate([self.ids, np.fromiter((x for g in got for x in g), np.int32)])
                self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(g) for g in got])])
            ids, to = ragged(self.first, self.ids, place[back])
            yield w.rows, ids, to[w.first]


def _sent(df: DataFrame, model: str | None):
    lean.small_batches(df.sparkSession)
    with open(model or P.default_model(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, ids (array of int), n_pieces and round_trip of each row.

    round_trip: decoding the ids gives the text again, space marks in it read as
    spaces. A null or empty text has no ids and holds. Null ids, repeated rows
    and empty tables pass through; other columns are left out.
    """
    sent = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or Encoder(sent.value)
            for rows, ids, first in encoder(b.column(1)):
                column = b.column(1).slice(rows.start, len(rows))
                data, offs = encoder.s.decode(ids, first)
                back = pa.StringArray.from_buffers(len(rows), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data.tobytes()))
                plain = P.pc.replace_substring(P.pc.fill_null(column, ""), P.MARK, " ")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(rows.start, len(rows)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(first)), P.pc.equal(back, plain)], names=["doc_id", "ids", "n_pieces", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(lean.batches(run), f"doc_id {kind}, ids array<int>, n_pieces long, round_trip boolean")


def decode(encoded: DataFrame, model: str | None = None, ids: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; null ids give an empty text, ids outside the vocabulary nothing."""
    sent = _sent(encoded, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = segmenter(sent.value)
            column = b.column(1)
            size = P.pc.fill_null(P.pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = P.pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
            flat = np.where((flat < 0) | (flat >= len(s.p.text)), s.p.kind.tolist().index(2), flat)
            data, offs = s.decode(flat, np.concatenate([[0], np.cumsum(size)]))
            out = pa.array([data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(offs[:-1], offs[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", ids).mapInArrow(lean.batches(run), f"doc_id {kind}, text string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of the pipeline: every document with its ids."""
    return encode(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pieces, and a digest of their ids."""
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_pieces", F.xxhash64("ids").alias("ids_hash"), "round_trip")
