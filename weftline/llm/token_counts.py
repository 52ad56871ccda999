"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch are held as one ragged numpy array of symbols.
In each round every sequence merges its pair of lowest rank, all sequences at
once: everywhere in the sequence, from the left, since what a merge makes only
pairs at higher ranks. (Where a vocabulary has a piece for which that is not so,
the leftmost place alone.) What is left of the sequences that found a pair goes
into the next round, so the rounds are as many as the different ranks met. The
count of a text is the sum over its pre-tokens of the symbols that survive; a
character outside the vocabulary counts as its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import lean, pieces as P

NONE = np.int64(1) << 62


class Merger:
    def __init__(self, model: bytes | None, ids: dict[str, int] | None = None, scores: list[float] | None = None):
        if model is not None:
            p = P.pieces(model)
            ids, scores = p.ids, p.score
        symbols = list(ids)
        index = {t: i for i, t in enumerate(symbols)}
        for c in sorted({c for t in ids for c in t} - index.keys()):
            index[c] = len(symbols)
            symbols.append(c)
        self.size = len(symbols)
        self.cost = np.array([1 if t in ids else len(t.encode()) for t in symbols], np.int64)
        self.symbol = np.full(0x110000, -1, np.int32)
        for t, i in index.items():
            if len(t) == 1:
                self.symbol[ord(t)] = i
        score = np.array([scores[ids[t]] for t in symbols[: len(ids)]])
        rank = np.unique(-score, return_inverse=True)[1]
        left, right, made = [], [], []
        for t in ids:
            for k in range(1, len(t)):
                a, b = index.get(t[:k]), index.get(t[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(index[t])
        keys = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(made, np.int64)[order]
        self.rank = rank[self.made].astype(np.int64)
        # Ranks at which a merge makes a symbol that pairs at the same or a lower one.
        lowest = np.full(self.size, NONE)
        for part in (left, right):
            np.minimum.at(lowest, np.array(part, np.int64)[order], self.rank)
        self.alone = np.zeros(len(rank) + 1, bool)
        self.alone[rank[lowest[: len(rank)] <= rank]] = True

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no piece) and piece of each pair of symbols."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        ok = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(ok, self.rank[at], NONE), self.made[at]

    def count(self, tokens: list[str]) -> np.ndarray:
        """Symbols that survive in each token."""
        codes = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        sym = self.symbol[codes]
        width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        cost = np.where(sym >= 0, self.cost[sym], width)
        first = np.concatenate([[0], np.cumsum(lengths)])
        out = np.add.reduceat(np.append(cost, 0), first[:-1])
        out[lengths == 0] = 0
        some = np.flatnonzero(lengths > 1)
        step = 1 << 14
        for lo in range(0, len(some), step):
            part = some[lo : lo + step]
            n = lengths[part]
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            flat = np.arange(n.sum()) + np.repeat(first[part] - starts, n)
            out[part] += self._rounds(sym[flat], n)
        return out

    def _rounds(self, sym: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What merging changes in the cost of each of the sequences that lie one after another in sym."""
        change = np.zeros(len(lengths), np.int64)
        who = np.arange(len(lengths))
        rank, made = self.pairs(sym[:-1], sym[1:])
        rank, made = np.append(rank, NONE), np.append(made, 0)
        rank[np.cumsum(lengths) - 1] = NONE
        while True:
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            best = np.minimum.reduceat(rank, starts)
            live = best < NONE
            if not live.any():
                return change
            if not live.all():
                keep = np.repeat(live, lengths)
                sym, rank, made, lengths, who, best = sym[keep], rank[keep], made[keep], lengths[live], who[live], best[live]
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            hit = np.flatnonzero(rank == np.repeat(best, lengths))
            # Of places that overlap, every other one from the left.
            chain = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            pos = hit[(hit - hit[chain][np.cumsum(chain) - 1]) % 2 == 0]
            seq = np.searchsorted(starts, pos, "right") - 1
            if (one := self.alone[best]).any():
                leftmost = np.concatenate([[True], seq[1:] != seq[:-1]])
                pos, seq = pos[leftmost | ~one[seq]], seq[leftmost | ~one[seq]]
            np.add.at(change, who[seq], 1 - self.cost[sym[pos]] - self.cost[sym[pos + 1]])
            sym[pos] = made[pos]
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            pos -= np.arange(len(pos))
            sym, rank, made, lengths = sym[keep], rank[keep], made[keep], lengths - np.bincount(seq, minlength=len(lengths))
            ends = np.cumsum(lengths)
            starts = ends - lengths
            for at, ok in ((pos, pos < (ends - 1)[seq]), (pos - 1, pos > starts[seq])):
                at = at[ok]
                rank[at], made[at] = self.pairs(sym[at], sym[at + 1])
            rank[ends - 1] = NONE


@lru_cache(2)
def merger(model: bytes) -> Merger:
    return Merger(model)


class Counter:
    """Counts of texts, with those of the pre-tokens met last."""

    def __init__(self, model: bytes):
        self.merger, self.known, self.counts = merger(model), P.Known(), np.empty(0, np.int64)

    def __call__(self, column: pa.Array) -> np.ndarray:
        column = P.prefixed(column)
        out = np.zeros(len(column), np.int64)
        for w in P.pretokens(column):
            if self.known.n > self.known.most:
                self.known.clear()
                self.counts = self.counts[:0]
            hashes, at, back = np.unique(w.hashes, return_index=True, return_inverse=True)
            place, new = self.known.find(hashes)
            if len(new):
                got = self.merger.count([w.data[w.starts[i] : w.ends[i]].tobytes().decode().replace(" ", P.MARK) for i in at[new]])
                place[new] = self.known.add(hashes[new])
                self.counts = np.concatenate([self.counts, got])
            total = np.concatenate([[0], np.cumsum(self.counts[place][back])])
            out[w.rows.start : w.rows.stop] = total[w.first[1:]] - total[w.first[:-1]]
        return out


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) instead of all but doc_id.

    The counts are those of the library for the model file: begin, end and added
    tokens left out, control strings in a text taken as text, nothing cut off.
    A null or empty text has none. Repeated rows stay repeated; other columns,
    null ids and empty tables pass through.
    """
    spark = docs.sparkSession
    lean.small_batches(spark)
    with open(model or P.default_model(), "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for b in batches:
            count = count or Counter(sent.value)
            column = b.column(1)
            n = count(column)
            _, offs = P.words.string_buffers(column)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(lean.batches(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
