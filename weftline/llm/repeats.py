"""Substring dedup by fixed-block anchors: words in passages that occur elsewhere are removed.

The index holds the hash of every BLOCK consecutive words at multiples of BLOCK
in each document. Every window of WINDOW = 2 * BLOCK - 1 words holds one of
these whole, so of any two equal windows the one's block is met by a rolling
window of BLOCK words in the other. All rolling windows probe the index; where
one hits a block other than itself, the windows around it are extended to WINDOW
words, and those whose words occur twice are joined to maximal repeats.

The index is kept as bit maps, one file per range of hashes, in the folder that
all executors share, and mapped by the workers: a hit may be false, never
missing. Extension is exact up to the collision of 64-bit hashes. No pairs of
occurrences are made: each task sends a window's hash once, however often it
meets it, with the places of those it met once, so a passage found everywhere
costs one entry a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lean, store, words

BLOCK = 18
WINDOW = 2 * BLOCK - 1
BITS_PER_BLOCK = 16
PROBES = 4
#: Entries that a task gathers before it sends them.
PACK = 1 << 20
#: Bytes of input for each range of hashes.
RANGE_BYTES = 4 << 20

U64 = np.uint64


def ranges(df: DataFrame, each: int = RANGE_BYTES) -> int:
    """A power of two, one for each so many bytes of the input, as the planner knows its size; beyond 2**14 they grow with its root, as a range does."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # unknown
        size = df.rdd.getNumPartitions() * each
    bits = (size // each).bit_length()
    return 1 << max(2, bits if bits <= 14 else 14 + (bits - 13) // 2)


def _range_of(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> U64(64 - (n.bit_length() - 1))).astype(np.int64)


def by_range(h: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Ranges that have hashes, and which."""
    if not len(h):
        return
    r = _range_of(h, n)
    order = np.argsort(r, kind="stable")
    r = r[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(r)]):
        yield int(r[i]), order[i:j]


def _bit(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    x = words.mix(h + U64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
    return (x & U64(bits - 1)).astype(np.int64)


def bit_map(h: np.ndarray) -> np.ndarray:
    bits = 1 << max(10, (len(h) * BITS_PER_BLOCK - 1).bit_length())
    out = np.zeros(bits // 8, np.uint8)
    for k in range(PROBES):
        at = _bit(h, k, bits)
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def in_map(m: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.arange(len(h))
    for k in range(PROBES):
        at = _bit(h[found], k, len(m) * 8)
        found = found[(m[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        if not len(found):
            break
    out = np.zeros(len(h), bool)
    out[found] = True
    return out


def windows(w: words.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (word index), rows and hashes of the runs of k words that lie in one document."""
    h = words.runs(w.hashes, k)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64), h
    row = np.repeat(np.arange(len(w.rows)), np.diff(w.first))
    at = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1])
    return at, row[at], h[at]


def _blobs(column) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, U64) for x in column.to_pylist()] or [np.empty(0, U64)])


def _index(docs: DataFrame, n: int, block: int, window: int, uri: str, text: str) -> None:
    """Write the bit maps of all blocks, and of blocks that occur twice."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size = 0

        def send() -> pa.RecordBatch:
            h = np.concatenate(kept)
            kept.clear()
            out = [(k, np.sort(h[at]).tobytes()) for k, at in by_range(h, n)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["r", "h"])

        for b in batches:
            for w in words.split(b.column(0)):
                at, row, h = windows(w, block)
                first = w.first[row]
                h = h[((at - first) % block == 0) & (w.first[row + 1] - first >= window)]
                if len(h):
                    kept.append(h)
                    size += len(h)
                if size >= PACK:
                    yield send()
                    size = 0
        if kept:
            yield send()

    def write(table: pa.Table) -> pa.Table:
        h, count = np.unique(_blobs(table.column("h")), return_counts=True)
        k = table.column("r")[0].as_py()
        store.put(uri, str(k), one=bit_map(h), two=bit_map(h[count > 1]))
        return pa.table({"r": pa.array([k], pa.int32()), "n": pa.array([len(h)], pa.int64())})

    docs.select(text).mapInArrow(lean.batches(blocks), "r int, h binary").repartition(n, "r").groupBy("r").applyInArrow(lean.group(write), "r int, n long").write.parquet(f"{uri}/ranges")


class _Probe:
    """The mapped bit maps."""

    def __init__(self, uri: str, n: int, present: set[int]):
        self.n, self.present, self.files = n, present, store.Files(uri)

    def __call__(self, h: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which hashes are of a block; for those that are blocks themselves (own), of another one."""
        out = np.zeros(len(h), bool)
        for k, at in by_range(h, self.n):
            if k in self.present:
                one, two = self.files(str(k)).values()
                mine = own[at]
                out[at[~mine]] = in_map(one, h[at[~mine]])
                out[at[mine]] = in_map(two, h[at[mine]])
        return out


def _candidates(w: words.Words, probe: _Probe | None, block: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts in the row, and hashes of the windows that hold a hit; without an index, of all."""
    if probe is None:
        at, row, h = windows(w, window)
        return row, at - w.first[row], h
    at, row, h = windows(w, block)
    fits = w.first[row + 1] - w.first[row] >= window
    at, row, h = at[fits], row[fits], h[fits]
    hit = np.zeros(len(w.hashes) + 1, np.int64)
    hit[at[probe(h, (at - w.first[row]) % block == 0)]] = 1
    total = np.concatenate([[0], np.cumsum(hit)])
    at, row, h = windows(w, window)
    some = total[at + window - block + 1] > total[at]
    at, row, h = at[some], row[some], h[some]
    return row, at - w.first[row], h


def repeats(docs: DataFrame, block: int = BLOCK, text: str = "text", indexed: bool = True) -> DataFrame:
    """_k, starts and ends (binary int32): the runs of words, in the rows of key _k, that lie in a repeated window.

    indexed=False is for inputs whose index workers can't map: nothing is sorted
    out then, and every window's hash is dealt out, about 14 bytes a word.
    """
    spark = docs.sparkSession
    lean.small_batches(spark)
    window = 2 * block - 1
    n = ranges(docs)
    uri = store.folder(spark, "blocks")
    if indexed:
        _index(docs, n, block, window, uri, text)
    present = not indexed or {x.r for x in spark.read.schema("r int, n long").parquet(f"{uri}/ranges").select("r").collect()}  # at most n small numbers

    schema = "r int, h binary, many binary, keys binary, pos binary"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _Probe(uri, n, present) if indexed else None
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> pa.RecordBatch:
            keys, pos, h = (np.concatenate(x) for x in zip(*kept))
            kept.clear()
            _, at, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            out = []
            # Met once here: the hash with its place. Met more often: the hash, marked; the places go by document.
            again = count > 1
            for k, x in by_range(h[at], n):
                x = x[np.lexsort((pos[at[x]], keys[at[x]]))]
                out.append((k, h[at[x]].tobytes(), again[x].tobytes(), keys[at[x]].tobytes(), pos[at[x]].tobytes()))
            known = np.flatnonzero(again[back])
            for k, x in by_range(words.mix(keys[known]), n):
                x = known[x]
                x = x[np.lexsort((pos[x], keys[x]))]
                out.append((k, b"", b"", keys[x].tobytes(), pos[x].tobytes()))
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["r", "h", "many", "keys", "pos"])

        for b in batches:
            key = b.column(1).to_numpy(zero_copy_only=False).view(U64)
            for w in words.split(b.column(0)):
                row, pos, h = _candidates(w, probes, block, window)
                if len(h):
                    kept.append((key[w.rows.start + row], pos.astype(np.int32), h))
                    size += len(h)
                if size >= PACK:
                    yield send()
                    size = 0
        if kept:
            yield send()

    def count(table: pa.Table) -> pa.Table:
        parts = {c: table.column(c).to_pylist() for c in ("h", "many", "keys", "pos")}
        asked = [i for i, x in enumerate(parts["h"]) if x]
        told = [i for i, x in enumerate(parts["h"]) if not x]
        get = lambda c, which, t: np.concatenate([np.frombuffer(parts[c][i], t) for i in which] or [np.empty(0, t)])
        h, many = get("h", asked, U64), get("many", asked, bool)
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        twice = times > 1
        twice[back[many]] = True
        hit = twice[back] & ~many
        keys = np.concatenate([get("keys", asked, U64)[hit], get("keys", told, U64)])
        pos = np.concatenate([get("pos", asked, np.int32)[hit], get("pos", told, np.int32)])
        out = []
        for k, x in by_range(words.mix(keys), n):
            x = x[np.lexsort((pos[x], keys[x]))]
            out.append((k, keys[x].tobytes(), pos[x].tobytes()))
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({"b": pa.array(cols[0], pa.int32()), "keys": pa.array(cols[1], pa.binary()), "pos": pa.array(cols[2], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        keys = _blobs(table.column("keys"))
        pos = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("pos").to_pylist()]).astype(np.int64)
        order = np.lexsort((pos, keys))
        keys, pos = keys[order], pos[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (pos[1:] > pos[:-1] + window)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(keys)) - 1
        starts, ends, k = pos[at].astype(np.int32), (pos[last] + window).astype(np.int32), keys[at]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        cut = np.append(first, len(k))
        both = [[a[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])] for a in (starts, ends)]
        return pa.table({"_k": pa.array(k[first].view(np.int64)), "starts": pa.array(both[0], pa.binary()), "ends": pa.array(both[1], pa.binary())})

    found = docs.select(text, F.xxhash64("doc_id", text).alias("_k")).mapInArrow(lean.batches(probe), schema)
    # As many partitions as ranges, so that a task's share does not grow with the input.
    places = found.repartition(n, "r").groupBy("r").applyInArrow(lean.group(count), "b int, keys binary, pos binary")
    return places.repartition(n, "b").groupBy("b").applyInArrow(lean.group(merge), "_k long, starts binary, ends binary")


def without_repeats(docs: DataFrame, block: int = BLOCK, text: str = "text", indexed: bool = True) -> DataFrame:
    """doc_id, text without repeated words, n_words and n_removed of each row.

    Of every window of 2 * block - 1 words that occurs twice or more, in one
    document or several, all words go, in all its occurrences; what is kept is
    joined by single spaces. A null or empty text has no words and gives an empty
    text. Repeated rows repeat each other's windows. Null ids and empty tables
    pass through, other columns are left out.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, totals, removed = [], [], []
            for t, s, e in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                ws = (t or "").encode().split()
                n = len(ws)
                if s:
                    at, kept = 0, []
                    for i, j in zip(np.frombuffer(s, np.int32).tolist(), np.frombuffer(e, np.int32).tolist()):
                        kept += ws[at:i]
                        at = j
                    ws = kept + ws[at:]
                texts.append(b" ".join(ws).decode())
                totals.append(n)
                removed.append(n - len(ws))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    rows = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64("doc_id", text).alias("_k"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.join(repeats(docs, block, text, indexed), "_k", "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(lean.batches(cut), f"doc_id {kind}, text string, n_words long, n_removed long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS cut FROM dup GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(ws) AS n_words,
    CASE WHEN cut IS NULL THEN ws ELSE list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN list_contains(cut, i) THEN NULL ELSE ws[i] END), lambda x: x IS NOT NULL) END AS k
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, n_words - len(k) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
