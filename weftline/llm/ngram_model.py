"""Interpolated modified Kneser-Ney model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Words are known by the 64-bit hashes of their lower-cased bytes; a word's id is
its place among all sorted hashes of the training words, BEGIN among them. In
front of a text stand order - 1 times BEGIN, so every token ends one n-gram of
the highest order. A level below counts for each n-gram the different words in
front of it.

The model lies in the folder that all executors share, one file for each range of
hashes and level: the sorted keys of n-grams with their counts, and the sorted
keys of contexts with the sum of their counts and how many are 1, 2, and more.
An n-gram lies in its context's range, so that a context is summed where it is
counted; but those whose context ends with a frequent word (or BEGIN) are spread
by their own hash, and their contexts' sums, one for each range, are added in a
second step. So no key makes a range larger than others. Each level's n-grams
give the next lower ones, already summed. Nothing is pruned: the model grows with
the training texts, and a worker reads only the pages that its batches touch.

Counts are summed within each task before they are dealt out, so a frequent word
costs one entry a task. There are as many partitions as ranges, so a task's share
does not grow with the input. Counts are kept in as many bytes as the largest of a file
needs, up to eight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lean, store, words
from .repeats import PACK, U64, by_range, ranges

BEGIN, END = U64(0x0B0E0A1D3C5F7712), U64(0x0E4D1A2B9C7F3346)
FOLDS = 10
ALPHA = 0.1
#: Words of context, and the word itself. With 3 the model takes more disk than the check tool allows; see README.
ORDER = 2
RANGE_BYTES = 8 << 20
_Q = U64(0xD6E8FEB86659FD93)


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    """Whether a row's text is kept from training; those without an id are not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def sequences(column: pa.Array) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Some rows at a time: the rows, their words each followed by END, and where each row's begin."""
    for w in words.split(column, lower=True):
        yield w.rows, np.insert(w.hashes, w.first[1:], END), w.first + np.arange(len(w.first))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


def _small(a: np.ndarray) -> np.ndarray:
    """a in as many bytes as its largest value needs."""
    return a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers as bytes, the first of all together, then the second: these compress."""
    a = _small(a)
    return bytes([a.itemsize]) + np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _unpack(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8, offset=1).reshape(x[0], -1).T).view(f"<u{x[0]}").ravel().astype(np.int64) for x in parts] or [np.empty(0, np.int64)])


def _keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the contexts and of the n-grams that the rows of ids are."""
    key = context = np.zeros(len(ids), U64)
    for i in range(ids.shape[1]):
        context = key
        key = words.mix(key * _Q + ids[:, i].astype(U64) + U64(1))
    return context, key


def _times(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4."""
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


@dataclass
class Model:
    """What is the same for all words; the arrays are at uri."""

    uri: str
    order: int
    n: int
    offsets: np.ndarray
    tokens: int
    types: int
    #: Counts from which on a word is frequent.
    often: int
    #: Of each level from 1: the discounts; whether a range has n-grams, contexts, and contexts that end with a frequent word.
    cuts: list[np.ndarray]
    there: list[dict[str, np.ndarray]]
    #: Different pairs, and how many words follow 1, 2, and more different ones.
    pairs: int
    low_times: np.ndarray


class Vocabulary:
    """Mapped arrays of words."""

    def __init__(self, uri: str, n: int, offsets: np.ndarray):
        self.n, self.offsets, self.files = n, offsets, store.Files(uri)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes; -1 for words not seen in training."""
        out = np.full(len(h), -1, np.int64)
        for r, at in by_range(h, self.n):
            if self.offsets[r + 1] > self.offsets[r]:
                have = self.files(f"w-{r}")["h"]
                i = np.searchsorted(have, h[at])
                i[i == len(have)] = 0
                out[at] = np.where(have[i] == h[at], i + self.offsets[r], -1)
        return out

    def parts(self, ids: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The ranges of ascending ids, and where each lies."""
        if len(ids):
            r = np.searchsorted(self.offsets, ids, "right") - 1
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(r)]):
                yield int(r[i]), slice(i, j)

    def of(self, file: str, ids: np.ndarray, there: np.ndarray | None = None) -> np.ndarray:
        """The counts of a file for ascending ids; 0 in ranges that have none."""
        out = np.zeros(len(ids), np.int64)
        for r, s in self.parts(ids):
            if there is None or there[r]:
                out[s] = self.files(f"{file}-{r}")["c"][ids[s] - self.offsets[r]]
        return out


def _discounts(times: np.ndarray) -> np.ndarray:
    """D(0), D(1), D(2), D(3 and more) from how many counts are 1 to 4; where these are too few, one half."""
    n1, n2, n3, n4 = (float(x) for x in times)
    if not n1 or not n2 or not n3:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, 0.0, [0.0, 1.0, 2.0, 3.0])


class Numbered:
    """Rows of texts as ids of their words and of those in front of each."""

    def __init__(self, v: Vocabulary, order: int, often: int):
        self.v, self.order, self.often = v, order, often

    def __call__(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids (order columns, the word last, -1 where unknown), whether the word in front is frequent, all ids, counts, and each word's place in these."""
        u, back = np.unique(np.append(h, BEGIN), return_inverse=True)
        known = self.v.ids(u)
        count = np.zeros(len(u), np.int64)
        have = known >= 0
        count[have] = self.v.of("w", known[have])
        begin = back[-1]
        back = back[:-1]
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        since = np.arange(len(h)) - first[row]
        ids = np.empty((len(h), self.order), np.int64)
        for j in range(self.order):
            at = np.where(since >= j, back[np.maximum(np.arange(len(h)) - j, 0)], begin)
            ids[:, self.order - 1 - j] = known[at]
            if j == 1:
                hot = (count[at] >= self.often) | (at == begin)
        return ids, hot, known, count, back


def _place(ids: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of contexts and n-grams, and what decides the range."""
    context, key = _keys(ids)
    return context, key, np.where(hot, key, context)


_DEALT = "r int, hot boolean, ids binary, c binary"


def _deal(ids: np.ndarray, hot: np.ndarray, counts: np.ndarray, n: int) -> tuple[list, list, list, list]:
    """Different n-grams with their counts, dealt out."""
    _, key, place = _place(ids, hot)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    counts = np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    ids, hot, place = (x[order[at]] for x in (ids, hot, place))
    out: tuple[list, list, list, list] = ([], [], [], [])
    for flag in (False, True):
        some = np.flatnonzero(hot == flag)
        for r, x in by_range(place[some], n):
            x = some[x]
            x = x[np.lexsort(ids[x].T[::-1])]
            for column, value in zip(out, (r, flag, _pack(ids[x].T.ravel()), _pack(counts[x]))):
                column.append(value)
    return out


def _dealt(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, hot and counts again."""
    ids = [_unpack([x]).reshape(k, -1).T for x in table.column("ids").to_pylist()]
    hot = np.repeat(np.array(table.column("hot").to_pylist(), bool), [len(x) for x in ids])
    return np.concatenate(ids), hot, _unpack(table.column("c").to_pylist())


def _sums(context: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Contexts in order, the sum of their counts, and how many are 1, 2, and more."""
    order = np.argsort(context, kind="stable")
    context, counts = context[order], counts[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(context)), bool), context[1:] != context[:-1]]))
    add = lambda x: np.add.reduceat(x.astype(np.int64), at) if len(at) else np.empty(0, np.int64)
    return {"x": context[at], "t": add(counts), "n1": add(counts == 1), "n2": add(counts == 2), "n3": add(counts > 2)}


def _put_sums(uri: str, name: str, sums: dict[str, np.ndarray]) -> None:
    store.put(uri, name, x=sums["x"], **{c: _small(sums[c]) for c in ("t", "n1", "n2", "n3")})


def _flags(n: int, rs: list[int]) -> np.ndarray:
    out = np.zeros(n, bool)
    out[rs] = True
    return out


_LEVEL = f"kind int, {_DEALT}, x binary, told array<long>"


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """The model of all rows of texts (one string column), of n-grams of 2 or more words."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = texts.sparkSession
    lean.small_batches(spark)
    n = ranges(texts, RANGE_BYTES)
    uri = store.folder(spark, "ngram")

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = np.array([BEGIN]), np.zeros(1, np.int64)
        kept, size = [begin], 0

        def send(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            cols = list(zip(*((r, keys[at].tobytes(), _pack(counts[at])) for r, at in by_range(keys, n))))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["r", "k", "c"])

        for b in batches:
            for _, h, _ in sequences(b.column(0)):
                kept.append(np.unique(h, return_counts=True))
                size += len(kept[-1][0])
                if size >= PACK:
                    kept = [_summed(*(np.concatenate(x) for x in zip(*kept)))]
                    size = 0
                    if len(kept[0][0]) >= PACK:
                        yield send(*kept[0])
                        kept = [begin]
        yield send(*_summed(*(np.concatenate(x) for x in zip(*kept))))

    def vocabulary(table: pa.Table) -> pa.Table:
        h, c = _summed(np.concatenate([np.frombuffer(x, U64) for x in table.column("k").to_pylist()]), _unpack(table.column("c").to_pylist()))
        r = table.column("r")[0].as_py()
        store.put(uri, f"w-{r}", h=h, c=_small(c))
        return pa.table({"r": pa.array([r], pa.int32()), "ids": pa.array([len(h)]), "types": pa.array([int((c > 0).sum())]), "tokens": pa.array([int(c.sum())])})

    sizes = texts.mapInArrow(lean.batches(word_counts), "r int, k binary, c binary").repartition(n, "r").groupBy("r").applyInArrow(lean.group(vocabulary), "r int, ids long, types long, tokens long")
    sizes = sizes.toPandas()  # a row for each range
    offsets = np.zeros(n + 1, np.int64)
    offsets[sizes.r.to_numpy(np.int64) + 1] = sizes.ids
    offsets = np.cumsum(offsets)
    types, tokens = int(sizes.types.sum()), int(sizes.tokens.sum())
    often = max(2, tokens // (2 * n))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbered(Vocabulary(uri, n, offsets), order, often)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> pa.RecordBatch:
            cols = _deal(*(np.concatenate(x) for x in zip(*kept)), n)
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["r", "hot", "ids", "c"])

        for b in batches:
            for _, h, first in sequences(b.column(0)):
                ids, hot, *_ = number(h, first)
                _, at, counts = np.unique(_keys(ids)[1], return_index=True, return_counts=True)
                kept.append((ids[at], hot[at], counts))
                size += len(at)
                if size >= 4 * PACK:
                    yield send()
                    size = 0
        if kept:
            yield send()

    def level(k: int):
        def run(table: pa.Table) -> pa.Table:
            r = table.column("r")[0].as_py()
            ids, hot, counts = _dealt(table, k)
            context, key, _ = _place(ids, hot)
            by = np.argsort(key, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
            counts = np.add.reduceat(counts[by], at)
            ids, hot, context, key = (x[by[at]] for x in (ids, hot, context, key))
            store.put(uri, f"g{k}-{r}", k=key, c=_small(counts))
            if (~hot).any():
                _put_sums(uri, f"x{k}-{r}", _sums(context[~hot], counts[~hot]))
            out = [(0, r, False, None, None, None, [*_times(counts), len(counts), int((~hot).any())])]
            # Each of these has another word in front of what is left of it.
            if k > 2:
                out += [(1, *x, None, None) for x in zip(*_deal(ids[:, 1:], hot, np.ones(len(ids), np.int64), n))]
            else:
                last, follow = np.unique(ids[:, 1], return_counts=True)
                out += [(1, x, False, _pack(last[s]), _pack(follow[s]), None, None) for x, s in Vocabulary(uri, n, offsets).parts(last)]
            if hot.any():
                sums = _sums(context[hot], counts[hot])
                numbers = np.stack([sums[c] for c in ("t", "n1", "n2", "n3")])
                out += [(2, x, True, None, _pack(numbers[:, s].ravel()), sums["x"][s].tobytes(), None) for x, s in by_range(sums["x"], n)]
            cols = list(zip(*out))
            kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            return pa.table({name: pa.array(c, t) for name, c, t in zip(("kind", "r", "hot", "ids", "c", "x", "told"), cols, kinds)})

        return run

    def contexts(k: int):
        def run(table: pa.Table) -> pa.Table:
            r = table.column("r")[0].as_py()
            x = np.concatenate([np.frombuffer(b, U64) for b in table.column("x").to_pylist()])
            numbers = np.concatenate([_unpack([b]).reshape(4, -1) for b in table.column("c").to_pylist()], axis=1)
            by = np.argsort(x, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], x[by][1:] != x[by][:-1]]))
            numbers = np.add.reduceat(numbers[:, by], at, axis=1)
            _put_sums(uri, f"y{k}-{r}", {"x": x[by][at], **dict(zip(("t", "n1", "n2", "n3"), numbers))})
            return pa.table({"r": pa.array([r], pa.int32())})

        return run

    def followed(table: pa.Table) -> pa.Table:
        r = table.column("r")[0].as_py()
        low = np.zeros(int(offsets[r + 1] - offsets[r]), np.int64)
        np.add.at(low, _unpack(table.column("ids").to_pylist()) - offsets[r], _unpack(table.column("c").to_pylist()))
        store.put(uri, f"k-{r}", c=_small(low))
        return pa.table({"t": pa.array([[*_times(low), int((low > 2).sum()), r]], pa.list_(pa.int64()))})

    none = np.zeros(n, bool)
    cuts, there = [np.zeros(4)] * order, [{"g": none, "x": none, "y": none} for _ in range(order)]
    dealt, stored, pairs = texts.mapInArrow(lean.batches(grams), _DEALT), None, 0
    for k in range(order, 1, -1):
        before, stored = stored, store.written(spark, dealt.repartition(n, "r").groupBy("r").applyInArrow(lean.group(level(k)), _LEVEL), f"ngram-{k}")
        if before is not None:
            store.forget(before)
        told = stored.where("kind = 0").select("r", "told").toPandas()  # a row for each range
        numbers = np.array(told.told.tolist(), np.int64).reshape(-1, 6)
        rs = told.r.to_numpy(np.int64)
        merged = stored.where("kind = 2").repartition(n, "r").groupBy("r").applyInArrow(lean.group(contexts(k)), "r int").toPandas()  # the same
        there[k - 1] = {"g": _flags(n, rs), "x": _flags(n, rs[numbers[:, 5] > 0]), "y": _flags(n, merged.r.to_numpy(np.int64))}
        cuts[k - 1], pairs = _discounts(numbers[:, :4].sum(axis=0)), int(numbers[:, 4].sum())
        dealt = stored.where("kind = 1").select("r", "hot", "ids", "c")
    told = np.array(dealt.repartition(n, "r").groupBy("r").applyInArrow(lean.group(followed), "t array<long>").toPandas().t.tolist(), np.int64).reshape(-1, 6)
    store.forget(stored)
    low = told.sum(axis=0)
    cuts[0], there[0] = _discounts(low[:4]), {"k": _flags(n, told[:, 5])}
    return Model(uri, order, n, offsets, tokens, types, often, cuts, there, pairs, np.array([low[0], low[1], low[4]], np.float64))


class Scorer:
    """log10 probabilities of token sequences."""

    def __init__(self, m: Model):
        self.m, self.v = m, Vocabulary(m.uri, m.n, m.offsets)
        self.number = Numbered(self.v, m.order, m.often)

    def __call__(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its training count, base score and score."""
        m = self.m
        ids, hot, known, c, back = self.number(h, first)
        base = np.log10((c + ALPHA) / (m.tokens + ALPHA * (m.types + 1)))
        new = 1.0 / (m.types + 1)
        if m.pairs:
            low = np.zeros(len(known), np.int64)
            have = known >= 0
            low[have] = self.v.of("k", known[have], m.there[0]["k"])
            spare = float(m.cuts[0][1:] @ m.low_times) / m.pairs
            p = (np.maximum(low - m.cuts[0][np.minimum(low, 3)], 0) / m.pairs + spare * new)[back]
        else:
            p = np.full(len(h), new)
        for k in range(2, m.order + 1):
            p = self._level(k, ids[:, m.order - k :], hot, p)
        return c[back], base[back], np.log10(p)

    def _level(self, k: int, ids: np.ndarray, hot: np.ndarray, p: np.ndarray) -> np.ndarray:
        """p of k-grams from those of the words' shorter contexts; they stay where the context was not seen."""
        m, cut = self.m, self.m.cuts[k - 1]
        some = np.flatnonzero((ids[:, :-1] >= 0).all(axis=1))
        context, key, place = _place(ids[some], hot[some])
        t, n1, n2, n3 = (np.zeros(len(some), np.int64) for _ in range(4))
        for name, which in (("x", ~hot[some]), ("y", hot[some])):
            at = np.flatnonzero(which)
            for out, got in zip((t, n1, n2, n3), self._find(f"{name}{k}", m.there[k - 1][name], context[at], context[at], "x", ("t", "n1", "n2", "n3"))):
                out[at] = got
        there = np.flatnonzero((ids[some, -1] >= 0) & (t > 0))
        count = np.zeros(len(some), np.int64)
        (count[there],) = self._find(f"g{k}", m.there[k - 1]["g"], place[there], key[there], "k", ("c",))
        seen = t > 0
        out, total = p.copy(), np.maximum(t, 1)
        rest = (cut[1] * n1 + cut[2] * n2 + cut[3] * n3) / total
        out[some[seen]] = (np.maximum(count - cut[np.minimum(count, 3)], 0) / total + rest * p[some])[seen]
        return out

    def _find(self, file: str, there: np.ndarray, place: np.ndarray, keys: np.ndarray, by: str, names: tuple[str, ...]) -> list[np.ndarray]:
        """The values of keys; 0 for those that are not there."""
        u, at, back = np.unique(keys, return_index=True, return_inverse=True)
        out = [np.zeros(len(u), np.int64) for _ in names]
        for x, i in by_range(place[at], self.m.n):
            if there[x]:
                arrays = self.v.files(f"{file}-{x}")
                have = arrays[by]
                j = np.searchsorted(have, u[i])
                j[j == len(have)] = 0
                hit = have[j] == u[i]
                for o, name in zip(out, names):
                    o[i[hit]] = arrays[name][j[hit]]
        return [o[back] for o in out]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    lean.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # a few numbers for each range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            for rows, h, first in sequences(b.column(2)):
                c, base, got = scorer(h, first)
                sums = [np.add.reduceat(x, first[:-1]) for x in ((c > 0).astype(np.int64), base, got)]
                part = b.slice(rows.start, len(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first)), pa.array(sums[0]), pa.array(np.full(len(rows), sent.value.tokens)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), text).mapInArrow(lean.batches(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(docs: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """Every row scored by the model of the rows that are not held out.

    A null or empty text is its end alone. Rows without an id train; repeated
    rows train as often as they occur. With nothing to train on, every token has
    the probability of an unseen word. Other columns are left out.
    """
    return score(docs, train(docs.where(~held_out()).select(text), order), text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores are rounded to 6 digits after the point: sums of logarithms differ beyond, by the order of adding."""
    out = perplexity(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS ws FROM documents
), crc AS (
  SELECT d AS doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(d::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b:
    list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS r
  FROM (SELECT DISTINCT doc_id AS d FROM documents)
), tok AS (
  SELECT id, unnest(ws) AS w, unnest(list_prepend('', ws[:-2])) AS v FROM doc
), held AS (
  SELECT id, doc.doc_id, xor(r, 4294967295::BIGINT) % 10 = 0 AS held_out FROM doc JOIN crc USING (doc_id)
), train AS (
  SELECT w, v FROM tok JOIN held USING (id) WHERE NOT held_out
), uni AS (
  SELECT w, count(*) AS c FROM train GROUP BY w
), bi AS (
  SELECT v, w, count(*) AS c FROM train GROUP BY v, w
), ctx AS (
  SELECT v, sum(c) AS t, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c > 2) AS n3 FROM bi GROUP BY v
), fol AS (
  SELECT w, count(*) AS k FROM bi GROUP BY w
), g AS (
  SELECT (SELECT count(*) FROM uni) AS types, (SELECT sum(c) FROM uni) AS total, (SELECT count(*) FROM bi) AS pairs
), nb AS (
  SELECT count(*) FILTER (c = 1) AS a, count(*) FILTER (c = 2) AS b, count(*) FILTER (c = 3) AS d, count(*) FILTER (c = 4) AS e FROM bi
), nf AS (
  SELECT count(*) FILTER (k = 1) AS a, count(*) FILTER (k = 2) AS b, count(*) FILTER (k = 3) AS d, count(*) FILTER (k = 4) AS e, count(*) FILTER (k > 2) AS m FROM fol
), cut AS (
  SELECT 1 - 2 * a / (a + 2 * b) * b / a AS d1, 2 - 3 * a / (a + 2 * b) * d / b AS d2, 3 - 4 * a / (a + 2 * b) * e / d AS d3 FROM nb
), low AS (
  SELECT *, e1 * a + e2 * b + e3 * m AS spare FROM (SELECT a, b, m, 1 - 2 * a / (a + 2 * b) * b / a AS e1, 2 - 3 * a / (a + 2 * b) * d / b AS e2, 3 - 4 * a / (a + 2 * b) * e / d AS e3 FROM nf)
), p AS (
  SELECT tok.id, coalesce(uni.c, 0) AS n, coalesce(bi.c, 0) AS c, ctx.t, ctx.n1, ctx.n2, ctx.n3,
    greatest(coalesce(k, 0) - CASE coalesce(k, 0) WHEN 0 THEN 0 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END, 0) / pairs + spare / pairs / (types + 1) AS q
  FROM tok CROSS JOIN g CROSS JOIN low LEFT JOIN uni ON uni.w = tok.w LEFT JOIN fol ON fol.w = tok.w LEFT JOIN ctx ON ctx.v = tok.v LEFT JOIN bi ON bi.v = tok.v AND bi.w = tok.w
)
SELECT held.doc_id, held.held_out, count(*) AS n_tokens, count(*) FILTER (n > 0) AS n_known, any_value(total)::BIGINT AS train_tokens,
  round(sum(log10((n + 0.1) / (total + 0.1 * (types + 1)))), 6) AS base_score,
  round(sum(log10(CASE WHEN t IS NULL THEN q ELSE greatest(c - CASE c WHEN 0 THEN 0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) / t + (d1 * n1 + d2 * n2 + d3 * n3) / t * q END)), 6) AS score
FROM p JOIN held USING (id) CROSS JOIN g CROSS JOIN cut GROUP BY id, held.doc_id, held.held_out
"""
