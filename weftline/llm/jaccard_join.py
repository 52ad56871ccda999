"""N-gram Jaccard join with prefix filters under several global orders.

A document's set is its distinct shingles of K words. Two sets whose Jaccard
similarity reaches the threshold share a token among the first
s - ceil(threshold * s) + 1 of each, under any order of all tokens. Under the
first order these prefixes are dealt out by token; sets that meet are candidates
where what follows the token in both can make up the overlap that their sizes ask
for. The prefixes under two more orders lie beside the sets in mapped files. A
candidate pair must meet in each of them as well, and only the pairs that all
orders let through have their sets read and verified.

Equal sets form one class. Groups of similar sets are not expanded into pairs: in
rounds, each bucket's members are compared with one of them, and buckets whose
members are connected by then are done and not read again. Of what is left, a bucket with more pairs
than its members' prefixes have tokens is dealt out again by each token of the
prefix under the second order, so that only sets which share tokens of both are
paired; the pairs of the others are fewer than that. So no link between classes
of different components stays unseen.

All orders put tokens of many documents last, and differ in the hash that orders
tokens as frequent. They need no exact frequencies, only the same answer
everywhere: the tokens that tasks meet often are counted, and kept by range of
hashes in mapped files; all others come first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import components, lean, store, words
from .columns import aside
from .repeats import PACK, U64, bit_map, by_range, in_map, ranges

K = 5
#: Percent.
THRESHOLD = 75
#: A task reports tokens that it meets in so many documents.
OFTEN = 4
#: What the orders differ in; the first deals out, the others filter.
ORDERS = (0x9E3779B97F4A7C15, 0x51ED270B7A8F3D15, 0x2545F4914F6CDD1D)
#: In a task, the members of a token found in more sets than this are dealt out by set, not by token.
MANY = 16
ROUNDS = 6
#: A round moves each open member about so many times (labels, counts, pairs, links); as many pairs a member cost no more.
ROUND_MOVES = 4
#: Bytes of input for each range of tokens.
BUCKET_BYTES = 4 << 20
_AT = "struct<pack:string,lo:long,hi:long,from:long,to:long>"
GOLD = U64(0x9E3779B97F4A7C15)


def shingles(column: pa.Array, k: int = K) -> Iterator[tuple[words.Words, np.ndarray, np.ndarray]]:
    """Some rows at a time: rows (within them) and hashes of their distinct shingles, by row and hash."""
    for w in words.split(column, lower=True):
        n = np.diff(w.first)
        row = np.repeat(np.arange(len(n)), n)
        h = words.runs(w.hashes, k)
        inside = row[k - 1 :] == row[: len(row) - k + 1] if len(h) else np.empty(0, bool)
        short = np.flatnonzero((n > 0) & (n < k))
        h = np.concatenate([h[inside], np.array([words.whole(w.hashes[w.of(i)]) for i in short], U64)])
        row = np.concatenate([row[: len(inside)][inside], short])
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield w, row[first], h[first]


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, U64)
    np.cumsum(x, out=out[1:])
    return out


def prints(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each row's set, and its class (0: empty)."""
    size = np.bincount(row, minlength=n)
    edge = np.concatenate([[0], np.cumsum(size)])
    total, more = _sums(words.mix(h)), _sums(words.mix(h ^ GOLD))
    fp = words.mix(total[edge[1:]] - total[edge[:-1]]) ^ words.mix(words.mix(more[edge[1:]] - more[edge[:-1]]) + size.astype(U64))
    fp[size == 0] = 0
    return size, fp


def prefix_length(size: np.ndarray, percent: int = THRESHOLD) -> np.ndarray:
    return size - -(-size * percent // 100) + 1


def first_of(row: np.ndarray, key: np.ndarray, size: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Places of each row's first tokens by key; row ascends."""
    order = np.lexsort((key, row))
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    nth = np.arange(len(row)) - start[row]
    return order[nth < take[row]]


class Order:
    """The orders: 0 to 63 for how many documents have a token, as far as counted, then a hash."""

    def __init__(self, uri: str, n: int, there: set[int]):
        self.n, self.there, self.files = n, there, store.Files(uri)

    def levels(self, h: np.ndarray) -> np.ndarray:
        u, back = np.unique(h, return_inverse=True)
        level = np.zeros(len(u), U64)
        for r, at in by_range(u, self.n):
            if r in self.there:
                have, known = self.files(f"often-{r}").values()
                i = np.searchsorted(have, u[at])
                i[i == len(have)] = 0
                level[at] = np.where(have[i] == u[at], known[i], 0)
        return level[back]

    def __call__(self, h: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
        return (level << U64(58)) | (words.mix(h + U64(ORDERS[order])) >> U64(6))


def _read(docs: DataFrame, k: int, text: str) -> DataFrame:
    """doc_id, _k, s and fp of each row; and, where h is not null, the tokens that tasks meet often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size_kept = 0
        names = ["doc_id", "_k", "s", "fp", "h", "n"]

        def nulls(n: int, kind) -> pa.Array:
            return pa.nulls(n, kind)

        def send(kind) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            some = n >= OFTEN
            m = int(some.sum())
            return pa.RecordBatch.from_arrays([nulls(m, kind), *(nulls(m, pa.int64()) for _ in range(3)), pa.array(h[some].view(np.int64)), pa.array(n[some])], names=names)

        for b in batches:
            kind = b.column(0).type
            for w, row, h in shingles(b.column(2), k):
                size, fp = prints(row, h, len(w.rows))
                part = b.slice(w.rows.start, len(w.rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), pa.array(fp.view(np.int64)), *(nulls(len(size), pa.int64()) for _ in range(2))], names=names)
                kept.append(h)
                size_kept += len(h)
                if size_kept >= 4 * PACK:
                    yield send(kind)
                    size_kept = 0
        if kept:
            yield send(kind)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("_k"), text).mapInArrow(lean.batches(run), f"doc_id {kind}, _k long, s long, fp long, h long, n long")


def _order(often: DataFrame, n: int, uri: str) -> set[int]:
    """Write the tokens that come last, by range of their hashes; the ranges that have any."""

    def write(table: pa.Table) -> pa.Table:
        r = table.column("r")[0].as_py()
        h, at = np.unique(table.column("h").to_numpy().view(U64), return_inverse=True)
        count = np.bincount(at, table.column("n").to_numpy())
        store.put(uri, f"often-{r}", h=h, level=np.minimum(1 + np.log2(count).astype(np.int64), 63).astype(np.uint8))
        return pa.table({"r": pa.array([r], pa.int32())})

    spread = F.shiftrightunsigned("h", 64 - (n.bit_length() - 1)).cast("int").alias("r")
    dealt = often.groupBy(spread, "h").agg(F.sum("n").alias("n"))
    return {x.r for x in dealt.groupBy("r").applyInArrow(lean.group(write), "r int").collect()}  # at most n small numbers


def _buckets(docs: DataFrame, k: int, percent: int, uri: str, there: set[int], text: str) -> DataFrame:
    """b, fp, s and i: the classes that share a token of their prefixes, their size and its place in their prefix.

    All tokens of a range that the same classes share are one b, with the place
    of the first.
    """
    n = ranges(docs, BUCKET_BYTES)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = None
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size_kept = 0

        def send() -> pa.RecordBatch:
            h, fp, s = (np.concatenate(x) for x in zip(*kept))
            kept.clear()
            at = np.lexsort((fp, h))
            h, fp, s = h[at], fp[at], s[at]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])
            h, fp, s = h[new], fp[new], s[new]
            _, at, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            often = count > MANY
            few = ~often[back]
            out = []
            mark = h[at[often]]
            asked = np.concatenate([h[few], mark])
            members, sizes = np.concatenate([fp[few], np.zeros(len(mark), U64)]), np.concatenate([s[few], np.zeros(len(mark), U64)])
            for r, x in by_range(words.mix(asked), n):
                out.append((r, True, asked[x].tobytes(), members[x].tobytes(), sizes[x].tobytes()))
            rest = np.flatnonzero(~few)
            for r, x in by_range(words.mix(fp[rest]), n):
                x = rest[x]
                out.append((r, False, h[x].tobytes(), fp[x].tobytes(), s[x].tobytes()))
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.bool_()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["r", "asked", "h", "fp", "s"])

        for b in batches:
            order = order or Order(uri, n, there)
            for w, row, h in shingles(b.column(0), k):
                size, fp = prints(row, h, len(w.rows))
                at = first_of(row, order(h, order.levels(h), 0), size, prefix_length(size, percent))
                if len(at):
                    r = row[at]
                    nth = np.arange(len(at)) - np.searchsorted(r, r)
                    kept.append((h[at], fp[r], size[r].astype(U64) << U64(32) | nth.astype(U64)))
                    size_kept += len(at)
                if size_kept >= PACK:
                    yield send()
                    size_kept = 0
        if kept:
            yield send()

    def meet(table: pa.Table) -> pa.Table:
        asked = np.asarray(table.column("asked").to_pylist(), bool)
        cols = {c: table.column(c).to_pylist() for c in ("h", "fp", "s")}
        get = lambda c, which, t: np.concatenate([np.frombuffer(cols[c][i], t) for i in np.flatnonzero(which)] or [np.empty(0, t)])
        h, fp, s = (get(c, asked, t) for c, t in (("h", U64), ("fp", U64), ("s", U64)))
        at = np.lexsort((fp, h))
        h, fp, s = h[at], fp[at], s[at]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])
        h, fp, s = h[new], fp[new], s[new]
        _, at, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        marked = fp[at] == 0 if len(at) else np.empty(0, bool)
        total = _sums(words.mix(fp + GOLD))
        edge = np.append(at, len(h))
        sign = words.mix(total[edge[1:]] - total[edge[:-1]] + count.astype(U64))
        keep = (count > 1)[back] & (fp != 0)
        b = np.where(marked[back], h, sign[back])[keep]
        fp, s = fp[keep], s[keep]
        told = [get(c, ~asked, U64) for c in ("h", "fp", "s")]
        b, fp, s = (np.concatenate(x) for x in zip((b, fp, s), told))
        at = np.lexsort((s, fp, b))  # of the tokens under one b, a class's first
        b, fp, s = b[at], fp[at], s[at]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (fp[1:] != fp[:-1])
        b, fp, s = b[new], fp[new], s[new]
        return pa.table({"b": pa.array(b.view(np.int64)), "fp": pa.array(fp.view(np.int64)), "s": pa.array((s >> U64(32)).astype(np.int32)), "i": pa.array((s & U64(0xFFFFFFFF)).astype(np.int32))})

    dealt = docs.select(text).mapInArrow(lean.batches(prefixes), "r int, asked boolean, h binary, fp binary, s binary")
    return dealt.groupBy("r").applyInArrow(lean.group(meet), "b long, fp long, s int, i int").groupBy("b", "fp", "s").agg(F.min("i").alias("i"))


def _tokens(docs: DataFrame, wanted: DataFrame, k: int, percent: int, uri: str, there: set[int], text: str) -> DataFrame:
    """fp and where: pack, lo and hi of the sets of the rows whose key _k is wanted (and of a few others) in arrays at uri, from and to of their prefixes.

    Each task writes its own arrays, so sets are never shuffled. A repeated task
    writes others, and only those that its rows name are read.
    """
    n = ranges(docs, BUCKET_BYTES)

    def write(table: pa.Table) -> pa.Table:
        r = table.column("r")[0].as_py()
        store.put(uri, f"k-{r}", map=bit_map(words.mix(table.column("_k").to_numpy().view(U64))))
        return pa.table({"r": pa.array([r], pa.int32())})

    spread = F.pmod(F.xxhash64("_k"), F.lit(n)).cast("int").alias("r")
    present = {x.r for x in wanted.select(spread, "_k").groupBy("r").applyInArrow(lean.group(write), "r int").collect()}  # at most n small numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = store.Files(uri)
        order = Order(uri, n, there)
        kept: list[tuple[np.ndarray, ...]] = []
        size_kept = 0

        def send() -> pa.RecordBatch:
            fp, size, take, h, *prefixes = (np.concatenate(x) for x in zip(*kept))
            kept.clear()
            pack = uuid.uuid4().hex
            store.put(uri, f"t-{pack}", h=h, **{f"p{i + 1}": x for i, x in enumerate(prefixes)})
            ends = [np.cumsum(x) for x in (size, take)]
            places = [pa.array([pack] * len(fp), pa.string()), *(pa.array(x.astype(np.int64)) for end, x0 in zip(ends, (size, take)) for x in (end - x0, end))]
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.StructArray.from_arrays(places, names=["pack", "lo", "hi", "from", "to"])], names=["fp", "at"])

        for b in batches:
            part, key = b.column(0).to_numpy(), words.mix(b.column(1).to_numpy().view(U64))
            hit = np.zeros(len(key), bool)
            for r in np.unique(part):
                if (r := int(r)) in present:
                    at = np.flatnonzero(part == r)
                    hit[at] = in_map(files(f"k-{r}")["map"], key[at])
            for w, row, h in shingles(b.column(2).filter(pa.array(hit)), k):
                size, fp = prints(row, h, len(w.rows))
                take, level = np.where(size > 0, prefix_length(size, percent), 0), order.levels(h)
                prefixes = []
                for i in range(1, len(ORDERS)):
                    at = first_of(row, order(h, level, i), size, take)
                    prefixes.append(h[at[np.lexsort((h[at], row[at]))]])
                kept.append((fp, size, take, h, *prefixes))
                size_kept += len(h)
                if size_kept >= PACK:
                    yield send()
                    size_kept = 0
        if kept:
            yield send()

    return docs.select(F.xxhash64("doc_id", text).alias("_k"), text).select(spread, "_k", text).mapInArrow(lean.batches(run), f"fp long, at {_AT}")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays of distinct ones share."""
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int = THRESHOLD) -> bool:
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(pairs: DataFrame, tokens: DataFrame, percent: int, uri: str) -> DataFrame:
    """The pairs of classes a, b that meet under every order and are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = store.Files(uri)

        def prefix(x: dict, order: int) -> np.ndarray:
            return files(f"t-{x['pack']}")[f"p{order}"][x["from"] : x["to"]]

        def whole(x: dict) -> np.ndarray:
            return files(f"t-{x['pack']}")["h"][x["lo"] : x["hi"]]

        for b in batches:
            places = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
            left = range(len(places))
            for order in range(1, len(ORDERS)):
                left = [i for i in left if common(prefix(places[i][0], order), prefix(places[i][1], order))]
            left = [i for i in left if similar(whole(places[i][0]), whole(places[i][1]), percent)]
            yield b.select(["a", "b"]).take(pa.array(left, pa.int64()))

    one = tokens.select(F.col("fp").alias("a"), F.col("at").alias("ta"))
    two = tokens.select(F.col("fp").alias("b"), F.col("at").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(lean.batches(run), "a long, b long")


def _by_second(open_: DataFrame, tokens: DataFrame, uri: str) -> DataFrame:
    """open_ with b2, once for each token of a member's prefix under the second order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = store.Files(uri)
        for b in batches:
            parts = [files(f"t-{x['pack']}")["p1"][x["from"] : x["to"]] for x in b.column("at").to_pylist()]
            # A few rows have many tokens: as many batches as keep them small.
            lo = 0
            while lo < len(parts):
                hi, size = lo, 0
                while hi < len(parts) and (hi == lo or size + len(parts[hi]) <= 1 << 18):
                    size += len(parts[hi])
                    hi += 1
                which = pa.array(np.repeat(np.arange(lo, hi), [len(x) for x in parts[lo:hi]]))
                yield b.drop_columns(["at"]).take(which).append_column("b2", pa.array(np.concatenate(parts[lo:hi]).view(np.int64)))
                lo = hi

    return open_.join(tokens, "fp").select("b", "fp", "s", "i", "c", "at").mapInArrow(lean.batches(run), "b long, fp long, s int, i int, c long, b2 long")


def _no_more_rounds(i: int, todo: float, before: float, members: int) -> bool:
    """Whether the pairs left to do after i rounds are compared now: few for the members of all buckets, or hardly fewer than before."""
    return i == ROUNDS or todo <= ROUND_MOVES * members or todo > 0.9 * before


def _solve(docs: DataFrame, k: int, percent: int, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, _k, s and class fp), and fp and component c of the classes that share a token of their prefixes."""
    spark = docs.sparkSession
    lean.small_batches(spark)
    n = ranges(docs, BUCKET_BYTES)
    read = store.written(spark, _read(docs, k, text), "sets")
    rows = read.where("h is null").select("doc_id", "_k", "s", "fp")
    uri = store.folder(spark, "order")
    there = _order(read.where("h is not null").select("h", "n"), n, uri)
    buckets = store.written(spark, _buckets(docs, k, percent, uri, there, text), "buckets")
    members = buckets.select("fp").distinct()
    reps = rows.join(members, "fp", "left_semi").groupBy("fp").agg(F.min("_k").alias("_k"))
    tokens = store.written(spark, _tokens(docs, reps, k, percent, uri, there, text).join(members, "fp", "left_semi").dropDuplicates(["fp"]), "tokens")
    labels = store.written(spark, members.select("fp", F.col("fp").alias("c")), "labels")
    at_most, before = buckets.count(), float("inf")
    left = buckets
    for i in range(ROUNDS + 1):
        here = left.select("b", "fp", "s", "i").join(labels, "fp")
        if i == 0:
            # Members whose token comes too late in them to be the first that they share with any set of the bucket's sizes.
            least = here.groupBy("b").agg(F.min("s").alias("least"))
            here = here.join(least, "b").where(f"{100 + percent} * (s - i) >= {percent} * s + greatest({percent} * least, {percent * percent} * s div 100)").drop("least")
        prefix = F.sum(F.expr(f"s - (s * {percent} + 99) div 100 + 1")).alias("w")
        per = here.groupBy("b", "c").agg(F.count("*").alias("m"), prefix).groupBy("b").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("q"), F.count("*").alias("cs"), F.sum("w").alias("w"))
        per = per.where("cs > 1").select("b", ((F.col("n") * F.col("n") - F.col("q")) / 2).alias("pairs"), "w")
        open_ = store.written(spark, here.join(per, "b").select("b", "fp", "s", "i", "c", "pairs", "w"), "open")
        store.forget(left)
        left = open_
        todo = open_.select("b", "pairs").distinct().agg(F.sum("pairs")).first()[0]
        if not todo:
            break
        last = _no_more_rounds(i, todo, before, at_most)
        before = todo
        fits = f"100 * least(sa, sb) >= {percent} * greatest(sa, sb) and {100 + percent} * least(sa - ia, sb - ib) >= {percent} * (sa + sb)"
        sides = lambda t, *by: (t.select(*by, F.col("fp").alias("a"), F.col("s").alias("sa"), F.col("i").alias("ia"), F.col("c").alias("ca")), t.select(*by, F.col("fp").alias("z"), F.col("s").alias("sb"), F.col("i").alias("ib"), F.col("c").alias("cb")))
        if last:
            both = store.written(spark, _by_second(open_.where("pairs > w"), tokens, uri), "both")
            (one, two), (few, others) = sides(both, "b", "b2"), sides(open_.where("pairs <= w"), "b")
            pairs = one.join(two, ["b", "b2"]).drop("b2").unionByName(few.join(others, "b")).where("ca < cb").where(fits)
        else:
            # The member that shares the most, as far as the token's place tells; in later rounds any.
            one, two = sides(open_, "b")
            by = [F.col("ia") / F.col("sa")] if i % 2 == 0 else []
            best = F.min(F.struct(*(x.alias(f"o{k}") for k, x in enumerate([*by, F.xxhash64(F.col("a"), F.lit(i))])), "a", "sa", "ia", "ca")).alias("best")
            one = one.groupBy("b").agg(best).select("b", "best.a", "best.sa", "best.ia", "best.ca")
            pairs = one.join(two, "b").where("ca <> cb").where(fits)
        pairs = pairs.select(F.least("a", "z").alias("a"), F.greatest("a", "z").alias("b")).distinct()
        links = _verify(pairs, tokens, percent, uri)
        known = labels.select(F.col("fp").alias("a"), F.col("c").alias("ca")), labels.select(F.col("fp").alias("b"), F.col("c").alias("cb"))
        step = components.components(links.join(known[0], "a").join(known[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        to = step.select(F.col("u").alias("c"), F.col("p").alias("to"))
        old, labels = labels, store.written(spark, labels.join(to, "c", "left").select("fp", F.coalesce("to", "c").alias("c")), "labels")
        store.forget(old, step)
        if last:
            store.forget(both)
            break
    store.forget(left, tokens)
    store.drop(spark, uri)
    return rows, labels


def _least(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fp, c and the least row of each class; and c and the least row of each component.

    The class comes first, since one may hold a third of all rows. Rows come by
    their id, those without one last.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_k")).alias("least")
    classes = rows.where("s > 0").groupBy("fp").agg(first).join(labels, "fp", "left").select("fp", F.coalesce("c", "fp").alias("c"), "least")
    return classes, classes.groupBy("c").agg(F.min("least").alias("least"))


def jaccard_join(docs: DataFrame, k: int = K, percent: int = THRESHOLD, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of each row.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased; a text
    of fewer than k words has one shingle, all of it; a null text or one without
    words has none and is linked with nothing. Rows of equal sets are linked, so
    repeated rows are. A null doc_id counts as no id: its component is the
    smallest id among the others, or null. Empty tables give empty results; other
    columns are left out.
    """
    rows, labels = _solve(docs, k, percent, text)
    classes, least = _least(rows, labels)
    by_class = classes.select("fp", "c").join(least, "c").select("fp", F.col("least.doc_id").alias("component_id"))
    return rows.join(by_class, "fp", "left").select("doc_id", F.col("s").alias("n_shingles"), F.when(F.col("s") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of the smallest id; all without words. Rows that repeat an id and text are one document."""
    rows, labels = _solve(docs, K, THRESHOLD, "text")
    _, least = _least(rows, labels)
    found = store.written(spark, least.select("least._k").unionByName(rows.where("s = 0").select("_k").distinct()), "kept")
    own, restore = aside(docs, {"doc_id", "text"})
    return restore(own.withColumn("_k", F.xxhash64("doc_id", "text")).join(found, "_k", "left_semi").dropDuplicates(["_k"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS t
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sh x JOIN sh y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * m >= 75 * (p.n + q.n - m)
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id, doc_id AS r FROM w
  UNION
  SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r
)
SELECT w.doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(reach.r) AS component_id
FROM w JOIN reach USING (doc_id) LEFT JOIN size USING (doc_id) GROUP BY w.doc_id
"""
