"""Benchmark decontamination by template canonicalisation.

Texts are read as tokens: runs of letters and digits, numbers with their points
as one. Numbers, names and units (after a number) become typed placeholders,
other words are lower-cased. A name is a capitalised word that is not among the
COMMON words that open sentences, wherever it stands; several in a row are one.
Windows of WINDOW such tokens are joined by hash with those of the benchmark's
items, so that a question is found whatever its parameters. Then the values in
the slots are compared: along one alignment each of the item's values must stand
for one value of the document; only the slot that an item begins with, which
words before it may lengthen, is not. Windows without slots always count.
Windows of which more than half are slots would be met anywhere and are left out
there. Beside these, windows of WINDOW words as they are (in lower case) are
joined in the same way, so that an item is found word for word whatever it is
made of. A document is contaminated by an item when it holds at least SHARE of
the item's windows of either sort. Items of fewer than LEAST words, which stand
in any text, are compared with whole texts.

The word that an item begins with may be read otherwise in a document: as a unit,
as a part of a longer name, or as a word. So windows that begin with a name or
unit, of documents and at items' beginnings, are read with it as a word too; of
documents these are met by items' first windows only.

Windows that many items have in common are no candidates' reason: an item must
be met by one of so many of its rarest windows that without them SHARE can't be
reached. Only documents and items that meet so are compared by all windows.

A bit map of the benchmark's windows, in the folder that all executors share,
sorts out the other windows of a document before anything is shuffled; it may
let some through, and the join sees them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lean, store, words
from .columns import aside
from .repeats import RANGE_BYTES, U64, bit_map, in_map, windows

WINDOW = 8
SHARE = 0.3
#: Words of an item to be looked for within texts; shorter ones are compared with whole texts.
LEAST = 5
NUM, NAME, UNIT = (U64(words.mix_int(i)) for i in (101, 102, 103))
#: Sets the hashes of windows of words apart from those of templates.
PLAIN = U64(words.mix_int(104))
#: And those of whole texts of fewer than LEAST words apart from both.
WHOLE = U64(words.mix_int(105))
TEMPLATES, WORDS, TEXTS = range(3)

#: Units, as they stand after a number.
UNITS = """
    mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres centimeter centimeters
    kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces
    ml l cl liter liters litre litres gallon gallons cup cups s sec secs second seconds min mins minute minutes h hr hrs hour
    hours day days week weeks month months year years mph kph kmh hz khz mhz ghz w kw mw v kv ma j kj cal kcal pa kpa bar
    k c f degree degrees percent dollar dollars cent cents euro euros usd eur gbp yen b kb mb gb tb bytes bits
""".split()

#: Words that open sentences and are no names, though capitalised there.
COMMON = """
    a an the this that these those some any each every both all many most much more few several one two three four five six seven eight nine ten
    i you he she it we they who whom whose what which when where why how my your his her its our their there here
    in on at by to of for from with without after before during while until since as if then than or and but so because although though
    however therefore thus hence also next first second third last finally now today yesterday tomorrow later once again still yet
    is are was were be been being do does did has have had can could will would shall should may might must let given suppose assume consider
    find calculate compute determine solve evaluate simplify express write give state explain describe show prove use using choose select
    answer question read following about approximately exactly only not no yes none nothing another other such same different
    after among between over under above below per during through
""".split()

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SOLID = _DIGIT.copy()
_SOLID[65:91] = _SOLID[97:123] = _SOLID[128:] = True
_JOIN = np.zeros(256, bool)
_JOIN[list(b".,:/")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\n\"(")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _token_spans(data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    solid = _SOLID[data]
    if len(data) > 2:
        digit = _DIGIT[data]
        solid[1:-1] |= _JOIN[data[1:-1]] & digit[:-2] & digit[2:]
    edge = np.zeros(len(data) + 1, bool)
    edge[0], edge[-1] = solid[0], solid[-1]
    edge[1:-1] = solid[1:] != solid[:-1]
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if breaks is not None:
        inner = breaks[(breaks > 0) & (breaks < len(data))]
        inner = np.unique(inner[solid[inner] & solid[inner - 1]])
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return starts, ends


def _capital(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the characters at these places are capitals (ASCII or Latin-1), and their size in bytes (up to two)."""
    wide = data[at] == 0xC3
    second = data[at + 1]
    return _UPPER[data[at]] | (wide & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)), 1 + (data[at] >= 0xC0)


class Templates:
    """Some rows' canonical tokens, their slots' values (0: none), and where each row's begin; their words, and the word that each token begins with."""

    __slots__ = ("rows", "tokens", "slots", "first", "words", "at")

    def __init__(self, w: words.Words):
        data, starts, ends, h = w.data, w.starts, w.ends, w.hashes
        n = len(starts)
        self.rows = w.rows
        row = np.repeat(np.arange(len(w.rows)), np.diff(w.first))
        new = np.ones(n, bool)
        new[1:] = row[1:] != row[:-1]
        sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        digits, stops = sums(_DIGIT[data]), sums(_STOP[data])
        num = digits[ends] > digits[starts]
        after_stop = new.copy()  # of a row, or after a stop
        after_stop[1:] |= stops[starts[1:]] > stops[ends[:-1]]
        letters = np.concatenate([data, np.zeros(4, np.uint8)])
        first, size = _capital(letters, starts)
        name = first & ~num & (ends - starts > size) & ~_capital(letters, starts + size)[0] & ~np.isin(h, _hashes("COMMON"))
        unit = np.isin(h, _hashes("UNITS")) & ~name
        unit[1:] &= num[:-1] & ~new[1:]
        unit[:1] = False
        token, slot = h.copy(), np.zeros(n, U64)
        for mask, mark in ((num, NUM), (name, NAME), (unit, UNIT)):
            slot[mask] = h[mask]
            token[mask] = mark
        # A run of names is one, with the value of all; it ends with its sentence.
        more = np.zeros(n, bool)
        more[1:] = name[1:] & name[:-1] & ~after_stop[1:]
        if more.any():
            keep = np.flatnonzero(~more)
            total = np.zeros(n + 1, U64)
            np.cumsum(slot, out=total[1:])
            last = np.append(keep[1:], n)
            many = (last - keep) > 1
            slot = np.where(many, words.mix(total[last] - total[keep]), slot[keep])
            token = token[keep]
            self.first, self.at = np.searchsorted(keep, w.first), keep
        else:
            self.first, self.at = w.first, np.arange(n)
        self.tokens, self.slots, self.words = token, slot, w

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, starts (among all tokens) and hashes of the windows of k tokens, at least half of which are words."""
        h = words.runs(self.tokens, k)
        if not len(h):
            return np.empty(0, np.int64), np.empty(0, np.int64), h
        row = np.repeat(np.arange(len(self.rows)), np.diff(self.first))
        plain = np.concatenate([[0], np.cumsum(self.slots == 0)])
        at = np.flatnonzero((row[k - 1 :] == row[: len(row) - k + 1]) & (2 * (plain[k:] - plain[:-k]) >= k))
        return row[at], at, h[at]

    def opened(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows of k tokens whose first is a word read as a name or unit otherwise, at least half of which are words: rows, starts, hashes, the tokens' slots, and the words.

        A name of several words may be cut after any; what is left of it is the second token, with the value of all.
        """
        word = np.arange(len(self.words.hashes))
        of = np.searchsorted(self.at, word, "right") - 1
        word = word[np.isin(self.tokens[of], (NAME, UNIT))]
        of = of[word]
        row = np.searchsorted(self.first, of, "right") - 1
        # The token that follows the word: the same where some of the name is left.
        left = word + 1 < np.append(self.at, len(self.words.hashes))[of + 1]
        next_ = of + 1 - left
        fits = next_ + k - 1 <= self.first[row + 1]
        word, row, next_ = word[fits], row[fits], next_[fits]
        if not len(word):
            return row, next_, np.empty(0, U64), np.empty((0, k), U64), word
        at = next_[:, None] + np.arange(k - 1)
        slots = np.concatenate([np.zeros((len(at), 1), U64), self.slots[at]], axis=1)
        some = np.flatnonzero(2 * (slots == 0).sum(axis=1) >= k)
        tokens = np.concatenate([self.words.hashes[word, None], self.tokens[at]], axis=1)[some]
        return row[some], next_[some] - 1, words.runs(tokens.ravel(), k)[::k], slots[some], word[some]

    def plain(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, starts (among all words) and hashes of the windows of k words."""
        at, row, h = windows(self.words, k)
        return row, at, h ^ PLAIN

    def short(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of the rows that have just k words."""
        at, row, h = windows(self.words, k)
        some = np.diff(self.words.first)[row] == k
        return row[some], at[some], h[some] ^ WHOLE

    def alone(self, j: int) -> Templates:
        """The j-th row by itself."""
        one = Templates.__new__(Templates)
        lo, hi, span = int(self.first[j]), int(self.first[j + 1]), self.words.of(j)
        w = words.Words(range(1), None, None, None, self.words.hashes[span], np.array([0, int(span.stop - span.start)]))
        one.rows, one.tokens, one.slots, one.first, one.words, one.at = range(1), self.tokens[lo:hi], self.slots[lo:hi], np.array([0, hi - lo]), w, self.at[lo:hi] - int(span.start)
        return one


@lru_cache(2)
def _hashes(name: str) -> np.ndarray:
    return np.concatenate([w.hashes for w in words.split(pa.array({"UNITS": UNITS, "COMMON": COMMON}[name]), lower=True, spans=_token_spans)])


def templates(column: pa.Array) -> Iterator[Templates]:
    for w in words.split(column, lower=True, spans=_token_spans, fold=words.lowered):
        yield Templates(w)


def _slots(t: Templates, at: np.ndarray, k: int) -> list[bytes | None]:
    """The slots' values of windows; None where there are none."""
    if not len(at):
        return []
    some = np.concatenate([[0], np.cumsum(t.slots != 0)])
    return [t.slots[i : i + k].tobytes() if m else None for i, m in zip(at.tolist(), (some[at + k] > some[at]).tolist())]


def _equal(slots: np.ndarray) -> np.ndarray:
    """Which slots hold equal values: for each slot, a hash of the first that has its value."""
    _, at, back = np.unique(slots[slots != 0], return_index=True, return_inverse=True)
    return words.mix(at[back].astype(U64) + U64(1))


def _hash(*parts: np.ndarray) -> np.int64:
    return np.array([words.whole(np.concatenate(parts))], U64).view(np.int64)[0]


_ITEM = "class long, key long, sort int, variant long, k int, pos long, off long, h long, slots binary, total long"


def _items(benchmark: DataFrame, window: int, least: int, text: str) -> DataFrame:
    """Each window of each item, with its item_id, class (hash of its tokens and of which slots are equal) and key (hash of its values).

    sort: TEMPLATES, WORDS, or TEXTS for the whole of a short item. off is the
    place that slots are aligned by: pos, but one less where the first token is
    the rest of a name whose first word is read as a word. variant is 0 for
    windows of tokens. For windows of words, which have no slots, it is a hash of
    the class and the words that each token has, so that pos is the same place in
    all items of a variant.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in templates(b.column(1)):
                for j, i in enumerate(t.rows):
                    lo, hi = int(t.first[j]), int(t.first[j + 1])
                    span = t.words.of(j)
                    size = int(span.stop - span.start)
                    if not size:
                        continue
                    tokens, slots = t.tokens[lo:hi], t.slots[lo:hi]
                    whole, key = _hash(tokens, _equal(slots)), _hash(slots)
                    variant = int(_hash(np.array([whole]).view(U64), words.mix(np.diff(t.at[lo:hi], append=span.stop).astype(U64))))
                    here = t.words.hashes[span]
                    k = min(window, size)
                    if size < least:
                        parts = [(TEXTS, variant, size, np.zeros(1, np.int64), None, words.runs(here, size) ^ WHOLE, [None], 1)]
                    else:
                        h = words.runs(here, k) ^ PLAIN
                        parts = [(WORDS, variant, k, np.arange(len(h)), None, h, [None] * len(h), len(h))]
                        if hi - lo >= least:
                            one = t.alone(j)
                            k = min(window, hi - lo)
                            _, at, h = one.windows(k)
                            parts.append((TEMPLATES, 0, k, at, None, h, _slots(one, at, k), len(at)))
                            _, off, h, values, word = one.opened(k)
                            if len(h) and word[0] == 0 and len(at) and at[0] == 0:
                                parts.append((TEMPLATES, 0, k, np.zeros(1, np.int64), off[:1], h[:1], [values[0].tobytes() if values[0].any() else None], len(at)))
                    for sort, variant_, k, pos, off, h, values, total in parts:
                        same = lambda x, kind, n=len(pos): pa.array([x] * n, kind)
                        cols = [same(b.column(0)[i].as_py(), b.schema.field(0).type), same(whole, pa.int64()), same(key, pa.int64()), same(sort, pa.int32()), same(variant_, pa.int64()), same(k, pa.int32()), pa.array(pos), pa.array(pos if off is None else off), pa.array(h.view(np.int64)), pa.array(values, pa.binary()), same(total, pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols, names=["item_id", "class", "key", "sort", "variant", "k", "pos", "off", "h", "slots", "total"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", text).mapInArrow(lean.batches(run), f"item_id {kind}, {_ITEM}")


def _rarest(items: DataFrame, share: float) -> DataFrame:
    """items with rare: whether a window is one of those of which a document that holds share of its item has at least one."""
    own = ["class", "sort", "variant"]
    often = items.select("h", "class").distinct().groupBy("h").agg(F.count("*").alias("often"))
    places = items.join(often, "h").groupBy(*own, "pos", "total").agg(F.max("often").alias("often"))
    nth = F.row_number().over(Window.partitionBy(*own).orderBy("often", "pos"))
    # An item's windows, so a text's: no table is dealt out by less.
    places = places.withColumn("rare", nth <= F.col("total") - F.ceil(F.col("total") * share - 1e-9) + 1)
    return items.join(places.select(*own, "pos", "rare"), [*own, "pos"])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, least: int = LEAST, text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, n_item_windows, share, exact and n_items of each document and item it holds.

    Items of one template whose equal values stand in the same slots are one:
    item_id is their smallest, n_items their number. n_windows, n_item_windows and share are those of the template's
    windows or, where their share is larger, of the windows of words as they
    are. exact: no slot's value was changed. Items of fewer than least words
    are found in texts that have those words and no others, those of fewer tokens only word for word; others shorter
    than a window are one window. Null texts
    and texts without tokens hold nothing and are no items; rows with the same
    doc_id and text are one; a null doc_id is reported as null, items without an
    id are known by their class. Empty tables give empty results.
    """
    return _contaminated(docs, benchmark, window, share, least, text).drop("_k")


def _contaminated(docs: DataFrame, benchmark: DataFrame, window: int, share: float, least: int, text: str) -> DataFrame:
    """The same with _k, the key of a row's doc_id and text."""
    spark = docs.sparkSession
    lean.small_batches(spark)
    found = _items(benchmark, window, least, text)
    # Items without an id, and repeated rows of one, count once. The values compared are those of one row.
    first = F.min(F.struct(F.col("item_id").isNull().alias("none"), "item_id", "key")).alias("first")
    reps = found.groupBy("class").agg(first, F.count_distinct(F.struct("item_id")).alias("n_items")).select("class", "first.item_id", F.col("first.key").alias("own"), "n_items")
    items = found.drop("item_id").join(reps, "class").where(f"sort <> {TEMPLATES} or key = own").drop("key", "own")
    items = store.written(spark, _rarest(items.dropDuplicates(["class", "sort", "variant", "pos", "h"]), share), "items")
    size = int(str(items._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = 1 << (size // RANGE_BYTES).bit_length()
    uri = store.folder(spark, "windows")

    def write(table: pa.Table) -> pa.Table:
        r = table.column("r")[0].as_py()
        store.put(uri, f"w-{r}", map=bit_map(table.column("h").to_numpy().view(U64)))
        return pa.table({"r": pa.array([r], pa.int32())})

    spread = F.pmod(F.col("h"), F.lit(n)).cast("int").alias("r")
    present = {x.r for x in items.select(spread, "h").groupBy("r").applyInArrow(lean.group(write), "r int").collect()}  # at most n small numbers
    lengths = [(x.k, x.sort) for x in items.select("k", "sort").distinct().collect()]  # at most 2 * window + least small numbers

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = {r: store.get(uri, f"w-{r}")["map"] for r in present}

        def hit(h: np.ndarray) -> np.ndarray:
            if n == 1:
                return in_map(maps[0], h) if maps else np.zeros(len(h), bool)
            out = np.zeros(len(h), bool)
            part = np.mod(h.view(np.int64), n)
            for r in np.unique(part):
                if int(r) in present:
                    at = np.flatnonzero(part == r)
                    out[at] = in_map(maps[int(r)], h[at])
            return out

        def record(b: pa.RecordBatch, which: np.ndarray, at: np.ndarray, h: np.ndarray, values: list, opened: bool) -> Iterator[pa.RecordBatch]:
            # Where no slot is aligned, one place of a window in a text says as much as all.
            bare = np.array([v is None for v in values], bool)
            _, once = np.unique(words.mix(which.astype(U64)) ^ h, return_index=True)
            keep = ~bare
            keep[once] = True
            some = np.flatnonzero(keep)
            if len(some):
                rows = pa.array(which[some])
                columns = [b.column(0).take(rows), b.column(1).take(rows), pa.array(at[some]), pa.array(h[some].view(np.int64)), pa.array([values[i] for i in some.tolist()], pa.binary()), pa.array([opened] * len(some))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_k", "at", "h", "values", "opened"])

        for b in batches:
            for t in templates(b.column(2)):
                for k, sort in lengths:
                    row, at, h = t.windows(k) if sort == TEMPLATES else t.plain(k) if sort == WORDS else t.short(k)
                    some = hit(h)
                    row, at, h = row[some], at[some], h[some]
                    if len(at):
                        values = _slots(t, at, k) if sort == TEMPLATES else [None] * len(at)
                        yield from record(b, row + t.rows.start, at - (t.first if sort == TEMPLATES else t.words.first)[row], h, values, False)
                    if sort == TEMPLATES:
                        row, at, h, slots, _ = t.opened(k)
                        some = np.flatnonzero(hit(h))
                        if len(some):
                            values = [x.tobytes() if x.any() else None for x in slots[some]]
                            yield from record(b, row[some] + t.rows.start, (at - t.first[row])[some], h[some], values, True)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("_k"), text)
    hits = rows.mapInArrow(lean.batches(probe), f"doc_id {kind}, _k long, at long, h long, values binary, opened boolean")
    hits = store.written(spark, hits, "hits")
    fits = f"not opened or (pos = 0 and sort = {TEMPLATES})"
    own = ["class", "sort", "variant"]
    pairs = hits.select("_k", "h", "opened").distinct().join(items.where("rare"), "h").where(fits).select("_k", *own).distinct()
    met = pairs.join(items.drop("k", "rare"), own).join(hits, ["_k", "h"]).where(fits).withColumn("shift", F.col("at") - F.col("off"))
    met = met.select("doc_id", "_k", "item_id", *own, "pos", "shift", "total", "n_items", "slots", "values")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each window: the item's values, and the document's, slot by slot; not of the slot that an item begins with."""
        for b in batches:
            pairs = []
            for at, s, v in zip(*(b.column(c).to_pylist() for c in ("pos", "slots", "values"))):
                s, v = (np.frombuffer(x, np.int64) if x else np.empty(0, np.int64) for x in (s, v))
                m = min(len(s), len(v))
                lo = int(at == 0)
                pairs.append([{"s": int(x), "v": int(y)} for x, y in zip(s[lo:m], v[lo:m]) if x])
            keep = b.drop_columns(["slots", "values"])
            yield keep.append_column("pairs", pa.array(pairs, pa.list_(pa.struct([("s", pa.int64()), ("v", pa.int64())]))))

    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    met = met.mapInArrow(lean.batches(compare), f"doc_id {kind}, _k long, item_id {item_kind}, class long, sort int, variant long, pos long, shift long, total long, n_items long, pairs array<struct<s:long,v:long>>")
    met = store.written(spark, met, "met")
    store.forget(hits, items)
    store.drop(spark, uri)
    line = ["_k", "class", "shift"]
    values = met.select(*line, F.explode("pairs").alias("p")).groupBy(*line, "p.s").agg(F.min("p.v").alias("lo"), F.max("p.v").alias("hi"))
    sound = values.groupBy(*line).agg(F.bool_and(F.col("lo") == F.col("hi")).alias("sound"), F.bool_and((F.col("lo") == F.col("s")) & (F.col("hi") == F.col("s"))).alias("same"))
    counted = met.join(sound, line, "left").where("size(pairs) = 0 or sound")
    same = F.bool_and(F.when(F.col("sort") == TEMPLATES, F.col("same")))
    parts = counted.groupBy("doc_id", "_k", *own, "item_id", "total", "n_items").agg(F.count_distinct("pos").alias("n_windows"), F.coalesce(same, F.lit(True)).alias("exact"))
    parts = parts.withColumn("share", F.col("n_windows") / F.col("total")).where(F.col("share") >= share)
    out = parts.groupBy("doc_id", "_k", "class", "item_id", "n_items").agg(F.max(F.struct("share", "exact", "n_windows", "total")).alias("p")).select("doc_id", "_k", "item_id", "n_items", "p.*")
    return out.select("_k", "doc_id", "item_id", "n_windows", F.col("total").alias("n_item_windows"), "share", "exact", "n_items")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item."""
    bad = _contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WINDOW, SHARE, LEAST, "text").select("_k").distinct()
    own, restore = aside(docs, {"doc_id", "text"})
    return restore(own.withColumn("_k", F.xxhash64("doc_id", "text")).join(store.written(spark, bad, "contaminated"), "_k", "left_anti"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
