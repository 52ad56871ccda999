"""Quality rules: robust multivariate outliers per language and source.

Each text gives counts (see stats); a base rule rejects texts that are too short
or mostly repeated. The others are judged by rates made of those counts
(see vector): per language and source, the minimum-covariance-determinant
estimate of their centre and scatter is found over all rows, and a text is
rejected when its squared Mahalanobis distance is beyond the cutoff.

The estimate: three starts (medians with the spreads of the quartiles; the
scatters of the hyperbolic tangents and of the directions of what is so
standardised), from each of which concentration steps, which keep the half of a
group's rows that lies nearest to the present centre and take their mean and
covariance, go on until the determinant stops falling. The least determinant is
kept, made consistent for normal rows, and weighted anew: mean and covariance,
again made consistent, of the rows within its REWEIGHT quantile.

A rate that does not vary in a group (its median's bin of 0.01 holds over half of
the rows, as where most texts have no symbol) would make every determinant 0; it
is left out of that group's vectors, and the cutoff is that of the rates left.

A step is two aggregations: rows are counted by group and bin of their distance
(map-side first, so a hot group costs its bins and no more), and moments are
summed over all bins up to the one that completes the half. No rows are
collected, sampled or dropped, and a group's work is spread over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keys, lean, store, words

NAMES = ["word_len", "symbols", "dup_lines", "repeats", "marks", "same_words", "line_words", "capitals"]
P = len(NAMES)
#: Rows that a group needs for an estimate of its own: 25 for each rate; smaller ones share that of their language, or of all rows.
LEAST = 25 * P
STARTS = 3
#: Width of a rate's bins, for quartiles and ties.
STEP = 0.01
#: Of squared distance: BINS_PER_DOUBLING bins for each factor of two.
BINS_PER_DOUBLING = 64
#: A logarithm of a determinant falls when it does by more than this.
FALL = 1e-4
REWEIGHT = 0.975
#: The cutoff is this quantile of the chi-squared distribution: clean texts have longer tails than normal ones.
CUTOFF = 1 - 1e-6

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_MARK = np.zeros(256, bool)
_MARK[33:127] = [not chr(c).isalnum() for c in range(33, 127)]
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_NEWLINE = 0x0A


def _line_spans(data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word."""
    cut = np.flatnonzero(data == _NEWLINE)
    starts = np.concatenate([[0], cut + 1])
    ends = np.concatenate([cut, [len(data)]])
    if breaks is not None:
        inner = np.setdiff1d(breaks[(breaks > 0) & (breaks < len(data))], starts)
        starts = np.sort(np.concatenate([starts, inner]))
        ends = np.sort(np.concatenate([ends, inner]))
    solid = np.concatenate([[0], np.cumsum(~words.SPACE[data])])
    some = solid[ends] > solid[starts]
    return starts[some], ends[some]


def _line_gaps(data: np.ndarray, i: int, j: int) -> np.ndarray:
    return np.flatnonzero(data[i:j] == _NEWLINE)


def _per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[first[1:]] - total[first[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[back] > 1


def stats(column: pa.Array) -> Iterator[tuple[range, dict[str, np.ndarray]]]:
    """Counts of some rows at a time."""
    for w, lines in zip(words.split(column), words.split(column, spans=_line_spans, gaps=_line_gaps)):
        n = len(w.rows)
        _, offs = words.string_buffers(column.slice(w.rows.start, n))
        offs = offs - offs[0]
        row = np.repeat(np.arange(n), np.diff(w.first)).astype(np.uint64)
        three = words.runs(w.hashes, 3)
        inside = row[2:] == row[:-2] if len(row) > 2 else np.empty(0, bool)
        keys = words.mix(three[inside] + row[:-2][inside] * np.uint64(0x9E3779B97F4A7C15)) if len(three) else three
        at = np.flatnonzero(inside)[_repeated(keys)] if len(keys) else np.empty(0, np.int64)
        covered = np.zeros(len(w.hashes), bool)
        for k in range(3):
            covered[at + k] = True
        line_row = np.repeat(np.arange(n), np.diff(lines.first)).astype(np.uint64)
        distinct = np.unique(words.mix(lines.hashes + line_row * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        once = np.zeros(len(lines.hashes), bool)
        once[distinct] = True
        per_word, times = np.unique(words.mix(w.hashes + row * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)[1:]
        same = np.zeros(n, np.int64)
        np.add.at(same, row[per_word].astype(np.int64), times * (times - 1))
        points = ((w.data & 0xC0) != 0x80) & ~words.SPACE[w.data]
        yield w.rows, {
            "n_words": np.diff(w.first),
            "word_chars": _per_row(points, offs),
            "n_symbols": _per_row(_SYMBOL[w.data], offs),
            "n_dup_lines": _per_row(~once, lines.first),
            "n_repeat_words": _per_row(covered, w.first),
            "n_lines": np.diff(lines.first),
            "n_marks": _per_row(_MARK[w.data], offs),
            "n_capitals": _per_row(_CAPITAL[w.data], offs),
            "n_same": same,
        }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals", "n_same"]


def with_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of docs, and the counts of its texts (null: those of an empty text)."""

    lean.small_batches(docs.sparkSession)
    more = [] if text in keep else [text]
    at = [*keep, *more].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, c in stats(b.column(at)):
                part = b.slice(rows.start, len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(c[k].astype(np.int64)) for k in COUNTS)], names=[*keep, *COUNTS])

    kinds = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    return docs.select(*keep, *more).mapInArrow(lean.batches(run), ", ".join([*kinds, *(f"{k} long" for k in COUNTS)]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """Logarithms of smoothed rates, alike for short and long texts; n_same: pairs of equal words, of all pairs."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log((F.col("word_chars") + 250.0) / (n + 50.0)),
        F.log(F.col("n_symbols") / n + 0.02),
        F.log(F.col("n_dup_lines") / (F.col("n_lines") + 5.0) + 0.1),
        F.log(F.col("n_repeat_words") / n + 0.1),
        F.log((F.col("n_marks") + 5.0) / (n + 50.0)),
        F.log((F.col("n_same") + 25.0) / (n * (n - 1.0) + 2500.0)),
        F.log((n + 50.0) / (F.col("n_lines") + 5.0)),
        F.log((F.col("n_capitals") + 2.5) / (n + 50.0)),
    ]


def chi2_cdf(x: float, k: int) -> float:
    """Of the chi-squared distribution with k degrees of freedom, by recursion from one or two."""
    if x <= 0:
        return 0.0
    h = x / 2
    f, term, i = (math.erf(math.sqrt(h)), 2 * math.sqrt(h / math.pi) * math.exp(-h), 1) if k % 2 else (1 - math.exp(-h), h * math.exp(-h), 2)
    while i < k:
        i += 2
        f, term = f - term, term * x / i
    return f


@lru_cache(1024)
def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1.0
    while chi2_cdf(hi, k) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def consistency(share: float, k: int) -> float:
    """The scatter of normal rows over that of the share of them nearest to the centre."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2) if share < 1 else 1.0


def _group() -> tuple[Column, Column]:
    """Keys of a row's language, and of its language and source; null is a value like others."""
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    return lang, F.concat(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")), F.lit("\x1f"), lang)


_UPPER = [(i, j) for i in range(P) for j in range(i, P)]
_I, _J = np.array(_UPPER).T


def _rates(b: pa.RecordBatch, name: str, width: int = P) -> np.ndarray:
    """A column of arrays as a matrix; null arrays are not numbers."""
    column = b.column(name)
    if column.null_count:
        column = pa.array([x if x is not None else [np.nan] * width for x in column.to_pylist()], pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _distance(x: np.ndarray, centre: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances, with inverse scatters by rows from the diagonal on."""
    d = x - centre
    return np.einsum("ij,ij->i", d[:, _I] * d[:, _J], inv * np.where(_I == _J, 1.0, 2.0))


def _bins(distance: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(distance, 0.0) + 1e-12) * BINS_PER_DOUBLING).astype(np.int32)


class _Sums:
    """By group and start: number, sums and sums of products of rows, kept for FLUSH groups at most."""

    FLUSH = 1 << 14
    SCHEMA = "k string, start int, h long, s array<double>, q array<double>"

    def __init__(self):
        self.kept: dict[tuple[str, int], np.ndarray] = {}

    def add(self, k: pa.Array, start: np.ndarray, x: np.ndarray) -> None:
        if not len(x):
            return
        names = k.dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64) * STARTS + start
        order = np.argsort(code, kind="stable")
        code, x = code[order], x[order]
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sums = np.add.reduceat(np.concatenate([np.ones((len(x), 1)), x, x[:, _I] * x[:, _J]], axis=1), at)
        known = names.dictionary.to_pylist()
        for c, row in zip(code[at].tolist(), sums):
            key = known[c // STARTS], c % STARTS
            self.kept[key] = self.kept[key] + row if key in self.kept else row

    def send(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.kept) > least:
            keys, rows = zip(*self.kept.items())
            self.kept = {}
            lists = lambda part: pa.array([r[part].tolist() for r in rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys]), pa.array([t for _, t in keys], pa.int32()), pa.array([int(r[0]) for r in rows]), lists(slice(1, P + 1)), lists(slice(P + 1, None))], names=["k", "start", "h", "s", "q"])


def _moments(joined: DataFrame, rows_of) -> DataFrame:
    """k, start, h, s and q of what rows_of makes of batches: keys, starts and matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for b in batches:
            for part in rows_of(b):
                sums.add(*part)
            yield from sums.send(sums.FLUSH)
        yield from sums.send()

    parts = joined.mapInArrow(lean.batches(run), _Sums.SCHEMA)
    each = lambda c, n: F.array(*(F.sum(F.col(c)[i]) for i in range(n))).alias(c)
    return parts.groupBy("k", "start").agg(F.sum("h").alias("h"), each("s", P), each("q", len(_UPPER)))


def _covariance(h: int, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m, cov = np.array(s) / h, np.zeros((P, P))
    for v, (i, j) in zip(q, _UPPER):
        cov[i, j] = cov[j, i] = v / h - m[i] * m[j]
    return m, cov


def _inverse(cov: np.ndarray, active: np.ndarray) -> tuple[list[float], float]:
    """The inverse over the active rates (0 for others), and the logarithm of the determinant; eigenvalues of rounding errors are raised."""
    at = np.flatnonzero(active)
    out = np.zeros((P, P))
    if not len(at):
        return [0.0] * len(_UPPER), 0.0
    size = np.sqrt(np.maximum(np.diag(cov)[at], 1e-12))
    w, v = np.linalg.eigh(cov[np.ix_(at, at)] / np.outer(size, size))
    w = np.maximum(w, 1e-9)
    out[np.ix_(at, at)] = (v / w @ v.T) / np.outer(size, size)
    return [float(out[i, j]) for i, j in _UPPER], float(np.log(w).sum() + 2 * np.log(size).sum())


def _spreads(rows: DataFrame) -> DataFrame:
    """k, n, and for each rate its median m, its spread sd by the quartiles, and whether it varies, by histograms."""
    bins = rows.select("k", F.posexplode("x").alias("i", "x")).groupBy("k", "i", F.floor(F.col("x") / STEP).alias("bin")).agg(F.count("*").alias("c"))
    cum = bins.selectExpr("k", "i", "bin", "c", "sum(c) over (partition by k, i order by bin) as upto", "sum(c) over (partition by k, i) as n")
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.struct("bin", "c")))
    each = cum.groupBy("k", "i").agg(F.max("n").alias("n"), at(0.5).alias("m"), at(0.25).alias("lo"), at(0.75).alias("hi"))
    one = F.struct("i", ((F.col("m.bin") + 0.5) * STEP).alias("m"), ((F.col("hi.bin") - F.col("lo.bin")) * STEP / 1.349).alias("sd"), (2 * F.col("m.c") <= F.col("n")).alias("varies"))
    got = each.groupBy("k").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(one)).alias("a"))
    sd = F.transform("a", lambda r: F.greatest(r["sd"], F.lit(STEP)))
    return got.select("k", "n", F.col("a.m").alias("m"), sd.alias("sd"), F.col("a.varies").alias("active"))


_STATE = "k string, n long, active array<boolean>, start int, centre array<double>, inv array<double>, det double, near double, done boolean"


def _starts(rows: DataFrame, spreads: DataFrame) -> DataFrame:
    """The states from which steps begin."""

    def bent(b: pa.RecordBatch) -> Iterator[tuple]:
        """Hyperbolic tangents, and directions."""
        z = np.where(_rates(b, "active").astype(bool), (_rates(b, "x") - _rates(b, "m")) / _rates(b, "sd"), 0.0)
        norm = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        for start, x in ((1, np.tanh(z)), (2, z / norm)):
            yield b.column("k"), np.full(len(x), start), x

    sums = _moments(rows.join(spreads.drop("n"), "k"), bent)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for k, n, m, sd, active, start, h, s, q in zip(*(p[c] for c in ("k", "n", "m", "sd", "active", "start", "h", "s", "q"))):
                sd, active = np.array(sd), np.array(active, bool)
                mean, cov = _covariance(h, s, q)
                if start == 2:
                    cov = cov + np.outer(mean, mean)
                scatters = [(start, cov)] + [(0, np.eye(P))] * (start == 1)
                out += [(k, n, active, t, m, _inverse(c * np.outer(sd, sd), active)[0], np.inf, 0.0, not active.any()) for t, c in scatters]
            yield pd.DataFrame(out, columns=["k", "n", "active", "start", "centre", "inv", "det", "near", "done"])

    return spreads.join(sums, "k").mapInPandas(lean.batches(run), _STATE)


def _near(b: pa.RecordBatch) -> Iterator[tuple]:
    """Rows up to the bin cut."""
    x = _rates(b, "x")
    near = _bins(_distance(x, _rates(b, "centre"), _rates(b, "inv", len(_UPPER)))) <= b.column("cut").to_numpy()
    yield b.column("k").filter(pa.array(near)), b.column("start").to_numpy()[near], x[near]


def _within(b: pa.RecordBatch) -> Iterator[tuple]:
    """Rows up to a distance."""
    x = _rates(b, "x")
    near = _distance(x, _rates(b, "centre"), _rates(b, "inv", len(_UPPER))) <= b.column("within").to_numpy()
    yield b.column("k").filter(pa.array(near)), np.zeros(int(near.sum()), np.int64), x[near]


def _step(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One concentration step of all states that are not done."""
    live = state.where("not done")
    half = F.floor((F.col("n") + F.size(F.filter("active", lambda x: x)) + 1) / 2)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = _bins(_distance(_rates(b, "x"), _rates(b, "centre"), _rates(b, "inv", len(_UPPER))))
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("start"), pa.array(bins)], names=["k", "start", "bin"])

    model = live.select("k", "start", "centre", "inv")
    counts = rows.join(model, "k").mapInArrow(lean.batches(binned), "k string, start int, bin int").groupBy("k", "start", "bin").agg(F.count("*").alias("c"))
    upto = counts.selectExpr("k", "start", "bin", "sum(c) over (partition by k, start order by bin) as upto").join(live.select("k", "start", half.alias("half")), ["k", "start"])
    cut = upto.where("upto >= half").groupBy("k", "start").agg(F.min("bin").alias("cut"))
    sums = _moments(rows.join(model.join(cut, ["k", "start"]), "k"), _near)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for k, n, active, start, centre, inv, det, share, h, s, q in zip(*(p[c] for c in ("k", "n", "active", "start", "centre", "inv", "det", "near", "h", "s", "q"))):
                mean, cov = _covariance(h, s, q)
                new, less = _inverse(cov, np.array(active, bool))
                if less < det - FALL:
                    out.append((k, n, active, start, mean.tolist(), new, less, h / n, False))
                else:
                    out.append((k, n, active, start, centre, inv, det, share, True))
            yield pd.DataFrame(out, columns=["k", "n", "active", "start", "centre", "inv", "det", "near", "done"])

    return live.join(sums, ["k", "start"]).mapInPandas(lean.batches(run), _STATE).unionAll(state.where("done"))


_MODEL = "k string, centre array<double>, inv array<double>, cutoff double"


def _reweighted(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The model: of each group the state of the least determinant, weighted anew."""
    best = state.groupBy("k").agg(F.min_by(F.struct("active", "centre", "inv", "near"), F.struct("det", "start")).alias("b")).select("k", "b.*")

    def consistent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for k, active, centre, inv, share in zip(p.k, p.active, p.centre, p.inv, p.near):
                n = int(np.sum(active))
                out.append((k, active, centre, (np.array(inv) / consistency(share, n)).tolist() if n else inv, chi2_quantile(REWEIGHT, n) if n else 0.0))
            yield pd.DataFrame(out, columns=["k", "active", "centre", "inv", "within"])

    raw = best.mapInPandas(lean.batches(consistent), "k string, active array<boolean>, centre array<double>, inv array<double>, within double")
    raw = store.written(rows.sparkSession, raw, "mcd-raw")
    sums = _moments(rows.join(raw.select("k", "centre", "inv", "within"), "k"), _within).drop("start")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for k, active, h, s, q in zip(p.k, p.active, p.h, p.s, p.q):
                n = int(np.sum(active))
                mean, cov = _covariance(h, s, q)
                out.append((k, mean.tolist(), _inverse(cov * consistency(REWEIGHT, n) if n else cov, np.array(active, bool))[0], chi2_quantile(CUTOFF, n) if n else 0.0))
            yield pd.DataFrame(out, columns=["k", "centre", "inv", "cutoff"])

    return raw.select("k", "active").join(sums, "k").mapInPandas(lean.batches(run), _MODEL)


def fit(stats_rows: DataFrame, least: int = LEAST) -> DataFrame:
    """centre, inv and cutoff for each group g of rows; none where all rows together are fewer than least."""
    spark = stats_rows.sparkSession
    lang, g = _group()
    rows = stats_rows.where(~base_failed()).select(g.alias("g"), lang.alias("l"), F.array(*vector()).alias("x"))
    sizes = store.written(spark, rows.groupBy("g", "l").agg(F.count("*").alias("n")), "mcd-sizes")
    everything = sizes.agg(F.sum("n")).first()[0] or 0  # one number
    by_lang = sizes.groupBy("l").agg(F.sum("n").alias("nl"))
    key = F.when(F.col("n") >= least, F.concat(F.lit("g"), F.col("g"))).when(F.col("nl") >= least, F.concat(F.lit("l"), F.col("l"))).when(F.lit(everything >= least), F.lit("a"))
    keys = store.written(spark, sizes.join(by_lang, "l").select("g", "l", key.alias("own")), "mcd-keys")
    # A row counts for its own group's estimate, and for its language's and that of all rows where smaller groups use them.
    shared = keys.where("own is not null and not own like 'g%'").select(F.col("own").alias("k")).distinct()
    own = rows.join(keys.where("own like 'g%'").select("g", F.col("own").alias("k")), "g").select("k", "x")
    wide = rows.select(F.explode(F.array(F.concat(F.lit("l"), F.col("l")), F.lit("a"))).alias("k"), "x").join(shared, "k", "left_semi")
    sample = store.written(spark, own.unionByName(wide.select(own.columns)), "mcd-sample")
    spreads = store.written(spark, _spreads(sample), "mcd-spreads")
    state = store.written(spark, _starts(sample, spreads), "mcd-0")
    i = 0
    while state.where("not done").limit(1).count():
        i += 1
        before, state = state, store.written(spark, _step(sample, state), f"mcd-{i}")
        store.forget(before)
    # Written, so that the planner knows its size: a few numbers for each group.
    model = _reweighted(sample, state)
    model = store.written(spark, keys.join(model, keys.own == model.k).select("g", "centre", "inv", "cutoff"), "mcd-model")
    store.forget(sizes, keys, sample, spreads, state)
    return model


def judge(stats_rows: DataFrame, model: DataFrame) -> DataFrame:
    """stats_rows with base_failed, distance, cutoff and kept."""
    names = stats_rows.columns
    _, g = _group()
    rows = stats_rows.withColumns({"_g": g, "x": F.array(*vector())}).join(model.withColumnRenamed("g", "_g"), "_g", "left").withColumn("base_failed", base_failed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distance(_rates(b, "x"), _rates(b, "centre"), _rates(b, "inv", len(_UPPER)))
            cutoff = b.column("cutoff").to_numpy(zero_copy_only=False)
            failed = b.column("base_failed").to_numpy(zero_copy_only=False)
            none = np.isnan(d)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*names, "base_failed")), pa.array(d, mask=none), b.column("cutoff"), pa.array(~failed & (none | (d <= cutoff)))], names=[*names, "base_failed", "distance", "cutoff", "kept"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats_rows.schema.fields)
    return rows.select(*names, "base_failed", "x", "centre", "inv", "cutoff").mapInArrow(lean.batches(run), f"{kinds}, base_failed boolean, distance double, cutoff double, kept boolean")


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, distance, cutoff and kept for each row.

    A null text counts as empty and fails the base rule, as do all with fewer
    than 50 words. Null languages and sources form groups of their own. Groups of
    fewer than LEAST rows have too few for an estimate of their own and are
    judged with their language, and languages of fewer with all rows; tables of
    fewer by the base rule alone (distance and cutoff are null). A group in which
    no rate varies has distances of 0. Repeated rows count as often as they occur;
    null ids pass through.
    """
    rows = store.written(docs.sparkSession, with_stats(docs, ["doc_id", "lang", "source"], text), "mcd-rows")
    return judge(rows, fit(rows)).drop("lang", "source", "n_lines", "n_marks", "n_capitals", "n_same")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept. Texts are scanned once and not shuffled; the documents are told from those rejected by a hash of the row."""
    key = F.xxhash64("doc_id", "lang", "source", "text")
    rows = store.written(spark, with_stats(docs.select("lang", "source", "text", key.alias("_k")), ["_k", "lang", "source"]), "mcd-rows")
    left = keys.without(docs, key, judge(rows, fit(rows)).where("not kept").select("_k"), "rejected")
    store.forget(rows)
    return left


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
