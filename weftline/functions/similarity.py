"""Similarities of texts from 0 to 100, rounded half to even: Arrow functions over bit-parallel longest common subsequences.

They follow the public descriptions of the usual ratios: 100 * (1 - d / (m + n)),
where d counts insertions and deletions and m, n the characters. Parity with a
given library can't be checked offline; tests hold them against plain definitions.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence; one big-integer step for each character of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        if m := places.get(c, 0):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_(a: str, b: str) -> float:
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def _windows(short: str, long: str, enough: int | None = None) -> float:
    """The best ratio of short with the windows of its length in long; with enough, any that shares as many characters, else less.

    How many characters a window shares with it at most (each as often as in
    both) bounds the ratio. Windows are taken by that bound, many at a time, each
    by a bit for each character of short.
    """
    n = len(short)
    codes, own = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (long, short))
    letters, kind = np.unique(own, return_inverse=True)
    at = np.searchsorted(letters, codes)
    at[at == len(letters)] = 0
    at = np.where(letters[at] == codes, at, len(letters))
    most = np.zeros(len(long) - n + 1, np.int16)
    for k, count in enumerate(np.bincount(kind)):
        total = np.concatenate([[0], np.cumsum(at == k)])
        most += np.minimum(total[n:] - total[:-n], count).astype(np.int16)
    best = 0 if enough is None else enough - 1
    if n > 62:
        for i in np.argsort(-most, kind="stable").tolist():
            if most[i] <= best or best == enough:
                break
            best = max(best, common(short, long[i : i + n]))
        return 100.0 * best / n
    bits = np.zeros(len(letters) + 1, np.uint64)
    np.bitwise_or.at(bits, kind, np.uint64(1) << np.arange(n, dtype=np.uint64))
    masks, full = bits[at], np.uint64((1 << n) - 1)
    for bound in range(int(most.max()), 0, -1):
        if bound <= best or enough is not None and best >= enough:
            break
        starts = np.flatnonzero(most == bound)
        for lo in range(0, len(starts), 1 << 14):
            part = starts[lo : lo + (1 << 14)]
            row = np.full(len(part), full)
            for j in range(n):
                hit = row & masks[part + j]
                row = ((row + hit) | (row - hit)) & full
            best = max(best, n - int(np.bitwise_count(row).min()))
            if best >= bound:
                break
    return 100.0 * best / n


def partial(a: str, b: str) -> int:
    """The best ratio of the shorter with a window of the longer, windows over its ends included."""
    if not a or not b:
        return 100 if a == b else 0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100

    def ends(s: str, t: str) -> float:
        """Windows that reach over either end; the best of them end, or begin, with a character of the shorter."""
        n, chars, top = len(s), set(s), 0.0
        for i in range(1, min(n, len(t) + 1)):
            if t[i - 1] in chars:
                top = max(top, ratio_(s, t[:i]))
        for i in range(max(1, len(t) - n + 1), len(t)):
            if t[i] in chars:
                top = max(top, ratio_(s, t[i:]))
        return top

    top = max(ends(short, long), _windows(short, long))
    return round(max(top, ends(long, short)) if len(a) == len(b) else top)


#: Longer texts are searched by _windows, which costs less a character but more to begin.
SHORT_TEXT = 1000


@lru_cache(1024)
def _needs(n: int, least: int) -> tuple[list[int], int]:
    """By length of a window: how many characters it must share with a text of n for their ratio to be least when rounded; and the least that any can do with."""
    needs = []
    for size in range(n + 1):
        c = max(0, least * (n + size) // 200 - 1)
        while round(200.0 * c / (n + size)) < least:
            c += 1
        needs.append(c)
    return needs, min((c for size, c in enumerate(needs) if c <= size), default=n + 1)


def _some_window(short: str, long: str, least: int) -> bool:
    """Whether short and some window of its length in long, windows over the ends included, have a ratio of least.

    How many characters they share at most (each as often as in both) is kept as
    the window moves; only windows that share enough are compared in full.
    """
    n, end = len(short), len(long)
    needs, fewest = _needs(n, least)
    if sum(c in long for c in short) < fewest:
        return False
    places: dict[str, int] = {}
    left: dict[str, int] = {}
    for i, c in enumerate(short):
        places[c] = places.get(c, 0) | 1 << i
        left[c] = left.get(c, 0) + 1
    full = (1 << n) - 1

    def holds(window: str) -> bool:
        row = full
        for c in window:
            if c in places:
                hit = row & places[c]
                row = ((row + hit) | (row - hit)) & full
        return n - row.bit_count() >= needs[len(window)]

    if end > SHORT_TEXT:
        if _windows(short, long, needs[n]) >= 100.0 * needs[n] / n:
            return True
        sides = (range(1, n), range(end + 1, end + n))
        return any(holds(long[max(0, i - n) : i]) for side in sides for i in side if needs[min(i, end) - max(0, i - n)] <= n)
    shared = 0
    for i, c in enumerate(long, 1):
        k = left.get(c)
        if k is not None:
            left[c] = k - 1
            shared += k > 0
        if i > n:
            k = left.get(c := long[i - n - 1])
            if k is not None:
                left[c] = k + 1
                shared -= k >= 0
        if shared >= fewest and shared >= needs[min(i, n)] and holds(long[max(0, i - n) : i]):
            return True
    return any(holds(long[i:]) for i in range(max(0, end - n) + 1, end) if needs[end - i] <= end - i)


def partial_reaches(a: str, b: str, least: int) -> bool:
    """partial(a, b) >= least, at less cost."""
    if not a or not b:
        return (100 if a == b else 0) >= least
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if least <= 0 or least <= 100 and short in long:
        return True
    return least <= 100 and (_some_window(short, long, least) or len(a) == len(b) and _some_window(long, short, least))


def tokens(s: str) -> list[str]:
    """Words as token ratios see them: in lower case, all but letters and digits as spaces, the letters of Latin-1 beyond ASCII left out."""
    return re.sub("[\x80-\xff]", "", re.sub(r"\W", " ", s).lower()).split()


def token_sort(a: str, b: str) -> int:
    x, y = " ".join(sorted(tokens(a))), " ".join(sorted(tokens(b)))
    return round(ratio_(x, y)) if x and y else 0


def token_set(a: str, b: str) -> int:
    x, y = set(tokens(a)), set(tokens(b))
    if not x or not y:
        return 0
    shared = " ".join(sorted(x & y))
    only = [" ".join(sorted(x - y)), " ".join(sorted(y - x))]
    if shared and not all(only):
        return 100
    size, gap = len(shared), 1 if shared else 0
    whole = [size + gap + len(o) for o in only]
    best = 100.0 - 100.0 * (len(only[0]) + len(only[1]) - 2 * common(*only)) / sum(whole)
    if shared:
        best = max(best, *(100.0 - 100.0 * (gap + len(o)) / (size + w) for o, w in zip(only, whole)))
    return round(best)


def _arrow(function):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b)], dtype="Int32")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.IntegerType())


partial_ratio, token_sort_ratio, token_set_ratio = map(_arrow, (partial, token_sort, token_set))


@F.pandas_udf(T.IntegerType())
def token_set_best(texts: pd.Series, other: pd.Series) -> pd.Series:
    """The best token_set of several texts with another; null where there are none, or no other."""
    return pd.Series([None if xs is None or y is None or not len(xs) else max(token_set(x, y) for x in xs) for xs, y in zip(texts, other)], dtype="Int32")


def written_in(value: str | None, text: str | None, least: int) -> bool:
    """Whether a text in lower case holds a value, word for word or about: short values by partial, others by token_set."""
    if not value or not text:
        return False
    value = value.lower().strip()
    return value in text or (partial_reaches(value, text, least) if len(value) < 40 else token_set(value, text) >= least)


@F.pandas_udf(T.ArrayType(T.StringType()))
def about(values: pd.Series, least: pd.Series, low: pd.Series) -> pd.Series:
    """medium or low for each value of a row by written_in; null for null values, and for rows without any."""

    def one(vs, ns, text):
        return None if vs is None else [None if v is None else "medium" if written_in(v, text, n) else "low" for v, n in zip(vs, ns)]

    return pd.Series([one(*row) for row in zip(values, least, low)], dtype=object)
