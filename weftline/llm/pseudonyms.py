"""Format-preserving pseudonyms: private values are permuted, under a key, within their format.

What looks like a private number or date is first validated: payment cards by
Luhn's sum, IBANs by their remainder, IPv4 addresses, social security numbers and
dates by their ranges, phone numbers by their length. A valid value is replaced
by another valid one of the same format, by a Feistel network over the values of
the format; where that has fewer values than the network, it is walked until a
valid one is met, which keeps it a permutation. Equal values have equal
pseudonyms wherever they stand, different ones different, and whoever has the
key can turn them back. E-mail addresses and assigned secrets are permuted in
the same way, letters within letters and digits within digits, by a network over
their characters: each half is shifted, character by character, by a stream made
of all of the other half, so it takes any length and leaves no part as it was.
"""

from __future__ import annotations

import hashlib
import math
import re
import secrets
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lean
from .columns import aside

ROUNDS = 8
KEY_SETTING = "weftline.pseudonym.key"
#: Pseudonyms of longer values are not kept for the next time.
KEPT = 100


class Permutation:
    """Keyed permutations of 0 .. n-1, and of strings over given alphabets."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, tweak: bytes, i: int, n: int, x: int) -> int:
        """At least 64 bits more than n has."""
        message = b"%d|%d|" % (i, len(tweak)) + tweak + b"%d|%d" % (n, x)
        return int.from_bytes(hashlib.shake_256(self.key + message).digest(n.bit_length() // 8 + 9), "big")

    def string(self, sizes: np.ndarray, x: np.ndarray, tweak: bytes, back: bool = False) -> np.ndarray:
        """x, whose i-th number is under sizes[i], permuted among all such: two halves, each shifted by a stream made of the other."""
        half = len(x) // 2
        parts = [x[:half].astype(np.int64), x[half:].astype(np.int64)]
        of = [sizes[:half].astype(np.int64), sizes[half:].astype(np.int64)]
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            to, by = i % 2, 1 - i % 2
            message = b"s%d|%d|%d|" % (i, len(tweak), len(x)) + tweak + parts[by].astype(np.uint8).tobytes()
            stream = np.frombuffer(hashlib.shake_256(self.key + message).digest(4 * len(parts[to])), "<u4").astype(np.int64)
            parts[to] = (parts[to] + (-stream if back else stream)) % of[to]
        return np.concatenate(parts)

    def _network(self, n: int, x: int, tweak: bytes, back: bool) -> int:
        """A permutation of 0 .. a*b-1, where a*b is the least such product at or above n."""
        a = math.isqrt(n)
        b = -(-n // a)
        left, right = divmod(x, b)  # left < a, right < b
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2 == 0:
                left = (left + (-1 if back else 1) * self._f(tweak, i, n, right)) % a
            else:
                right = (right + (-1 if back else 1) * self._f(tweak, i, n, left)) % b
        return left * b + right

    def __call__(self, n: int, x: int, tweak: bytes, back: bool = False, ok: Callable[[int], bool] = lambda x: True) -> int:
        """x, for which ok holds, permuted among the numbers under n for which it does."""
        while True:
            x = self._network(n, x, tweak, back)
            if x < n and ok(x):
                return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced by others."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def card(p: Permutation, s: str, back: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = len(d) - 1
    ok = lambda x: len(set((y := str(x).zfill(n)) + luhn_digit(y))) > 1
    y = str(p(10**n, int(d[:-1]), b"card", back, ok)).zfill(n)
    return _refill(s, y + luhn_digit(y))


#: Characters of each country's IBANs.
IBAN_LENGTHS = {
    c: n for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items() for c in cs.split()
}


def _iban_ends(s: str) -> list[int]:
    """Where s may end, between words: first at its country's length, so that a pseudonym is read as its value was, then the longest."""
    ends = [len(s), *(m.start() for m in re.finditer(" ", s))]
    own = [i for i in ends if len(s[:i].replace(" ", "")) == IBAN_LENGTHS.get(s[:2])]
    return own + sorted(set(ends) - set(own), reverse=True)


def iban(p: Permutation, s: str, back: bool) -> str | None:
    d = s.replace(" ", "").upper()
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(d) <= 34 or number(d[4:] + d[:4]) % 97 != 1 or not 2 <= int(d[2:4]) <= 98:
        return None
    rest = classes(p, d[4:], b"iban" + d[:2].encode(), back)
    check = 98 - number(rest + d[:2] + "00") % 97
    out = iter(d[:2] + f"{check:02d}" + rest)
    return "".join(c if c == " " else next(out) for c in s)


def ipv4(p: Permutation, s: str, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(x) > 255 or x != str(int(x)) for x in parts):
        return None
    x = 0
    for v in parts:
        x = x << 8 | int(v)
    x = p(1 << 32, x, b"ipv4", back)
    return ".".join(str(x >> k & 255) for k in (24, 16, 8, 0))


def phone(p: Permutation, s: str, back: bool) -> str | None:
    """The country's code stays."""
    code = re.match(r"\+\d{1,3}(?=\D)", s)
    head = code[0] if code else s[:2] if s[0] == "+" else ""
    d = re.sub(r"\D", "", s[len(head) :])
    if not 10 <= len(d) + len(head) - bool(head) <= 15 or len(d) < 7:
        return None
    return head + _refill(s[len(head) :], str(p(10 ** len(d), int(d), b"phone" + head.encode(), back)).zfill(len(d)))


def ssn(p: Permutation, s: str, back: bool) -> str | None:
    ok = lambda x: (a := x // 10**6) not in (0, 666) and a < 900 and x // 10**4 % 100 and x % 10**4
    x = int(s.replace("-", ""))
    return _refill(s, str(p(10**9, x, b"ssn", back, lambda x: bool(ok(x)))).zfill(9)) if ok(x) else None


_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def day(p: Permutation, s: str, back: bool) -> str | None:
    """A date between 1900 and 2099, written year first, or day first, or, where that is none, month first."""
    a, b, c = map(int, re.split(r"[-/.]", s))
    sep = re.search(r"[-/.]", s)[0]
    sizes = [len(x) for x in re.split(r"[-/.]", s)]
    orders = ["ymd"] if sizes[0] == 4 else ["dmy", "mdy"]
    for order in orders:
        v = dict(zip(order, (a, b, c)))
        try:
            at = date(v["y"], v["m"], v["d"]).toordinal()
        except ValueError:
            continue
        if _FIRST <= at <= _LAST:
            # Days past the 12th are read alike either way round; others are kept among themselves, so that the reading stays.
            # Days and months of one digit stay such.
            size = dict(zip(order, sizes))

            def ok(x: int, order: str = order, size: dict = size) -> bool:
                t = date.fromordinal(_FIRST + x)
                return (order == "ymd" or order == "dmy" or t.day > 12) and (size["d"] == 2 or t.day < 10) and (size["m"] == 2 or t.month < 10)

            t = date.fromordinal(_FIRST + p(_LAST - _FIRST + 1, at - _FIRST, b"date" + order.encode(), back, ok))
            w = {"y": f"{t.year:04d}", "m": f"{t.month:0{size['m']}d}", "d": f"{t.day:0{size['d']}d}"}
            return sep.join(w[k] for k in order)
    return None


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@lru_cache(8)
def _tables(sets: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The set of each ASCII character (-1: none), its place in it, and the characters of each."""
    letters = [np.frombuffer(c.encode(), np.uint8) for c in sets]
    kind, place = np.full(128, -1), np.zeros(128, np.int64)
    for i, c in enumerate(letters):
        kind[c], place[c] = i, np.arange(len(c))
    return kind, place, letters


def _within(p: Permutation, s: str, sets: tuple[str, ...], tweak: bytes, back: bool) -> str:
    """Each character of s among those of the set it is in; the rest stays."""
    table, place, letters = _tables(sets)
    codes = np.frombuffer(s.encode("utf-32-le"), "<u4")
    kind = np.where(codes < 128, table[np.minimum(codes, 127)], -1)
    at = np.flatnonzero(kind >= 0)
    sizes = np.array([len(c) for c in sets])[kind[at]]
    shape = "".join("0aA"[k] if k >= 0 else c for k, c in zip(kind.tolist(), s)).encode()
    x = p.string(sizes, place[codes[at]], tweak + shape, back)
    out = codes.copy()
    for i, c in enumerate(letters):
        out[at[kind[at] == i]] = c[x[kind[at] == i]]
    return out.tobytes().decode("utf-32-le")


def classes(p: Permutation, s: str, tweak: bytes, back: bool) -> str:
    """Letters among letters of their case, digits among digits, all in one permutation; the rest stays."""
    return _within(p, s, _SETS, tweak, back)


def email(p: Permutation, s: str, back: bool) -> str | None:
    """The last part of the domain stays."""
    name, _, top = s.rpartition(".")
    return classes(p, name, b"mail" + top.lower().encode(), back) + "." + top


def secret(p: Permutation, s: str, back: bool) -> str | None:
    """Hexadecimal strings stay such."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) and re.search(r"[A-Fa-f]", s):
        out = _within(p, s.lower(), ("0123456789abcdef",), b"hex", back)
        return out if s == s.lower() else out.upper()
    return classes(p, s, b"secret", back)


EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w@])")
SECRET = re.compile(r"(?i)(?<![A-Z0-9])((?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|password|passwd|pwd)\s*[:=]\s*[\"']?)([A-Z0-9+/_-]{16,})(?![A-Z0-9+/_-])")
NUMBER = re.compile(
    r"(?<![\w.+])(?:"
    r"(?P<ipv4>\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))"
    r"|(?P<day>(?:\d{4}(?P<s>[-/.])\d{1,2}(?P=s)\d{1,2}|\d{1,2}(?P<q>[-/.])\d{1,2}(?P=q)\d{4})(?![\d-]))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|\d{3} \d{3} \d{4}(?![\d-]))"
    r"|(?P<card>\d{4}(?P<t>[ -])\d{4}(?P=t)\d{4}(?P=t)\d{1,7}(?!\d)|\d{4}(?P<u>[ -])\d{6}(?P=u)\d{5}(?!\d)|\d{13,19}(?!\d))"
    r"|(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    # A time may follow a date.
    r")(?(day)(?!(?!T\d\d)[A-Za-z_])|(?![A-Za-z_]))"
)
DIGITS = re.compile(r"\d\D?\d")
KINDS: dict[str, Callable[[Permutation, str, bool], str | None]] = {"ipv4": ipv4, "day": day, "ssn": ssn, "phone": phone, "card": card, "iban": iban}


class Pseudonyms:
    """Replaces the private values of texts; back turns them into what they were."""

    def __init__(self, key: bytes, back: bool = False):
        p = Permutation(key)
        made = {**KINDS, "email": email, "secret": secret}
        self.kept = lru_cache(1 << 16)(lambda kind, s: made[kind](p, s, back))
        self.made = lambda kind, s: made[kind](p, s, back)
        self.found: Counter = Counter()

    def value(self, kind: str, s: str) -> str | None:
        return self.kept(kind, s) if len(s) <= KEPT else self.made(kind, s)

    def _put(self, kind: str, s: str) -> str:
        if kind == "iban" and " " in s:
            # Words may follow that look like a part of it; those may hold values of their own.
            at = next((i for i in _iban_ends(s) if self.value(kind, s[:i]) is not None), len(s))
            if at < len(s):
                return self._put(kind, s[:at]) + self._plain(s, at, len(s))
        out = self.value(kind, s)
        if out is None:
            return s
        self.found[kind] += 1
        return out

    def __call__(self, text: str) -> str:
        """The values of one kind are not looked for within those of another that stands first here."""
        spans: list[tuple[int, int, str]] = []
        if "@" in text:
            spans += [(m.start(), m.end(), self._put("email", m[0])) for m in EMAIL.finditer(text)]
        if "=" in text or ":" in text:
            spans += [(m.start(2), m.end(2), self._put("secret", m[2])) for m in SECRET.finditer(text) if not any(a < m.end(2) and m.start(2) < b for a, b, _ in spans)]
        if not spans:
            return NUMBER.sub(lambda m: self._put(m.lastgroup if m.lastgroup in KINDS else self._kind(m), m[0]), text) if DIGITS.search(text) else text
        out, at = [], 0
        for a, b, new in sorted(spans):
            out += [self._plain(text, at, a), new]
            at = b
        return "".join([*out, self._plain(text, at, len(text))])

    def _kind(self, m: re.Match) -> str:
        return next(k for k in KINDS if m[k] is not None)

    def _plain(self, text: str, lo: int, hi: int) -> str:
        out, at = [], lo
        for m in NUMBER.finditer(text, lo, hi):
            out += [text[at : m.start()], self._put(self._kind(m), m[0])]
            at = m.end()
        return "".join([*out, text[at:hi]])


def key_of(spark: SparkSession, key: bytes | None = None) -> bytes:
    """The argument, or what the session names; without either, values can't be given pseudonyms."""
    key = key or (spark.conf.get(KEY_SETTING, None) or "").encode()
    if not key:
        raise ValueError(f"pseudonyms need a key: an argument, or {KEY_SETTING} in the session")
    return key


def run_key(spark: SparkSession) -> bytes:
    """The session's key, or one drawn for this run and kept nowhere: values are linked within the run, and nobody turns them back."""
    return key_of(spark, None if spark.conf.get(KEY_SETTING, None) else secrets.token_bytes(32))


def pseudonymise(docs: DataFrame, key: bytes | None = None, text: str = "text", back: bool = False) -> DataFrame:
    """docs with private values replaced in text, and n_private and kinds (as 'card:2,email:1') added.

    Without a key, here or as weftline.pseudonym.key of the session, it fails.
    Every row stays. A null text stays null and has none. Nulls, repeated rows,
    empty tables and other columns pass through; columns named n_private or
    kinds are replaced.
    """
    lean.small_batches(docs.sparkSession)
    key = key_of(docs.sparkSession, key)
    docs = docs.drop("n_private", "kinds")
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = Pseudonyms(key, back)
        for b in batches:
            texts, total, kinds = [], [], []
            for t in b.column(at).to_pylist():
                replace.found.clear()
                texts.append(t and replace(t))
                total.append(sum(replace.found.values()))
                kinds.append(",".join(f"{k}:{n}" for k, n in sorted(replace.found.items())))
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(kinds, pa.string())], names=[*names, "n_private", "kinds"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lean.batches(run), f"{schema}, n_private long, kinds string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with pseudonyms under run_key; n_chars counts the new text."""
    own, restore = aside(docs, {"doc_id", "text", "n_chars"})
    out = pseudonymise(own, run_key(spark))
    return restore(out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with pseudonyms under run_key."""
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), run_key(spark))
