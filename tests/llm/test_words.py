import random
import re

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import words

TEXTS = ["a b\tc  d", None, "", "x" * 300 + " y z" * 60, "end", "\n\n", " é日 本", "foo", "foo bar A a", "x" * 1000]


@pytest.mark.parametrize("chunk", [50, 1 << 20])
@pytest.mark.parametrize("lower", [False, True])
def test_split(monkeypatch, chunk, lower):
    monkeypatch.setattr(words, "CHUNK_BYTES", chunk)
    seen = {}
    for column in (pa.array(TEXTS), pa.array(["skip", *TEXTS]).slice(1), pa.array(TEXTS, pa.large_string())):
        rows = []
        for w in words.split(column, lower):
            for j, i in enumerate(w.rows):
                got = [w.data[a:b].tobytes() for a, b in zip(w.starts[w.of(j)], w.ends[w.of(j)])]
                assert got == (TEXTS[i] or "").encode().split()
                rows.append(i)
                for x, h in zip(got, w.hashes[w.of(j)]):
                    assert seen.setdefault(x.lower() if lower else x, h) == h
        assert rows == list(range(len(TEXTS)))
    assert len(set(seen.values())) == len(seen)
    assert list(words.split(pa.array([], pa.string()))) == []


def test_runs():
    r = np.random.default_rng(1)
    h = r.integers(0, 5, 200).astype(np.uint64)
    for k in (1, 3, 7):
        got = words.runs(h, k)
        by = {}
        for i, x in enumerate(got):
            assert by.setdefault(tuple(h[i : i + k]), x) == x
        assert len(set(by.values())) == len(by)
    assert len(words.runs(h[:2], 3)) == 0 and words.whole(h[:3]) == words.runs(h, 3)[0]


def test_lowered():
    data = np.frombuffer("ÉÑ×ßé Ab".encode(), np.uint8)
    assert words.lowered(data).tobytes().decode() == "éñ×ßé Ab"


def brute_words(t, lower=False):
    t = t or ""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t)


def test_brute_words_are_the_same():
    r = random.Random(4)
    texts = ["".join(r.choice("aB é\n\t　\x0b\x1c") for _ in range(30)) for _ in range(50)]
    for w in words.split(pa.array(texts)):
        for j, i in enumerate(w.rows):
            assert [w.data[a:b].tobytes().decode() for a, b in zip(w.starts[w.of(j)], w.ends[w.of(j)])] == brute_words(texts[i])
