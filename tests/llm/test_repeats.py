import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import repeats, words


def brute(rows, window=35):
    ws = [(t or "").encode().split() for _, t, *_ in rows]
    n = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for (doc, *_), w in zip(rows, ws):
        gone = {j for i in range(len(w) - window + 1) if n[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs, **more):
    out = repeats.without_repeats(docs, **more)
    return sorted(map(tuple, out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()), key=str)


@pytest.mark.parametrize("pack", [200, 1 << 20])
def test_documents(monkeypatch, docs, rows, pack):
    monkeypatch.setattr(repeats, "PACK", pack)
    got = run(docs)
    assert got == brute(rows) and any(r[2] for r in got)


def test_without_an_index(docs, rows):
    assert run(docs, indexed=False) == brute(rows)


def test_short_windows(docs, rows):
    assert run(docs, block=3) == brute(rows, 5)


def test_within_one_text_and_overlaps(spark):
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"{a} x {a}"), (2, "same " * 100), (3, a[:-5]), (4, " ".join(f"w{i}" for i in range(5, 39))), (5, " ".join(f"v{i}" for i in range(70)))]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_empty(none, spark):
    assert run(none) == []
    assert run(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")) == brute([(1, None), (2, "a b")])


def test_bit_maps_miss_nothing():
    h = words.mix(np.arange(5000, dtype=np.uint64))
    m = repeats.bit_map(h)
    assert repeats.in_map(m, h).all()
    assert repeats.in_map(m, words.mix(np.arange(10**6, 10**6 + 50000, dtype=np.uint64))).mean() < 0.01
    assert not repeats.in_map(repeats.bit_map(h[:0]), h).any()
