import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import ngram_model


def brute(rows, order=2):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    seq = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["</s>"] for _, t, *_ in rows]
    grams = lambda q: [tuple((["<s>"] * (order - 1) + q)[i : i + order]) for i in range(len(q))]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows]
    one, counts = Counter(), [None] * order + [Counter()]
    for q, h in zip(seq, held):
        if not h:
            one.update(q)
            counts[order].update(grams(q))
    total, types = sum(one.values()), len(one)
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts = [None] + [ngram_model._discounts([sum(c == i for c in cs.values()) for i in (1, 2, 3, 4)]) for cs in counts[1:]]
    sums, kinds = [defaultdict(int) for _ in counts], [defaultdict(lambda: [0, 0, 0, 0]) for _ in counts]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            sums[k][g[:-1]] += c
            kinds[k][g[:-1]][min(c, 3)] += 1

    def p(*g):
        if not g:
            return 1 / (types + 1)
        k = len(g)
        if not sums[k][g[:-1]]:
            return p(*g[1:])
        c, d = counts[k][g], cuts[k]
        rest = sum(d[i] * kinds[k][g[:-1]][i] for i in (1, 2, 3))
        return (max(c - d[min(c, 3)], 0) + rest * p(*g[1:])) / sums[k][g[:-1]]

    out = []
    for (i, *_), q, h in zip(rows, seq, held):
        base = sum(math.log10((one[w] + 0.1) / (total + 0.1 * (types + 1))) for w in q)
        out.append((i, h, len(q), sum(one[w] > 0 for w in q), total, base, sum(math.log10(p(*g)) for g in grams(q))))
    return out, p, one


def check(docs, rows, order=2):
    got = sorted(map(tuple, ngram_model.perplexity(docs, order=order).collect()), key=str)
    want = sorted(brute(rows, order)[0], key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-6


@pytest.mark.parametrize("order", [3, 4])
def test_higher_orders(docs, rows, order):
    check(docs, rows, order)


def test_every_word_frequent_or_none(monkeypatch, docs, rows):
    """Contexts that are spread over ranges, and all in one place, give the same."""
    for least in (1, 1 << 40):
        monkeypatch.setattr(ngram_model, "max", lambda a, b, least=least: least if a == 2 else max(a, b), raising=False)
        check(docs, rows, 3)


def test_large_counts():
    c = np.array([1, 300, 70_000, 5 << 32], np.int64)
    assert (ngram_model._unpack([ngram_model._pack(c), ngram_model._pack(c[:2])]) == np.concatenate([c, c[:2]])).all()
    s = ngram_model._sums(np.array([7, 3, 7], np.uint64), np.array([1, 5 << 32, 5 << 32]))
    assert s["x"].tolist() == [3, 7] and s["t"].tolist() == [5 << 32, (5 << 32) + 1] and s["n1"].tolist() == [0, 1] and s["n3"].tolist() == [1, 1]


def test_documents(docs, rows):
    check(docs, rows)


def test_small_packs(monkeypatch, docs, rows):
    monkeypatch.setattr(ngram_model, "PACK", 50)
    check(docs, rows)


def test_probabilities_sum_to_one(rows):
    _, p, one = brute(rows, 3)
    for v in ["<s>", "never seen", *list(one)[:5]]:
        for u in ["<s>", *list(one)[:2]]:
            assert abs(sum(p(u, v, w) for w in one) + p(u, v, "\x00") - 1) < 1e-9


def test_better_than_unigrams_on_held_out_text(spark):
    import random

    r = random.Random(3)
    after = {w: [r.randrange(50) for _ in range(3)] for w in range(50)}
    rows = []
    for i in range(300):
        w, ws = r.randrange(50), []
        for _ in range(40):
            ws.append(f"w{w}")
            w = r.choice(after[w])
        rows.append((i, " ".join(ws)))
    out = ngram_model.perplexity(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.5 * out[1]


def test_nothing_to_train_on(spark, none):
    assert ngram_model.perplexity(none).collect() == []
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(i, "a b"), (i, None)]
    got = sorted(ngram_model.perplexity(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(1, 0, 0), (3, 0, 0)]
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
