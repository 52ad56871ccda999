import re

import numpy as np
import pytest

from weftline.llm import components, jaccard_join


def sets(rows, k=5):
    out = []
    for _, t, *_ in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set())
    return out


def brute(rows, k=5, percent=75):
    ss = sets(rows, k)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(ss):
        for j in range(i):
            b = ss[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], len(ss[i]), (min(ids) if ids else None) if ss[i] else rows[i][0]) for i in g]
    return sorted(out, key=str)


def run(docs, **more):
    return sorted(map(tuple, jaccard_join.jaccard_join(docs, **more).collect()), key=str)


@pytest.mark.parametrize(("pack", "many"), [(1 << 20, 16), (300, 2)])
def test_documents(monkeypatch, docs, rows, pack, many):
    monkeypatch.setattr(jaccard_join, "PACK", pack)
    monkeypatch.setattr(jaccard_join, "MANY", many)
    got = run(docs)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(got)


def test_other_parameters(docs, rows):
    assert run(docs, k=2, percent=80) == brute(rows, 2, 80)


def test_chains_and_thresholds(spark):
    """Links at the threshold itself, just below it, and chains whose ends are far apart."""
    base = [f"t{i}" for i in range(60)]
    rows = [(100 - i, " ".join(base[2 * i :] + [f"n{j}" for j in range(2 * i)])) for i in range(25)]
    rows += [(200, "a b c d e f g h"), (201, "a b c d e f g"), (202, "a b c d e f"), (203, "A B c d e"), (204, "one"), (205, "ONE"), (206, None), (207, " ")]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_rounds(spark, monkeypatch):
    """A large group that is closed by its centre, and enough rounds to need it."""
    import random

    r = random.Random(9)
    base = [f"t{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        ws = list(base)
        for _ in range(r.randrange(1, 6)):
            ws[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize(("rounds", "k", "percent"), [(0, 5, 75), (1, 1, 20)])
def test_large_buckets_of_unlike_sets(spark, monkeypatch, rounds, k, percent):
    """Many sets with tokens in common, of which few are similar: dealt out by the second order, and by pairs, with the same links."""
    import random

    r = random.Random(5)
    shared = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(150):
        own = [f"w{i}x{j}" for j in range(70)]
        rows.append((2 * i, " ".join(shared + own)))
        if i % 6 == 0:
            own[r.randrange(70)] = "new"
            rows.append((2 * i + 1, " ".join(shared + own)))
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, k=k, percent=percent) == brute(rows, k, percent)


def test_prefixes_meet_under_every_order():
    """What the filters rest on: similar sets share a token of their prefixes under each order, whatever the levels."""
    r = np.random.default_rng(8)
    order = jaccard_join.Order.__call__
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 60, r.integers(4, 80)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - int(r.integers(0, len(a) // 6 + 1))], r.integers(0, 1 << 60, r.integers(0, 4)).astype(np.uint64)]))
        if jaccard_join.similar(a, b):
            level = lambda h: h % np.uint64(5)
            for i in range(len(jaccard_join.ORDERS)):
                x, y = (h[np.argsort(order(None, h, level(h), i))[: jaccard_join.prefix_length(np.array([len(h)]))[0]]] for h in (a, b))
                assert jaccard_join.common(np.sort(x), np.sort(y))


def test_empty(none):
    assert run(none) == []


def test_similar_is_exact():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(r.integers(0, 40, r.integers(1, 30)).astype(np.uint64))
        b = a.copy()
        b[r.integers(0, len(b), r.integers(0, 4))] += np.uint64(100)
        b = np.unique(b)
        m = len(np.intersect1d(a, b))
        assert jaccard_join.similar(a, b) == (100 * m >= 75 * (len(a) + len(b) - m))


def test_components(spark):
    import random

    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(150, 160)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {x["u"]: x["p"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in {e for p in edges if p[0] != p[1] for e in p}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stage(spark, docs, rows):
    kept = jaccard_join.stage(spark, docs, "")
    assert kept.columns == docs.columns
    want = {c for i, n, c in brute(rows) if i == c}
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, want))


def test_stage_without_ids(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text, 1), (None, text, 1), (None, text + " h", 2), (5, "z y x w v", 3), (5, "z y x w v", 3), (5, "q r s t u", 4), (6, None, 5)], "doc_id long, text string, s int")
    kept = sorted((str(r["text"]) for r in jaccard_join.stage(spark, df, "").collect()))
    assert kept in ([*sorted(["None", x, "q r s t u", "z y x w v"])] for x in (text, text + " h"))
