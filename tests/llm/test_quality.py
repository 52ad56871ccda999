import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from weftline.llm import quality_rules as q
from weftline.llm import words


def brute(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, dup, lines, seen = len(ws), 0, 0, set()
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(ws[i : i + 3]) for i in range(n - 2))
    covered = {j for i in range(n - 2) if c[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    marks = sum(33 <= ord(x) < 127 and not x.isalnum() for x in t)
    capitals = len(re.findall("[A-Z]", t))
    return [n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), lines, marks, capitals, sum(x * (x - 1) for x in Counter(ws).values())]


@pytest.mark.parametrize("chunk", [60, 1 << 20])
def test_stats(monkeypatch, chunk):
    monkeypatch.setattr(words, "CHUNK_BYTES", chunk)
    r = random.Random(2)
    texts = ["", None, "a", "\n\n", "a b c a b c", "é é é é é", "x\n x\nx\n", "|#| a\r\n"]
    texts += ["".join(r.choice(["a ", "b ", "c", "\n", "\t", "é ", "#", "|x ", "ab\n"]) for _ in range(r.randrange(80))) for _ in range(400)]
    for rows, c in q.stats(pa.array(texts)):
        for j, i in enumerate(rows):
            assert [int(c[k][j]) for k in q.COUNTS] == brute(texts[i]), texts[i]


def test_query(docs, rows, none):
    got = q.quality(docs)
    assert got.columns[:6] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = got.collect()
    want = sorted(((i, *brute(t)[:5]) for i, t, *_ in rows), key=str)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in out), key=str) == want
    for r in out:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert q.quality(none).collect() == []


def plain_vector(c):
    n = np.maximum(c["n_words"], 1)
    return np.stack([
        np.log((c["word_chars"] + 250) / (n + 50)), np.log(c["n_symbols"] / n + 0.02), np.log(c["n_dup_lines"] / (c["n_lines"] + 5) + 0.1), np.log(c["n_repeat_words"] / n + 0.1), np.log((c["n_marks"] + 5) / (n + 50)),
        np.log((c["n_same"] + 25) / (n * (n - 1.0) + 2500)), np.log((n + 50) / (c["n_lines"] + 5)), np.log((c["n_capitals"] + 2.5) / (n + 50)),
    ], axis=1)


def plain_mcd(x, bins=True):
    """Which rates vary, centre and scatter: the estimate straight from the docstring; bins=False: the nearer half by exact order."""
    n = len(x)
    cell = np.floor(x / q.STEP)
    at = lambda p: (np.sort(cell, axis=0)[int(np.ceil(p * n)) - 1] + 0.5) * q.STEP
    varies = 2 * (cell == np.floor(at(0.5) / q.STEP)).sum(axis=0) <= n
    if not varies.any():
        return varies, None, None
    middle, sd, x = at(0.5)[varies], np.maximum((at(0.75) - at(0.25)) / 1.349, q.STEP)[varies], x[:, varies]
    k = x.shape[1]
    z = (x - middle) / sd
    ways = z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]
    best = (np.inf,)
    for scatter in (np.eye(k), np.cov(np.tanh(z).T, bias=True).reshape(k, k), ways.T @ ways / n):
        m, s, least = middle, scatter * np.outer(sd, sd), np.inf
        while True:
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
            order = np.floor(np.log2(d + 1e-12) * q.BINS_PER_DOUBLING) if bins else d
            half = x[order <= np.sort(order)[(n + k + 1) // 2 - 1]]
            cov = np.cov(half.T, bias=True).reshape(k, k)
            det = np.linalg.slogdet(cov)[1]
            if det >= least - q.FALL:
                break
            m, s, least, share = half.mean(axis=0), cov, det, len(half) / n
        if least < best[0]:
            best = least, m, s, share
    _, m, s, share = best
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s * q.consistency(share, k)), x - m)
    near = x[d <= q.chi2_quantile(q.REWEIGHT, k)]
    return varies, near.mean(axis=0), np.cov(near.T, bias=True).reshape(k, k) * q.consistency(q.REWEIGHT, k)


def plain_kept(frame, least, **how):
    """distance and verdict of each row of counts, group by group."""
    x = plain_vector(frame)
    failed = ((frame.n_words < 50) | (100 * frame.n_repeat_words > 50 * frame.n_words)).to_numpy()
    lang = frame.lang.fillna("-").to_numpy()
    group = frame.source.fillna("-").to_numpy() + "/" + lang
    distance, kept = np.full(len(frame), np.nan), ~failed
    for g in set(group):
        here = group == g
        for members in (here, lang == lang[here][0], np.ones(len(frame), bool)):
            if (members & ~failed).sum() >= least:
                varies, m, s = plain_mcd(x[members & ~failed], **how)
                y = x[here][:, varies] - m
                distance[here] = np.einsum("ij,jk,ik->i", y, np.linalg.inv(s), y)
                kept[here] &= distance[here] <= q.chi2_quantile(q.CUTOFF, int(varies.sum()))
                break
    return distance, kept


def test_chi_squared():
    assert [round(q.chi2_quantile(p, k), 2) for p, k in ((0.95, 1), (0.99, 2), (0.975, 3), (0.999, 4), (0.5, 8))] == [3.84, 9.21, 9.35, 18.47, 7.34]
    r = np.random.default_rng(1).normal(size=(200_000, 3))
    near = r[np.linalg.norm(r, axis=1) ** 2 <= q.chi2_quantile(0.6, 3)]
    assert abs(near.var() * q.consistency(0.6, 3) - 1) < 0.02


def test_the_verdict_is_that_of_a_plain_estimate(spark):
    """On every group of a fixture: own estimates, a language's, and all rows'; and correlated outliers that no threshold of one rate sees."""
    r = np.random.default_rng(3)
    n = 1500
    words_, lines = r.integers(60, 600, n), r.integers(3, 40, n)
    a = r.normal(size=n)
    # Marks and capitals go together; in the odd ones, both in their ranges, they do not.
    odd = np.arange(n) % 25 == 0
    b = np.where(odd, -a, a + 0.15 * r.normal(size=n))
    a, b = np.where(odd, np.sign(a) * (0.8 + 0.1 * np.abs(a)), a), np.where(odd, -np.sign(a) * 0.8, b)
    frame = pd.DataFrame({
        "doc_id": np.arange(n), "lang": np.array(["en", "de", None], object)[np.minimum(np.arange(n) % 4, 2)], "source": np.array(["s1", "s2", "rare"], object)[np.where(np.arange(n) % 60 == 1, 2, np.arange(n) // 4 % 2)],
        "n_words": words_, "word_chars": (words_ * np.exp(1.6 + 0.05 * r.normal(size=n))).astype(int), "n_symbols": np.where(r.random(n) < 0.06, r.integers(1, 90, n), 0), "n_dup_lines": (r.random(n) < 0.1).astype(int),
        "n_repeat_words": np.where(r.random(n) < 0.2, r.integers(6, 50, n), 0), "n_lines": lines, "n_marks": ((words_ + 50) * 0.3 * np.exp(0.5 * a)).astype(int), "n_capitals": ((words_ + 50) * 0.2 * np.exp(0.5 * b)).astype(int),
        "n_same": (words_ * (words_ - 1) * np.exp(-4.5 + 0.3 * r.normal(size=n))).astype(int),
    })
    frame.loc[7, ["n_words", "word_chars"]] = 20, 100
    x = plain_vector(frame)
    for rate in (4, 7):
        lo, hi = np.quantile(x[~odd, rate], [0.02, 0.98])
        assert ((x[odd, rate] > lo) & (x[odd, rate] < hi)).all()
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in q.COUNTS)
    rows = spark.createDataFrame([tuple(int(v) if isinstance(v, (int, np.integer)) else v for v in t) for t in frame[["doc_id", "lang", "source", *q.COUNTS]].itertuples(index=False)], schema).repartition(4)
    got = q.judge(rows, q.fit(rows)).toPandas().sort_values("doc_id")
    distance, kept = plain_kept(frame, q.LEAST)
    assert (got.kept.to_numpy() == kept).all() and np.allclose(got.distance, distance, rtol=1e-6)
    assert not kept[odd].any() and kept[~odd].mean() > 0.97
    # By exact order of distance, not by bins, the verdict is the same but for rows at the cutoff.
    exact, same = plain_kept(frame, q.LEAST, bins=False)
    assert (same == kept).mean() > 0.995 and np.allclose(exact, distance, rtol=0.2)
    # Without their correlation, which is the estimate's, none of them is seen.
    varies, m, s = plain_mcd(x[(frame.lang == "en") & (frame.source == "s1") & (frame.n_words >= 50)])
    y = x[odd & (frame.lang == "en") & (frame.source == "s1")][:, varies] - m
    assert ((y**2 / np.diag(s)).sum(axis=1) < q.chi2_quantile(q.CUTOFF, int(varies.sum()))).all()


def test_outliers(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    rows = []
    for i in range(700):
        ws = [word() + r.choice(["", "", "", ".", ","]) for _ in range(r.randrange(60, 200))]
        ws = [w.title() if r.random() < 0.1 else w for w in ws]
        odd = i % 10 == 0
        if odd:
            ws = [w + "***" for w in ws] if i % 20 else ["|"] * len(ws) + ws
        rows.append((i, " ".join(ws), ["en", "de"][i % 2 if not odd else 0], ["a", "b", "rare"][2 if i in (1, 3, 10) else i % 3 % 2], odd))
    few = [word() for _ in range(12)]
    rows += [(1000, "\n".join(r.choice(few) for _ in range(90)), "en", "a", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, odd boolean")
    out = {x["doc_id"]: x for x in q.quality(df).collect()}
    for i, _, _, _, odd in rows:
        assert out[i]["kept"] != odd, (i, out[i])
    assert not out[1000]["base_failed"]


def test_rows_that_do_not_vary(spark):
    """Equal texts have no spread at all: no rate is left, and the base rule alone decides; one odd text among them stays."""
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, text, "en", "a") for i in range(300)] + [(300, text.replace("w", "#") + "!", "en", "a")], "doc_id long, text string, lang string, source string")
    out = q.quality(df).collect()
    assert all(x["kept"] and x["distance"] == 0.0 for x in out) and len(out) == 301


def test_few_rows_are_judged_by_the_base_rule(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "en", "a"), (2, text.replace("w", "#"), None, None)], "doc_id long, text string, lang string, source string")
    assert [r["kept"] for r in q.quality(df).collect()] == [True, True]


def test_stage(spark, docs, rows):
    kept = q.stage(spark, docs, "")
    assert kept.columns == docs.columns
    want = Counter((r["doc_id"]) for r in q.quality(docs).where("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    texts = {i: t for i, t, *_ in rows}
    assert all(r["text"] == texts[r["doc_id"]] for r in kept.where("doc_id is not null").collect())
