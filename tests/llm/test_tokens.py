import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from weftline.llm import pieces, sentence_pieces, token_counts, words

ODD = ["", None, " ", "  a  b ", "\n\t x", "a▁b", "▁", "①ﬁ é", "<s> a </s><unk>", "<0x0A>", "\x00a\x00", "ünïcode 😀 日本語", "a\r\nb", "　x\xa0y", "a" * 5000, " " * 3000, "the" * 1500 + " x", "ab c" * 50]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    return ODD + ["".join(r.choice("  abcdeinghtor▁\né日\t😀<>/s0xA") for _ in range(r.randrange(60))) for _ in range(800)]


@pytest.fixture(scope="module")
def model():
    with open(pieces.default_model(), "rb") as f:
        return f.read()


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_counts_are_the_librarys(monkeypatch, texts, model, chunk):
    monkeypatch.setattr(words, "CHUNK_BYTES", chunk)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert token_counts.Counter(model)(pa.array(texts)).tolist() == [len(library.encode(t or "")) for t in texts]


def one_by_one(m, t):
    """Symbols left when the leftmost pair of the lowest rank is merged, again and again."""
    sym = [int(m.symbol[ord(c)]) for c in t]
    cost = [int(m.cost[s]) if s >= 0 else len(c.encode()) for s, c in zip(sym, t)]
    while len(sym) > 1:
        rank, made = m.pairs(np.array(sym[:-1]), np.array(sym[1:]))
        i = int(np.argmin(rank))
        if rank[i] == token_counts.NONE:
            break
        sym[i : i + 2], cost[i : i + 2] = [int(made[i])], [int(m.cost[made[i]])]
    return sum(cost)


def test_all_places_at_once_are_one_by_one(model):
    m = token_counts.merger(model)
    r = random.Random(2)
    tokens = ["".join(r.choice("the ing▁aé日") for _ in range(r.randrange(90))).replace(" ", "▁") for _ in range(60)] + ["a" * 31, "ab" * 20, "aab" * 15]
    assert m.count(tokens).tolist() == [one_by_one(m, t) for t in tokens]


def test_long_sequences(model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    r = random.Random(4)
    long = ["".join(r.choice("etaoinshrdlucmfé日") for _ in range(n)) for n in (2047, 2049, 30000)] + ["ing" * 5000, "a" * 10001]
    assert token_counts.Counter(model)(pa.array(long)).tolist() == [len(library.encode(t)) for t in long]


@pytest.mark.parametrize("seed", range(4))
def test_vocabularies_whose_merges_make_lower_ranks(seed):
    """Random ranks, ties among them: a longer piece may come before the pieces it is made of."""
    r = random.Random(seed)
    words_ = ["".join(t) for n in (1, 2, 3, 4) for t in product("ab", repeat=n)]
    m = token_counts.Merger(None, {t: i for i, t in enumerate(words_)}, [-float(r.randrange(12)) for _ in words_])
    assert m.alone.any()
    tokens = ["".join(r.choice("abc") for _ in range(r.randrange(30))) for _ in range(200)]
    assert m.count(tokens).tolist() == [one_by_one(m, t) for t in tokens]


def test_forgetting_changes_nothing(model, texts):
    c = token_counts.Counter(model)
    c.known.most = 10
    assert c(pa.array(texts)).tolist() == token_counts.Counter(model)(pa.array(texts)).tolist()


def test_query(docs, rows, none):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t, *_ in rows), key=str)
    assert sorted(map(tuple, token_counts.token_counts(docs, limit=100).collect()), key=str) == want
    assert token_counts.token_counts(none).collect() == []


def brute(s, t):
    best = [(0.0, [])] + [None] * len(t)
    for e in range(1, len(t) + 1):
        for k in range(e):
            i = s.p.ids.get(t[k:e])
            if i is not None:
                x = (best[k][0] + s.p.score[i], best[k][1] + [i])
            elif e - k == 1:
                x = (best[k][0] + s.unknown, best[k][1] + [int(s.p.bytes[b]) for b in t[k].encode()])
            else:
                continue
            if best[e] is None or x[0] > best[e][0]:
                best[e] = x
    return best[-1][1]


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_segmentation(monkeypatch, texts, model, chunk):
    monkeypatch.setattr(words, "CHUNK_BYTES", chunk)
    s = sentence_pieces.segmenter(model)
    short = [t for t in texts if len(t or "") < 100]
    for which, ids, first in sentence_pieces.Encoder(model)(pa.array(short)):
        data, offs = s.decode(ids, first)
        for j, i in enumerate(which):
            t = short[i] or ""
            assert ids[first[j] : first[j + 1]].tolist() == (brute(s, "▁" + t.replace(" ", "▁")) if t else [])
            assert data[offs[j] : offs[j + 1]].tobytes().decode() == t.replace("▁", " ")


def test_segmentation_scores_as_the_library(model, texts):
    """The library's unigram segmentation of the same model, where its single-precision sums are exact."""
    number = model.index(b"\x18\x02", model.rindex(b"tok_v0"))  # model_type: BPE; 1 is unigram
    library = sentencepiece.SentencePieceProcessor(model_proto=model[: number + 1] + b"\x01" + model[number + 2 :])
    s = sentence_pieces.segmenter(model)
    byte = {int(i): b for b, i in enumerate(s.p.bytes)}

    def total(ids):
        """Characters as their bytes cost as one unknown each."""
        return sum(s.p.score[i] if i not in byte else s.unknown * (byte[i] & 0xC0 != 0x80) for i in ids)

    for t in ["hello world this is text", "retionan thon blesesti", "ab", *(t for t in texts if t and len(t) < 2000)]:
        got, want = total(s.segment("▁" + t.replace(" ", "▁"))), total(library.encode(t))
        assert abs(got - want) <= 1e-5 * abs(want), t


def test_round_trip(docs, rows, none):
    out = sentence_pieces.encode(docs)
    assert out.where("not round_trip").count() == 0 and out.count() == len(rows)
    back = sorted(((r["doc_id"], r["text"]) for r in sentence_pieces.decode(out).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t, *_ in rows), key=str)
    assert sentence_pieces.encode(none).collect() == []


def test_decoding_what_is_no_piece(spark):
    df = spark.createDataFrame([(1, [5, 99999999, -1, 0, 1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in sentence_pieces.decode(df).orderBy("doc_id").collect()][1:] == ["", ""]
