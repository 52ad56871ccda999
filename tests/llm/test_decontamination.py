import random
import re

import numpy as np
import pyarrow as pa

from weftline.llm import decontaminate

ITEMS = [
    (1, "A train leaves Boston at 5:30 and travels 120 km in 2 hours. How fast does Anna Lee think the train is going then?"), (2, "what is the sum of all the prime numbers below ten ?"), (3, "too short"),
    (4, "six words make this whole question"), (5, "A train leaves Paris at 6:10 and travels 9 km in 3 hours. How fast does Bob think the train is going then?"), (6, None), (2, "what is the sum of all the prime numbers below ten ?"),
    (7, "Give 5 apples to Tom and 5 pears to Ann and then 5 plums to Tom before the day is over"),
]
TEXTS = [
    (1, "Intro. A train leaves Oslo at 7:45 and travels 300 miles in 4 hours. How fast does Bob think the train is going then? End."), (2, ITEMS[0][1]), (3, "nothing to see , what is the SUM of all the prime numbers below ten, hey"),
    (4, "x six words make this whole question y"), (5, None), (6, ""), (7, "what is the sum of all"), (8, "other words entirely about something else that is not there at all"), (3, "nothing to see , what is the SUM of all the prime numbers below ten, hey"),
    (9, "Give 8 apples to Kim and 8 pears to Ann and then 8 plums to Kim before the day is over"), (10, "Give 8 apples to Kim and 9 pears to Ann and then 7 plums to Joe before the day is over"),
]


def test_cases(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(*t, 5) for t in TEXTS], "doc_id long, text string, share int").repartition(3)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 4), (9, 7)}
    assert got[2, 1]["exact"] and not got[1, 1]["exact"] and got[1, 1]["n_items"] == 2 and got[3, 2]["n_items"] == 1
    assert not got[9, 7]["exact"] and got[9, 7]["share"] == 1.0


def plain_tokens(t):
    """Canonical tokens and slots, by regular expressions."""
    t = t or ""
    out = []
    last_end = 0
    common = {w for w in re.findall("[a-z]+", decontaminate.COMMON if isinstance(decontaminate.COMMON, str) else " ".join(decontaminate.COMMON))}
    for m in re.finditer(r"(?:[A-Za-z0-9\x80-\U0010ffff]|(?<=[0-9])[.,:/](?=[0-9]))+", t):
        s = m[0]
        between = t[last_end : m.start()]
        stop = not out or bool(re.search(r'[.!?:;\n"(]', between))
        low = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" else c for c in s)
        cap = lambda c: ("A" <= c <= "Z") or ("À" <= c <= "Þ" and c != "×")
        if re.search("[0-9]", s):
            out.append(["<num>", low])
        elif cap(s[0]) and len(s) > 1 and not cap(s[1]) and low not in common:
            if out and out[-1][0] == "<name>" and not stop:
                out[-1][1] += " " + low
            else:
                out.append(["<name>", low])
        elif low in decontaminate.UNITS and out and out[-1][0] == "<num>":
            out.append(["<unit>", low])
        else:
            out.append([low, None])
        last_end = m.end()
    return out


def test_templates():
    texts = [t for _, t in [*ITEMS, *TEXTS]] + ["ÉTÉ à Été Paris", "Ann Lee, Bob. Tom x", "3,000.5 kg of 2 1/2 cups", "no UNIT kg", "a" * 10]
    names: dict = {}
    for t in decontaminate.templates(pa.array(texts)):
        for j, i in enumerate(t.rows):
            want = plain_tokens(texts[i])
            got = t.tokens[t.first[j] : t.first[j + 1]]
            assert len(got) == len(want), texts[i]
            for g, (w, slot), s in zip(got, want, t.slots[t.first[j] : t.first[j + 1]]):
                assert names.setdefault(w, g) == g and (s != 0) == (slot is not None), (texts[i], w)
    assert len({int(x) for x in names.values()}) == len(names)


def test_windows_need_words():
    (t,) = decontaminate.templates(pa.array(["1 2 3 4 5 a b c", "x y 1 z w"]))
    row, at, _ = t.windows(4)
    assert [(int(r), int(a - t.first[r])) for r, a in zip(row, at)] == [(0, 3), (0, 4), (1, 0), (1, 1)]


def plain_found(items, docs, window=8, share=decontaminate.SHARE, least=decontaminate.LEAST):
    """doc_id and smallest item_id of each class that a text holds, straight from the docstring; items by template windows and word windows."""
    read = {}

    def words_of(t):
        return [("".join(c.lower() if c.isascii() or "À" <= c <= "Þ" else c for c in m[0])) for m in re.finditer(r"(?:[A-Za-z0-9\x80-\U0010ffff]|(?<=[0-9])[.,:/](?=[0-9]))+", t or "")]

    def shape(t):
        """Tokens with the number of their words, and which slots are equal."""
        if t not in read:
            tokens = plain_tokens(t)
            spans, at = [], 0
            for w, slot in tokens:
                n = len(slot.split(" ")) if w == "<name>" else 1
                spans.append((at, at + n))
                at += n
            read[t] = tokens, spans, words_of(t)
        return read[t]

    def wordy(win):
        return 2 * sum(x is None for _, x in win) >= len(win)

    def readings(t, k):
        """(place to align, tokens, opened) of each window; opened: first word of a name or unit as a word."""
        tokens, spans, ws = shape(t)
        for i in range(len(tokens) - k + 1):
            yield i, tokens[i : i + k], False
        for i, (w, slot) in enumerate(tokens):
            if w in ("<name>", "<unit>"):
                for p in range(*spans[i]):
                    rest = i if p + 1 < spans[i][1] else i + 1
                    if rest + k - 1 <= len(tokens):
                        yield rest - 1, [[ws[p], None], *tokens[rest : rest + k - 1]], p if p else "first"

    classes, out = {}, set()
    for i, t in items:
        tokens, spans, ws = shape(t)
        if ws:
            slots = [x for _, x in tokens if x is not None]
            key = tuple(w for w, _ in tokens), tuple(slots.index(x) for x in slots)
            classes.setdefault(key, []).append((i is None, i, t))
    for key, members in classes.items():
        members.sort(key=lambda m: (m[0], m[1] or 0))
        rep = members[0][2]
        tokens, spans, ws = shape(rep)
        for d, text in docs:
            dtokens, dspans, dws = shape(text)
            best = 0.0
            if len(ws) >= least and len(tokens) >= least:
                k = min(window, len(tokens))
                own = [(i, i, w) for i, w, o in readings(rep, k) if not o and wordy(w)]
                total = len(own)
                if own and own[0][0] == 0:
                    own += [(0, i, w) for i, w, o in readings(rep, k) if o == "first" and wordy(w)]
                lines = {}
                for at, have, opened in readings(text, k):
                    if wordy(have):
                        for pos, off, w in own:
                            if (not opened or pos == 0) and [x for x, _ in w] == [x for x, _ in have]:
                                lines.setdefault(at - off, []).append((pos, [(x, y) for j, ((_, x), (_, y)) in enumerate(zip(w, have)) if x is not None and not (pos == 0 and j == 0)]))
                good = set()
                for hits in lines.values():
                    pairs = {p for _, ps in hits for p in ps}
                    sound = len({x for x, _ in pairs}) == len(pairs)
                    good |= {pos for pos, ps in hits if sound or not ps}
                best = len(good) / total if total else 0.0
            variants = {}
            for *_, t in members:
                variants.setdefault(tuple(b - a for a, b in shape(t)[1]), []).append(shape(t)[2])
            for same in variants.values():
                n = len(same[0])
                if n < least:
                    best = max(best, float(dws in same))
                else:
                    k = min(window, n)
                    there = {tuple(dws[j : j + k]) for j in range(len(dws) - k + 1)}
                    best = max(best, len({j for x in same for j in range(n - k + 1) if tuple(x[j : j + k]) in there}) / (n - k + 1))
            if best >= share:
                out.add((d, members[0][1]))
    return out


def test_brute_force(spark, docs, rows):
    """Items cut from documents, and short ones, are found in those that hold them, and in no others."""
    source = [(i, t) for i, t, *_ in rows if t and len(t.split()) > 60 and i is not None][:12]
    items = [(n, " ".join(t.split()[10:50])) for n, (_, t) in enumerate(source)] + [(50, "One two"), (51, "one two three")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == plain_found(items, [(i, t) for i, t, *_ in rows]) and {n for _, n in got} >= {0, 50} and 51 not in {n for _, n in got}


def test_brute_force_with_slots(spark):
    """Random texts of names, numbers, units, common and other words, in pieces that recur with other values."""
    r = random.Random(21)
    names, plain = ["Ann", "Bob", "Joe Fox", "Kim", "Zoé", "Élan Roy"], ["sold", "clips", "apples", "half", "red", "goes", "long", "way"]

    def piece(n):
        return [r.choice(["%n", "%d", "%d km", "%d kg", "In", "The", "in", "the", ".", ",", "? What", "!", *plain, *plain]) for _ in range(n)]

    def fill(ws, values):
        out = []
        for w in ws:
            for mark, some in (("%n", names), ("%d", [str(x) for x in range(9)] + ["3.5", "1,000"])):
                if mark in w:
                    w = w.replace(mark, values.setdefault((mark, r.randrange(2)), r.choice(some)) if values is not None else r.choice(some))
            out.append(w)
        return " ".join(out)

    pieces = [piece(r.randrange(3, 30)) for _ in range(25)]
    items = [(i if i % 9 else None, fill(pieces[i % 25], {} if i % 3 else None)) for i in range(60)] + [(1000, "What is 12 + 30 + 45 + 7 ?"), (1001, "km km"), (1002, "sold 5 km")]
    docs = [(i, " ".join(fill(r.choice(pieces)[r.randrange(3) :], {} if r.random() < 0.7 else None) for _ in range(r.randrange(1, 4)))) for i in range(150)]
    docs += [(200 + i, "so Zed " * (i % 2) + t + " Then on.") for i, (_, t) in enumerate(items)]
    out = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_found(items, docs)
    assert {(x["doc_id"], x["item_id"]) for x in out} == want and len(want) > 150 and sum(not x["exact"] for x in out) > 30


PROBLEMS = [
    "{a} sold 48 clips in April. {a} sold half as many in May. {a} gave 5 clips to {b}.", "{a} earns $12 an hour for babysitting. Yesterday, {a} did 50 minutes of it. How much did {a} earn?",
    "{a} has 3 boxes of pencils with 24 in each. {b} takes 10 of them home. How many pencils are left for {a}?", "{a} and {b} drive 300 km to Lisbon at 60 kph. How many hours do they need if they rest for 2 hours?",
    "{a} writes a 3 page letter to 2 friends twice a week. How many pages does {a} write in a year?", "{a} bakes 7 trays of rolls and each holds 12. {b} buys 20 rolls. How many are there when {b} has left?",
    "The garden of {a} has 9 rows of tulips and 14 rows of roses. {a} digs up 5 rows. How many rows remain in the end?", "{a} reads 14 pages on Monday and twice as many on Tuesday. {a} wants to read 120 pages. How many pages remain?",
]


def test_questions_with_other_parameters(spark):
    """Of planted questions whose names and numbers were exchanged, at least nine in ten are found, and no other text is."""
    r = random.Random(4)
    names, months = ["Natalia", "Maria", "Weng", "Betty", "Julie", "James", "Mark", "Ken", "Olga", "Ravi", "Zoe", "Ahmed"], ["April", "May", "June", "July", "March"]

    def changed(t):
        a, b = r.sample(names, 2)
        t = re.sub(r"\b\d+", lambda m: str(r.randrange(2, 400)), t.format(a=a, b=b))
        some = r.sample(months, 2)
        return t.replace("April", some[0]).replace("in May", f"in {some[1]}").replace("Lisbon", r.choice(["Oslo", "Rome"])).replace(" km ", r.choice([" km ", " miles "]))

    items = [(i, t.format(a="Natalia", b="Bob")) for i, t in enumerate(PROBLEMS)]
    filler = lambda: " ".join(r.choice(["lorem", "ipsum", "Dolor", "sit", "the", "amet", "7", "of"]) for _ in range(40)) + ". "
    docs = [(100 * i + j, filler() + changed(t) + " " + filler()) for i, t in enumerate(PROBLEMS) for j in range(10)]
    clean = [(5000 + i, filler() + f"{r.choice(names)} has {i} of them, and {r.choice(names)} sold some in May. How many hours did they walk on Monday? " + filler()) for i in range(60)]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(d // 100 == i for d, i in got) and len(got) >= 0.9 * len(docs)


def test_items_with_windows_in_common_are_told_apart(spark):
    """A long preamble that all items share is no reason to compare a text with all of them, and hides none."""
    head = "Read the question with care and choose the one letter of the answer that fits it best of all here."
    r = random.Random(6)
    tail = lambda: " ".join("".join(r.choice("aeiou") + r.choice("bdgkl") for _ in range(3)) for _ in range(30))
    items = [(i, head + " " + tail()) for i in range(30)]
    docs = [(i, "see " + t) for i, t in items] + [(100, head + " " + tail())]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == plain_found(items, docs) and {(i, i) for i in range(30)} <= got


def test_empty(spark, docs, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).collect() == []
    assert decontaminate.contaminated(none, spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_stage(spark, docs, tmp_path):
    items = spark.createDataFrame([(0, docs.where("length(text) > 300").first()["text"])], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = decontaminate.stage(spark, docs, str(tmp_path))
    bad = {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()}
    assert kept.columns == docs.columns and bad
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(r["doc_id"]) for r in docs.collect() if r["doc_id"] not in bad)


def test_slots_are_aligned():
    (t,) = decontaminate.templates(pa.array(["go 5 km with Ann Lee now or 5 later"]))
    a, b = (np.frombuffer(x, np.uint64) for x in decontaminate._slots(t, np.array([0, 1]), 4))
    assert a[1] == b[0] and a[0] == 0


def test_items_of_one_template_with_other_equal_values(spark):
    items = spark.createDataFrame([ITEMS[-1], (8, TEXTS[-1][1]), (None, "a word that has no number in it is the item"), (None, "a word that has no number in it is the item")], "item_id long, text string")
    docs = spark.createDataFrame([*TEXTS[-2:], (11, ITEMS[-1][1]), (12, "a word that has no number in it is the item")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {(9, 7), (9, 8), (10, 8), (11, 7), (11, 8), (12, None)}
    assert got[10, 8]["exact"] and got[10, 8]["share"] == 1.0 and got[11, 7]["exact"] and not got[11, 8]["exact"]
    assert got[12, None]["n_items"] == 1


def test_items_of_slots_are_found_word_for_word(spark):
    texts = ["What is 12 * 7 + 3 - 4 ?", "what is 12 * 8 + 3 - 4 ?", "Ann Lee, Bob Ray, Tom Fox", "x 1 2 3 4 5 6 7 8 9 10 11 12", "Ann 5 Bob 6 Tom 7 Joe 8 Kim 9 Lou 10 and so on for all of the others in it"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = [(n, f"here stands Zoe {t} Eve and more") for n, t in enumerate(texts)]
    docs += [(10, "what is 13 * 7 + 3 - 4 ?"), (11, "Ann Lee, Bob Ray, Tom Dow"), (12, "x 1 2 3 4 5 6 7 9 9 10 11 12")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 2), (3, 3), (4, 4)}
    assert got[0, 0]["exact"] and got[0, 0]["n_items"] == 2 and (got[3, 3]["n_windows"], got[3, 3]["n_item_windows"]) == (6, 6)


def test_first_words_within_a_sentence(spark):
    items = [(1, "What is the capital of France"), (2, "Which Dane wrote most of it"), (3, "Hours of work were lost last year"), (4, "what color are the tall trees")]
    docs = [
        (1, "in the quiz What is the capital of France was asked"), (2, "then the quiz What is the capital of Spain was asked"), (3, "so Rome is the capital of Italy as said"), (4, "for Ann What is the capital of Peru was hard"),
        (5, "on and on Which Swede wrote most of it is unclear"), (6, "on and on Old Which Swede wrote most of it is unclear"), (7, "some 5 hours of work were lost last year"), (8, "see What color are the tall trees now"),
    ]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 1), (5, 2), (6, 2), (7, 3), (8, 4)}
    assert got[1, 1]["exact"] and not got[2, 1]["exact"]


def test_opened_windows():
    texts = ["see Ann Lee now or 5 km with Joe Fox", "x y", "", "then Bob"]
    for t in decontaminate.templates(pa.array(texts)):
        row, at, h, slots, word = t.opened(3)
        got = [(int(r), int(a - t.first[r]), s.tolist()) for r, a, s in zip(row, at, slots)]
        ann = int(t.slots[t.first[0] + 1])
        # ann NAME now; lee now or; km with NAME.
        assert got == [(0, 0, [0, ann, 0]), (0, 1, [0, 0, 0]), (0, 5, [0, 0, int(t.slots[t.first[1] - 1])])]
        (lee,) = decontaminate.templates(pa.array(["lee now or"]))
        assert h[1] == lee.windows(3)[2][0]
