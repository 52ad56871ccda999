import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"
CASES = [
    (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "On Monday, user wrote:\n> Hello there.\n> How are you?\nFine, thanks!\nAnd you"),
    (1, 2, "user", "assistant wrote:\n> On Monday, user wrote:\n>> Hello there.\n>> How are\n>> you?\n>\n> Fine, thanks!\nGood"), (1, 3, "user", "no quote"),
    (1, 4, "user", "> Good\n> unknown line\nok\n"), (2, 0, "user", "> Fine, thanks!\nfrom elsewhere"), (2, 1, "user", ""), (2, 2, "user", None), (None, 1, "user", "> x\ny"), (1, 4, "user", "> Good\n> unknown line\nok\n"),
]


def made():
    r = random.Random(5)
    pool = ["alpha beta", "gamma delta epsilon", "zeta", "Eta theta!", "iota kappa", "lambda"]
    rows = list(CASES)
    for c in range(10, 50):
        for t in range(r.randrange(1, 12)):
            lines = []
            for _ in range(r.randrange(1, 7)):
                level = r.choice([0, 0, 1, 1, 2, 3])
                lines.append(r.choice([">" * level + " ", "> " * level, ">" * level]) + r.choice([*pool, "", "X wrote:"]) if level else r.choice([*pool, "", "X wrote:"]))
            rows.append((c, t, "user", "\n".join(lines)))
    return rows


def test_cases(spark):
    got = {(r["conv_id"], r["turn"]): r for r in quotes.threads(spark.createDataFrame(CASES, SCHEMA)).collect()}
    assert [got[1, t]["parent_turn"] for t in range(5)] == [None, 0, 1, None, 2]
    assert [(got[1, t]["root_turn"], got[1, t]["depth"]) for t in range(5)] == [(0, 0), (0, 1), (0, 2), (3, 0), (0, 3)]
    assert got[1, 1]["body"] == "Fine, thanks!\nAnd you" and got[1, 2]["body"] == "Good" and got[2, 2]["body"] is None and got[2, 1]["body"] == ""
    assert (got[2, 0]["parent_turn"], got[2, 0]["quoted_conv"]) == (None, 1)
    assert (got[1, 4]["n_quoted"], got[1, 4]["n_linked"]) == (3, 1) and got[None, 1]["body"] == "y"


def test_the_same_as_sql(spark):
    df = spark.createDataFrame(made(), SCHEMA).withColumn("body", F.lit("clash")).repartition(3)
    got = quotes.threads(df)
    names = sorted(got.columns)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", made())
    want = con.sql(f"SELECT {', '.join(names)} FROM ({quotes.sql('conversations')})").fetchall()
    rows = sorted((tuple(r) for r in got.select(names).collect()), key=str)
    assert rows == sorted(want, key=str) and max(r[names.index("depth")] for r in rows) > 2


def test_long_chain(spark):
    rows = [(1, 0, "user", "line 0")] + [(1, t, "user", f"> line {t - 1}\nline {t}") for t in range(1, 70)]
    got = {r["turn"]: r for r in quotes.threads(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[t]["depth"] == got[t]["position"] == t and got[t]["root_turn"] == 0 and got[t]["body"] == f"line {t}" for t in got)


def test_common_first_line(spark):
    rows = [(c, 0, "user", "same words") for c in range(200)] + [(c, 1, "assistant", "> same words\nyes") for c in range(200)]
    got = quotes.threads(spark.createDataFrame(rows, SCHEMA))
    assert got.where("turn = 1 and parent_turn = 0 and n_linked = 1").count() == 200


def test_empty_and_native(spark):
    assert quotes.threads(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame(CASES, SCHEMA)
    found = spark.createDataFrame([(1, 2, 0, 0)], "conv_id long, turn long, parent_turn long, root_turn long")
    for out in (quotes.links(df), quotes.threads(df), quotes.as_replies(df), quotes._places(found)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_places_in_a_tree(spark, monkeypatch):
    """A random tree, replies to one message in several groups: positions are those of a walk in depth."""
    monkeypatch.setattr(quotes, "SIBLINGS", 5)
    r = random.Random(7)
    parent = {t: (r.choice([0, max(0, t - 1), r.randrange(t)]) if t % 13 else None) for t in range(1, 90)} | {0: None}
    root = lambda t: t if parent[t] is None else root(parent[t])
    want = {}
    for top in (t for t in parent if parent[t] is None):
        stack, n = [top], 0
        while stack:
            t = stack.pop()
            want[t], n = n, n + 1
            stack += sorted((c for c in parent if parent[c] == t), reverse=True)
    rows = [(c, t, p, root(t) if p is not None else None) for c in (1, 2) for t, p in parent.items()]
    got = quotes._places(spark.createDataFrame(rows, "conv_id long, turn long, parent_turn long, root_turn long")).collect()
    children = {p for p in parent.values()}
    assert all(x["position"] == want[x["turn"]] for x in got if x["parent_turn"] is not None or x["turn"] in children) and len(got) == 180


def test_conversations_in_order(spark):
    rows = [(1, 0, "user", "first thing"), (1, 1, "a", "second thing"), (1, 2, "b", "> first thing\nto the first"), (1, 3, "c", "> second thing\nto the second"), (1, 4, "d", "> to the first\nfurther")]
    got = [(x["turn"], x["position"], x["body"]) for x in quotes.ordered(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(0, 0, "first thing"), (2, 1, "to the first"), (4, 2, "further"), (1, 0, "second thing"), (3, 1, "to the second")]


def test_replies_are_linked_to_what_they_quote(spark):
    rows = [(c, t, "user", f"line {c} {t}\nmore of {c} {t}") for c in range(6) for t in range(5)] + [(1, 7, None, "alone"), (None, 1, "user", "x"), (9, 0, "user", None)]
    got = {(x["conv_id"], x["turn"]): x for x in quotes.threads(quotes.as_replies(spark.createDataFrame(rows, SCHEMA))).collect()}
    for (c, t), x in got.items():
        if c is not None and c < 6 and 0 < t < 5:
            assert (x["parent_turn"], x["depth"], x["position"], x["body"]) == (t - 1, t, t, f"line {c} {t}\nmore of {c} {t}") and x["n_linked"] == x["n_quoted"]
    assert got[9, 0]["body"] is None and got[1, 7]["depth"] == 0

@pytest.mark.parametrize("text", ["x" * 200000, "> a\n" * 30000 + "b", "> a line\n\n" * 20000 + "b", ">" * 100000 + " a\nb", " >> a\n>  > b\n\t>c\n  > d", "\n" * 1000])
def test_very_long(spark, text):
    (r,) = quotes.threads(spark.createDataFrame([(1, 0, "user", text)], SCHEMA)).collect()
    assert r["body"] == ("b" if text.endswith("b") else "  > d" if text.endswith("d") else text)
