import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(n=220, seed=7):
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioubcdné") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = text(60)
    rows = []
    for i in range(n):
        kind = i % 11
        t = text(r.randrange(1, 160))
        if kind == 1 and rows:
            t = rows[r.randrange(len(rows))][1]
        elif kind == 2 and i > 20:
            ws = (rows[r.randrange(len(rows))][1] or "x y").split()
            for _ in range(r.randrange(1, 4)):
                ws[r.randrange(len(ws))] = r.choice(vocabulary)
            t = " ".join(ws)
        elif kind == 3:
            t = text(20) + "\n" + passage + "\n" + text(r.randrange(30))
        elif kind == 4:
            t = t.upper() if i % 2 else t.replace(" ", "  \t", 3)
        elif kind == 5:
            t = [None, "", " \n ", "one two", "x" * 5000, (text(30) + "\n") * 3][(i // 11) % 6]
        rows.append((i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2"]), len(t or "")))
    rows.append(rows[3])
    rows.append((None, passage, "en", "s1", len(passage)))
    return rows


@pytest.fixture(scope="session")
def rows():
    return made()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The documents, over several files' worth of partitions, with another column."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(1))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
