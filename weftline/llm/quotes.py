"""Quotation linking in conversations, in DataFrame functions alone.

Lines that begin with > are quotations, as deep as they have such marks; a line
'... wrote:' in front of a deeper one announces it. Every quoted line, and every
quoted paragraph (so that one wrapped anew is still found), is normalised to
lower-case letters and digits and hashed; the hashes are joined to those of what
messages say themselves. The original of a passage is the first message of the
conversation that says it before, else the first in any conversation. A message
replies to the original that most of its least deep quotations come from; among
equals, to the one said last. Threads are followed up to their roots by doubling,
so a chain of n replies takes log n joins. The place of a message in its thread,
each after what it replies to and the replies to one message in the order of
their turns, is its rank on the way around the tree (into each message, through
its replies, and out), found by doubling as well. No conversation or thread is
gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

WROTE = r"(?i)^.+\bwrote:$"


def _marks(line: Column) -> Column:
    """The marks that a line begins with, a blank in front of each at most; by classes of characters alone, which take any length."""
    return F.regexp_replace(F.split(F.regexp_extract(line, r"^[ \t>]*", 0), r"[ \t]{2}", 2)[0], r"[ \t]+$", "")


def _lines(text: Column) -> Column:
    """level, raw, body and whether the line announces a quotation, of each line."""

    def parse(line: Column) -> Column:
        return F.struct(
            F.length(F.regexp_replace(_marks(line), "[^>]", "")).alias("level"),
            line.alias("raw"),
            F.regexp_replace(F.substring(line, F.length(_marks(line)) + 1, F.length(line)), r"^[ \t\r]+|[ \t\r]+$", "").alias("body"),
        )

    def mark(all_: Column) -> Column:
        return F.transform(all_, lambda x, i: F.struct(x["level"].alias("level"), x["raw"].alias("raw"), x["body"].alias("body"), (x["body"].rlike(WROTE) & F.coalesce(F.get(all_, i + 1)["level"] > x["level"], F.lit(False))).alias("announces")))

    return F.transform(F.array(F.transform(F.split(text, "\n", -1), parse)), mark)[0]


def _paragraphs(lines: Column) -> Column:
    """level and body of each run of lines of one level, none of them blank."""
    blank = lambda x: (x["body"] == "") | x["announces"]

    def piece(x: Column, before: Column) -> Column:
        opens = F.coalesce(blank(before) | (before["level"] != x["level"]), F.lit(True))
        body = F.translate(x["body"], "\x00\x01", "  ")
        return F.when(~blank(x), F.when(opens, F.concat(F.lit("\x00"), x["level"].cast("string"), F.lit("\x01"), body)).otherwise(F.concat(F.lit(" "), body)))

    parts = F.transform(F.array(lines), lambda all_: F.transform(all_, lambda x, i: piece(x, F.get(all_, i - 1))))[0]
    runs = F.filter(F.split(F.array_join(parts, ""), "\x00", -1), lambda r: r != "")
    return F.transform(runs, lambda r: F.struct(F.substring_index(r, "\x01", 1).cast("int").alias("level"), F.substring_index(r, "\x01", -1).alias("body")))


def normal(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"[^\p{L}\p{N}]+", " "))


def _units(lines: Column) -> Column:
    """level and hash of each line and paragraph that says something."""
    said = F.filter(lines, lambda x: ~x["announces"])
    both = F.concat(F.transform(said, lambda x: F.struct(x["level"].alias("level"), x["body"].alias("body"))), _paragraphs(lines))
    hashed = F.transform(both, lambda x: F.struct(x["level"].alias("level"), normal(x["body"]).alias("n")))
    return F.array_distinct(F.transform(F.filter(hashed, lambda x: x["n"] != ""), lambda x: F.struct(x["level"].alias("level"), F.xxhash64(x["n"]).alias("h"))))


def quoting(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike(r"(?m)^[ \t]?>"), F.lit(False))


def without_quotes(text: str = "text") -> Column:
    """What a message says itself: no quotations, nor lines that announce them, nor blank lines at its ends."""
    own = F.filter(_lines(F.col(text)), lambda x: (x["level"] == 0) & ~x["announces"])
    return F.when(quoting(text), F.regexp_replace(F.array_join(F.transform(own, lambda x: x["raw"]), "\n"), r"^[ \t\r\n]*\n|\n[ \t\r\n]*$", "")).otherwise(F.col(text))


def links(messages: DataFrame, text: str = "text") -> DataFrame:
    """conv_id, turn, n_quoted, n_linked, parent_turn and quoted_conv of each message that quotes."""
    spark = messages.sparkSession
    rows = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.col(text).alias("text"))
    quoted = rows.where(quoting()).select("conv_id", "turn", F.explode(_units(_lines(F.col("text")))).alias("u")).where("u.level > 0").groupBy("conv_id", "turn", "u.h").agg(F.min("u.level").alias("level"))
    quoted = store.written(spark, quoted, "quoted")
    wanted = quoted.select("h").distinct()
    said = rows.select("conv_id", "turn", F.explode(_units(_lines(F.col("text")))).alias("u")).where("u.level = 0").select("conv_id", "turn", "u.h").join(wanted, "h", "left_semi")
    first = store.written(spark, said.groupBy("conv_id", "h").agg(F.min("turn").alias("at")), "said")
    anywhere = first.groupBy("h").agg(F.min("conv_id").alias("other"))
    met = quoted.join(first, ["conv_id", "h"], "left").join(anywhere, "h", "left")
    met = met.select("conv_id", "turn", "level", F.when(F.col("at") < F.col("turn"), F.col("at")).alias("at"), F.when(F.coalesce(F.col("at") >= F.col("turn"), F.lit(True)) & (F.col("other") != F.col("conv_id")), F.col("other")).alias("other"))
    per = met.groupBy("conv_id", "turn", "at").agg(F.count("*").alias("n"), F.min("level").alias("level"), F.min("other").alias("other"))
    best = F.max(F.when(F.col("at").isNotNull(), F.struct((-F.col("level")).alias("level"), "n", "at")))["at"]
    return per.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("at").isNotNull() | F.col("other").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"), best.alias("parent_turn"), F.min("other").alias("quoted_conv"))


def _roots(found: DataFrame) -> DataFrame:
    """found with root_turn and depth: the first message of the thread, and how many replies lead to it."""
    spark = found.sparkSession
    up = store.written(spark, found.where("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("moved")), "up")
    while up.where("moved").limit(1).count():
        above = up.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("r"), F.col("depth").alias("d"))
        next_ = up.drop("moved").join(above, ["conv_id", "root_turn"], "left")
        up = store.written(spark, next_.select("conv_id", "turn", F.coalesce("r", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("r").isNotNull().alias("moved")), "up")
    return found.join(up.drop("moved"), ["conv_id", "turn"], "left")


#: Replies to one message that are put in order at a time.
SIBLINGS = 1000


def _after(children: DataFrame) -> DataFrame:
    """children (conv_id, parent_turn, turn) with the next reply to the same message; those of one may be many."""
    own = ["conv_id", "parent_turn"]
    group = children.withColumn("g", F.floor(F.col("turn") / SIBLINGS))
    groups = group.groupBy(*own, "g").agg(F.min("turn").alias("least"))
    later = groups.withColumn("later", F.lead("least").over(Window.partitionBy(*own).orderBy("g"))).drop("least")
    within = group.withColumn("next", F.lead("turn").over(Window.partitionBy(*own, "g").orderBy("turn")))
    return within.join(later, [*own, "g"]).select(*own, "turn", F.coalesce("next", "later").alias("next"))


def _places(found: DataFrame) -> DataFrame:
    """found (conv_id, turn, parent_turn, root_turn) with position, the message's place in its thread; the first has 0."""
    spark = found.sparkSession
    tree = found.where("parent_turn is not null").select("conv_id", "turn", "parent_turn", "root_turn")
    roots = tree.select("conv_id", F.col("root_turn").alias("turn"), F.lit(None).cast("long").alias("parent_turn"), "root_turn", F.lit(None).cast("long").alias("next")).distinct()
    nodes = tree.join(_after(tree.select("conv_id", "parent_turn", "turn")), ["conv_id", "parent_turn", "turn"]).select(roots.columns).unionAll(roots)
    below = tree.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("first"))
    nodes = store.written(spark, nodes.join(below, ["conv_id", "turn"], "left"), "tree")
    # Into a message (0) and out of it (1), and what comes next: nothing, out of the root.
    into = nodes.select("conv_id", "turn", F.lit(0).alias("way"), F.coalesce("first", "turn").alias("to"), F.col("first").isNull().cast("int").alias("to_way"), F.lit(1).cast("long").alias("n"))
    out = nodes.select("conv_id", "turn", F.lit(1).alias("way"), F.coalesce("next", "parent_turn").alias("to"), F.col("next").isNull().cast("int").alias("to_way"), F.lit(0).cast("long").alias("n"))
    walk = store.written(spark, into.unionAll(out), "walk")
    while walk.where("to is not null").limit(1).count():
        ahead = walk.select("conv_id", F.col("turn").alias("to"), F.col("way").alias("to_way"), F.col("to").alias("to2"), F.col("to_way").alias("way2"), F.col("n").alias("n2"))
        further = walk.join(ahead, ["conv_id", "to", "to_way"], "left").select("conv_id", "turn", "way", F.col("to2").alias("to"), F.col("way2").alias("to_way"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"))
        before, walk = walk, store.written(spark, further, "walk")
        store.forget(before)
    left = walk.where("way = 0").select("conv_id", "turn", "n")
    whole = left.select("conv_id", F.col("turn").alias("root_turn"), F.col("n").alias("whole"))
    place = nodes.select("conv_id", "turn", "root_turn").join(left, ["conv_id", "turn"]).join(whole, ["conv_id", "root_turn"]).select("conv_id", "turn", (F.col("whole") - F.col("n")).alias("position"))
    return found.join(place, ["conv_id", "turn"], "left")


def threads(messages: DataFrame, text: str = "text") -> DataFrame:
    """conv_id, turn, role, body, n_quoted, n_linked, parent_turn, quoted_conv, root_turn, depth and position of each row.

    Ordered by conv_id, root_turn and position (see ordered), conversations stand
    in the order of replies, each after what it replies to. A message that quotes
    nothing, or nothing known, begins a thread. quoted_conv is the smallest other
    conversation that says a passage which its own does not say before. Where as
    many of the least deep quotations come from several messages, the latest of
    these is the parent. Rows
    that repeat a conv_id and turn are one message, whose texts are read
    together; each row comes out. Rows without conv_id or turn link to nothing. A
    null text has a null body; empty tables give empty results; other columns
    are left out.
    """
    spark = messages.sparkSession
    found = _roots(store.written(spark, links(messages, text), "links"))
    found = store.written(spark, _places(store.written(spark, found, "roots")), "threads")
    rows = messages.select("conv_id", "turn", "role", without_quotes(text).alias("body"))
    out = rows.join(found, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "body", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "parent_turn", "quoted_conv", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("position", F.lit(0)).alias("position"),
    )


def ordered(messages: DataFrame, text: str = "text") -> DataFrame:
    """The messages without their quotations, as conversations in the order of replies: conv_id, root_turn, position, turn, role and body, sorted over all partitions."""
    return threads(messages, text).select("conv_id", "root_turn", "position", "turn", "role", "body").orderBy("conv_id", "root_turn", "position", "turn")


def as_replies(messages: DataFrame) -> DataFrame:
    """messages, each with what the one before says as a quotation in front, and in that what the one before that says."""
    one = messages.where("conv_id is not null and turn is not null and text is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("text", "role")).alias("m")).select("conv_id", "turn", "m.text", "m.role")
    mark = lambda t, marks: F.concat(F.lit(marks), F.regexp_replace(t, "\n", f"\n{marks}"))
    first = one.select("conv_id", (F.col("turn") + 1).alias("turn"), F.coalesce("role", F.lit("someone")).alias("r1"), mark(F.col("text"), "> ").alias("t1"))
    second = one.select("conv_id", (F.col("turn") + 2).alias("turn"), F.coalesce("role", F.lit("someone")).alias("r2"), mark(F.col("text"), ">> ").alias("t2"))
    deep = F.when(F.col("t2").isNotNull(), F.concat(F.lit("> "), F.col("r2"), F.lit(" wrote:\n"), F.col("t2"), F.lit("\n"))).otherwise("")
    quoted = F.concat(F.col("r1"), F.lit(" wrote:\n"), deep, F.col("t1"), F.lit("\n\n"), F.col("text"))
    return messages.join(first, ["conv_id", "turn"], "left").join(second, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.coalesce(quoted, F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of all conversations. The table's messages quote nothing, so each is given the one before as a quotation first."""
    return threads(store.written(spark, as_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "replies"))


REPLIES = r"""
one AS (
  SELECT conv_id, turn, min(text) AS text, coalesce(arg_min(role, text), 'someone') AS role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL GROUP BY ALL
), replies AS (
  SELECT m.conv_id, m.turn, m.role, coalesce(a.role || ' wrote:' || chr(10) || coalesce('> ' || b.role || ' wrote:' || chr(10) || '>> ' || replace(b.text, chr(10), chr(10) || '>> ') || chr(10), '')
    || '> ' || replace(a.text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || m.text, m.text) AS text
  FROM conversations m LEFT JOIN one a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1 LEFT JOIN one b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2
)"""

_SQL = r"""line AS (
  SELECT conv_id, turn, id, i, l, length(regexp_replace(regexp_extract(l, '^(?:[ \t]?>)+'), '[^>]', '', 'g')) AS level,
    regexp_replace(regexp_replace(l, '^(?:[ \t]?>)+', ''), '^[ \t\r]+|[ \t\r]+$', '', 'g') AS body
  FROM (SELECT conv_id, turn, id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l
        FROM (SELECT conv_id, turn, id, string_split(text, chr(10)) AS ls FROM c))
), marked AS (
  SELECT *, regexp_matches(body, '(?i)^.+\bwrote:$') AND coalesce(lead(level) OVER w > level, false) AS announces, lag(level) OVER w AS before
  FROM line WINDOW w AS (PARTITION BY id ORDER BY i)
), runs AS (
  SELECT *, sum(CASE WHEN body = '' OR announces OR before IS DISTINCT FROM level OR quiet THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS g
  FROM (SELECT *, coalesce(lag(body = '' OR announces) OVER (PARTITION BY id ORDER BY i), true) AS quiet FROM marked)
), unit AS (
  SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(b), '[^\p{L}\p{N}]+', ' ', 'g')) AS n
  FROM (SELECT conv_id, turn, level, body AS b FROM runs WHERE NOT announces
        UNION ALL
        SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY i) FROM runs WHERE body <> '' AND NOT announces GROUP BY conv_id, turn, id, level, g)
), quoted AS (
  SELECT conv_id, turn, n, min(level) AS level FROM unit WHERE level > 0 AND n <> '' GROUP BY ALL
), said AS (
  SELECT conv_id, n, min(turn) AS pos FROM unit WHERE level = 0 AND n <> '' GROUP BY ALL
), met AS (
  SELECT q.conv_id, q.turn, q.level, CASE WHEN s.pos < q.turn THEN s.pos END AS pos,
    CASE WHEN coalesce(s.pos >= q.turn, true) AND o.other <> q.conv_id THEN o.other END AS other
  FROM quoted q LEFT JOIN said s ON s.conv_id = q.conv_id AND s.n = q.n
  LEFT JOIN (SELECT n, min(conv_id) AS other FROM said GROUP BY n) o ON o.n = q.n
), per AS (
  SELECT conv_id, turn, pos, count(*) AS n, min(level) AS level, min(other) AS other FROM met GROUP BY ALL
), link AS (
  SELECT conv_id, turn, sum(n)::BIGINT AS n_quoted, sum(CASE WHEN pos IS NOT NULL OR other IS NOT NULL THEN n ELSE 0 END)::BIGINT AS n_linked,
    (max({'l': -level, 'n': n, 'pos': pos}) FILTER (WHERE pos IS NOT NULL)).pos AS parent_turn, min(other) AS quoted_conv
  FROM per GROUP BY conv_id, turn
), up AS (
  SELECT conv_id, turn, parent_turn AS anc, 1 AS d, [parent_turn, turn] AS path FROM link WHERE parent_turn IS NOT NULL
  UNION ALL
  SELECT up.conv_id, up.turn, link.parent_turn, d + 1, list_prepend(link.parent_turn, path) FROM up JOIN link ON link.conv_id = up.conv_id AND link.turn = up.anc AND link.parent_turn IS NOT NULL
), own AS (
  SELECT id, max(level) > 0 AS quotes, regexp_replace(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT announces), ''), '^(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+$', '', 'g') AS body
  FROM marked GROUP BY id
), place AS (
  SELECT conv_id, turn, root, d, row_number() OVER (PARTITION BY conv_id, root ORDER BY path) AS position
  FROM (SELECT conv_id, turn, min(anc) AS root, max(d) AS d, arg_max(path, d) AS path FROM up GROUP BY ALL)
)
SELECT c.conv_id, c.turn, c.role, CASE WHEN quotes THEN body ELSE text END AS body, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked,
  parent_turn, quoted_conv, coalesce(r.root, c.turn) AS root_turn, coalesce(r.d, 0) AS depth, coalesce(r.position, 0) AS position
FROM c LEFT JOIN own USING (id) LEFT JOIN link ON link.conv_id = c.conv_id AND link.turn = c.turn
LEFT JOIN place r ON r.conv_id = c.conv_id AND r.turn = c.turn
"""


def sql(messages: str, before: str = "") -> str:
    """DuckDB SQL of threads over a table, after other common table expressions."""
    return f"WITH RECURSIVE {before}c AS (SELECT *, row_number() OVER () AS id FROM {messages}), {_SQL}"


SQL = sql("replies", REPLIES + ", ")
