"""Operator 5 [native], chat formatting: quotation linking.

A message's lines carry a quote level, the number of ``>`` marks in front (white space between them allowed). The
quoted lines, their marks stripped, are normalised (A-Z lower-cased, white space collapsed) and hashed; so are the
unquoted lines of all messages. A quoted line joins the earliest message of its conversation that has it unquoted;
each conversation and hash has one such origin, so the join can't multiply rows. A message replies to the origin of
most of its quoted lines of level 1 (of equals the latest), and without any to the message before it. Replies that follow each
other are a thread, which starts at a quoted message's answer; each message has its thread, its depth in the tree of replies and its
place in the conversation, which is by turn, as replies follow what they quote. Quotes are taken out of the texts.

Cases: a null text has no lines; a null conversation is a conversation like others, a null turn comes first and is never an
origin or a reply by quotation; quotes of unknown or later messages link to nothing but are still taken out; empty lines link to
nothing; repeated rows are kept and linked alike; different texts of
one turn are linked together; texts of any length are parsed whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import discarded, written

_MARKS = r"^(?:[\x20\x09]*>)+"
#: Turns of a conversation whose order is found in one task.
TURNS = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    """Array of (level, body) of a text's lines."""
    one = lambda line: F.struct(F.char_length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(line, _MARKS, "").alias("body"))
    return F.transform(F.split(text, "\n"), one)


def _normal(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(body, _UPPER, _LOWER), r"[\x20\x09-\x0D]+", " "))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _previous_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, part, before, place): the turn before each turn and how many there are; ranges of turns are joined by their last ones."""
    turns = messages.select("conv_id", "turn").distinct().withColumn("part", F.floor(F.col("turn") / TURNS))
    order = Window.partitionBy("conv_id").orderBy("part")
    last = turns.groupBy("conv_id", "part").agg(F.max("turn").alias("last"), F.count(F.lit(1)).alias("n"))
    earlier = last.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.lag("last").over(order).alias("earlier"), (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    here = Window.partitionBy("conv_id", "part").orderBy("turn")
    turns = turns.withColumns({"before": F.lag("turn").over(here), "place": F.row_number().over(here) - 1})
    joined = turns.join(earlier, _same("conv_id", "c") & _same("part", "p"))
    return joined.select("conv_id", "turn", "part", F.coalesce("before", "earlier").alias("before"), (F.col("first") + F.col("place")).alias("place"))


def _threads(nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, place, thread_turn, reply_depth) of nodes (conv_id, turn, part, before, place, parent_turn).

    A thread is a run of messages that each reply to the one before; it starts where a conversation does and where a message quotes
    an earlier one. Depths within a thread are differences of places; those of the starts are followed up by doubling, so there is
    nothing to follow where nobody quotes.
    """
    starts = F.col("before").isNull() | ~_same("parent_turn", "before")
    nodes = written(nodes.withColumn("start", starts))
    first = F.when(F.col("start"), F.col("turn"))
    order = Window.partitionBy("conv_id").orderBy("part")
    parts = nodes.groupBy("conv_id", "part").agg(F.max(first).alias("last"))
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    here = Window.partitionBy("conv_id", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    inside = nodes.withColumn("thread_turn", F.max(first).over(here)).join(parts, _same("conv_id", "c") & _same("part", "p"))
    told = written(inside.withColumn("thread_turn", F.coalesce("thread_turn", "earlier")).drop("c", "p", "earlier", "part", "before"))
    heads = told.where("start").select(F.col("conv_id").alias("hc"), F.col("turn").alias("ht"), F.col("place").alias("head"))
    said = told.join(heads, _same("conv_id", "hc") & _same("thread_turn", "ht")).select(F.col("conv_id").alias("sc"), F.col("turn").alias("st"), F.col("thread_turn").alias("over"), (F.col("place") - F.col("head") + 1).alias("step"))
    up = told.where("start").join(said, _same("conv_id", "sc") & (F.col("parent_turn") == F.col("st")), "left")
    up = written(up.select("conv_id", "turn", "over", F.coalesce("step", F.lit(0)).alias("depth"), F.col("st").isNotNull().alias("more"), "place"))
    while up.where("more").limit(1).count():
        above = up.select(F.col("conv_id").alias("ac"), F.col("turn").alias("at"), F.col("over").alias("next"), F.col("depth").alias("rise"), F.col("more").alias("yet"))
        joined = up.join(above, _same("conv_id", "ac") & _same("over", "at") & F.col("more"), "left")
        before, up = up, written(joined.select("conv_id", "turn", F.col("next").alias("over"), (F.col("depth") + F.coalesce("rise", F.lit(0))).alias("depth"), F.coalesce("yet", F.lit(False)).alias("more"), "place"))
        discarded(before)
    heads = up.select(F.col("conv_id").alias("hc"), F.col("turn").alias("ht"), F.col("depth"), F.col("place").alias("head"))
    out = told.join(heads, _same("conv_id", "hc") & _same("thread_turn", "ht"))
    return out.select("conv_id", "turn", "parent_turn", "place", "thread_turn", (F.col("depth") + F.col("place") - F.col("head")).alias("reply_depth"))


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, depth, n_quoted, n_linked, parent_turn, thread_turn, reply_depth, place), a row for each message, without quotes.

    ``place`` orders a conversation so that replies follow what they reply to; ``reply_depth`` counts the replies above a message.
    """
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    parsed = m.withColumn("lines", _lines(F.col("text")))
    quoting = m.where(F.col("text").rlike(r"(?m)^[\x20\x09]*>")).select("conv_id").distinct().withColumnRenamed("conv_id", "q")
    once = m.join(quoting, F.col("conv_id").eqNullSafe(F.col("q")), "left_semi").where("turn is not null").select("conv_id", "turn", "text").distinct()
    line = once.select("conv_id", "turn", F.explode(_lines(F.col("text"))).alias("l"))
    line = line.select("conv_id", "turn", F.col("l.level").alias("level"), _normal(F.col("l.body")).alias("body")).where("body <> ''")
    line = line.groupBy("conv_id", "turn", "level", F.sha2("body", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    origin = line.where("level = 0").groupBy(F.col("conv_id").alias("c"), F.col("hash").alias("h")).agg(F.min("turn").alias("origin"))
    found = line.where("level > 0").join(origin, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h"))).where("origin < turn")
    by_origin = found.groupBy("conv_id", "turn", "origin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("level") == 1, F.col("n")).otherwise(0)).alias("first"))
    best = by_origin.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_linked"), F.max(F.when(F.col("first") > 0, F.struct("first", "origin"))).alias("best"))
    best = best.select(F.col("conv_id").alias("bc"), F.col("turn").alias("bt"), "n_linked", F.col("best.origin").alias("quoted_turn"))
    nodes = _previous_turns(m).join(best, _same("conv_id", "bc") & _same("turn", "bt"), "left")
    nodes = nodes.select("conv_id", "turn", "part", "before", "place", F.coalesce("quoted_turn", "before").alias("parent_turn"))
    threads = _threads(nodes).select(F.col("conv_id").alias("pc"), F.col("turn").alias("pt"), "parent_turn", "thread_turn", "reply_depth", "place")
    counts = best.select("bc", "bt", "n_linked")
    out = parsed.join(threads, _same("conv_id", "pc") & _same("turn", "pt"))
    out = out.join(counts, _same("conv_id", "bc") & _same("turn", "bt"), "left")
    kept = F.filter("lines", lambda x: x.level == 0)
    return out.select(
        "conv_id", "turn", "role", F.array_join(F.transform(kept, lambda x: x.body), "\n").alias("text"),
        F.array_max(F.transform("lines", lambda x: x.level)).cast("long").alias("depth"), (F.size("lines") - F.size(kept)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_turn", "thread_turn",
        F.col("reply_depth").cast("long").alias("reply_depth"), F.col("place").cast("long").alias("place"),
    )


SQL = r"""
WITH RECURSIVE parsed AS (SELECT conv_id, turn, role, row_number() OVER () AS row, coalesce(text, '') AS text FROM conversations),
line AS (SELECT conv_id, turn, row, place, len(regexp_replace(regexp_extract(l, '^(?:[\x20\x09]*>)+'), '[^>]', '', 'g')) AS level,
    regexp_replace(l, '^(?:[\x20\x09]*>)+', '') AS body
  FROM (SELECT conv_id, turn, row, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM parsed)),
first AS (SELECT min(row) AS row FROM parsed GROUP BY conv_id, turn, text),
normal AS (SELECT conv_id, turn, level, trim(regexp_replace(lower(body), '[\x20\x09-\x0D]+', ' ', 'g')) AS body FROM line JOIN first USING (row) WHERE turn IS NOT NULL),
origin AS (SELECT conv_id, body, min(turn) AS origin FROM normal WHERE level = 0 AND body <> '' GROUP BY ALL),
found AS (SELECT n.conv_id, n.turn, origin, count(*) AS n, count(*) FILTER (level = 1) AS first
  FROM normal n JOIN origin o ON n.conv_id IS NOT DISTINCT FROM o.conv_id AND n.body = o.body WHERE n.level > 0 AND origin < n.turn GROUP BY ALL),
best AS (SELECT conv_id, turn, sum(n) AS n_linked, max_by(origin, first * 1000000000 + origin) FILTER (first > 0) AS quoted_turn FROM found GROUP BY ALL),
turns AS (SELECT conv_id, turn, lag(turn) OVER w AS before, row_number() OVER w - 1 AS place FROM (SELECT DISTINCT conv_id, turn FROM parsed) WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST)),
nodes AS (SELECT u.*, coalesce(b.quoted_turn, u.before) AS parent FROM turns u LEFT JOIN best b ON u.conv_id IS NOT DISTINCT FROM b.conv_id AND u.turn IS NOT DISTINCT FROM b.turn),
threads AS (SELECT *, max(CASE WHEN before IS NULL OR parent <> before THEN turn END) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS thread_turn FROM nodes),
tree AS (SELECT conv_id, turn, 0::BIGINT AS reply_depth FROM nodes WHERE parent IS NULL UNION ALL SELECT n.conv_id, n.turn, t.reply_depth + 1 FROM nodes n JOIN tree t ON n.conv_id IS NOT DISTINCT FROM t.conv_id AND n.parent = t.turn),
texts AS (SELECT row, coalesce(string_agg(body, chr(10) ORDER BY place) FILTER (level = 0), '') AS text, max(level)::BIGINT AS depth, count(*) FILTER (level > 0) AS n_quoted FROM line GROUP BY row)
SELECT p.conv_id, p.turn, p.role, t.text, t.depth, t.n_quoted, coalesce(b.n_linked, 0)::BIGINT AS n_linked, u.parent AS parent_turn, u.thread_turn, d.reply_depth, u.place
FROM parsed p JOIN texts t USING (row) JOIN threads u ON p.conv_id IS NOT DISTINCT FROM u.conv_id AND p.turn IS NOT DISTINCT FROM u.turn
JOIN tree d ON p.conv_id IS NOT DISTINCT FROM d.conv_id AND p.turn IS NOT DISTINCT FROM d.turn
LEFT JOIN best b ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND p.turn IS NOT DISTINCT FROM b.turn
"""
