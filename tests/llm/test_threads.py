"""Quoted conversations against the SQL and against following replies by hand."""

import random

import duckdb
import pandas as pd

from lumenfold.llm import quotations

DDL = "conv_id long, turn long, role string, text string, place int, thread_turn string"


def rows_of(seed):
    r = random.Random(seed)
    rows = []
    for conv in [*range(8), None]:
        said = []
        for turn in range(r.choice([1, 3, 12, 60])):
            lines = [f"Line {conv} {turn} {k}" for k in range(r.randrange(0, 3))] + r.choice([[], ["", "same in all"]])
            for _ in range(r.choice([0, 0, 1, 2])):
                if said:
                    quoted = r.choice(said[-6:] if r.random() < 0.7 else said)
                    lines.insert(r.randrange(len(lines) + 1), r.choice([">", "> ", " > >", ">>"]) + quoted.upper())
            said += [x for x in lines if x]
            rows.append((conv, turn * r.choice([1, 1, 40]) if turn else 0, "user", "\n".join(lines), 1, "x"))
    return [*rows, (3, None, "user", "> line 3 0 0", 1, ""), (20, 5, None, None, 1, ""), (20, 9, None, ">" * 50 + " deep", 1, ""), (20, 9, None, "long " * 90_000, 1, "")]


def text(rows):
    return sorted(tuple("N" if v is None or v != v else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_against_sql(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        conversations = pd.DataFrame(rows, columns=[c.split()[0] for c in DDL.split(", ")]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
        got = quotations.linked(spark.createDataFrame(rows, DDL))
        want = duckdb.sql(quotations.SQL)
        assert got.columns == want.columns
        assert text(got.collect()) == text(want.fetchall())


def test_replies_followed_by_hand(spark):
    got = quotations.linked(spark.createDataFrame(rows_of(3), DDL)).collect()
    parent = {(r.conv_id, r.turn): r.parent_turn for r in got}
    places = {}
    for r in got:
        depth, at = 0, r.parent_turn
        while at is not None:
            depth, at = depth + 1, parent[r.conv_id, at]
        assert r.reply_depth == depth
        before = [t for c, t in parent if c == r.conv_id and r.turn is not None and (t is None or t < r.turn)]
        assert r.place == len(before)
        places[r.conv_id, r.turn] = r.place
    assert all(places[c, p] < places[c, t] for (c, t), p in parent.items() if p is not None)
    assert max(r.reply_depth for r in got) > 5 and len({(r.conv_id, r.thread_turn) for r in got}) > 12


def test_no_messages(spark):
    assert quotations.linked(spark.createDataFrame([], DDL)).collect() == []
