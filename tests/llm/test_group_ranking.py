"""Operator 11 against its SQL, on made cases and with small salts, passes and heavy groups."""

import datetime
import random

import duckdb
import pytest

from lumenfold.llm import group_ranking as g

SCHEMA = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"
KINDS = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}


def told(rows):
    c = duckdb.connect()
    c.sql("create table sale_lines (" + ", ".join(f"{x.split()[0]} {KINDS[x.split()[1]]}" for x in SCHEMA.split(", ")) + ")")
    if rows:
        c.executemany("insert into sale_lines values (?, ?, ?, ?, ?, ?, ?, ?, ?)", rows)
    q = c.sql(g.SQL)
    return q.columns, sorted(q.fetchall(), key=str)


def lines(n, seed, vendors=4, pairs=60):
    r = random.Random(seed)
    some = lambda x: None if r.random() < 0.08 else x
    out = [
        (some(r.randrange(40)), some(r.randrange(4)), some(r.randrange(6)), some(r.randrange(vendors)), some(r.randrange(-20, pairs)), some(r.choice([1.25, 2.005, float("nan"), -3.5])),
         some(r.choice([0.0, 0.05, 0.015, 1.0, -0.2, float("inf")])), "kept", some(datetime.datetime(2024, r.randrange(1, 6), 3)))
        for _ in range(n)
    ]
    return out + out[: n // 3] + [out[0]] * (n // 3)  # repeated rows, one of them very often


@pytest.mark.parametrize("n,halvings,heavy", [(0, 3, 1024), (1, 3, 1024), (300, 1, 4), (300, 2, 1024), (600, 3, 20)])
def test_equals_sql(spark, monkeypatch, n, halvings, heavy):
    monkeypatch.setattr(g, "HALVINGS", halvings)
    monkeypatch.setattr(g, "HEAVY", heavy)
    monkeypatch.setattr(g, "SALTS", 3)
    rows = lines(n, n + halvings) if n else []
    got = g.ranked_lines(spark.createDataFrame(rows, SCHEMA))
    columns, wanted = told(rows)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == wanted


def test_wide_pairs_and_clashing_columns(spark):
    """Pairs too wide for a long are decimals; a column of another name that the operator uses inside is no matter."""
    r = random.Random(4)
    rows = [(r.randrange(3), r.randrange(-(2**28), 2**28), r.choice([None, -(2**62), 2**62, 5]), i % 7, "x") for i in range(200)]
    frame = spark.createDataFrame(rows, "k long, a long, b long, i long, pos string")
    got = g.first_places(g.encoded(frame, [("a", True), ("b", False)]), ["k"], ["i"], places=7)
    assert got.schema["code"].dataType.simpleString() == "decimal(38,0)"
    wanted = []
    for k in range(3):
        own = sorted([x for x in rows if x[0] == k], key=lambda x: (-x[1], x[2] is None, x[2] or 0, x[3]))
        pairs = list(dict.fromkeys(x[1:3] for x in own))
        wanted += [(k, x[3], pos, pairs.index(x[1:3]) + 1, sum(y[1:3] == x[1:3] for y in own)) for pos, x in enumerate(own, 1) if pairs.index(x[1:3]) < 7]
    assert sorted(tuple(x) for x in got.select("k", "i", "pos", "place", "tied").collect()) == sorted(wanted)


def test_ranges_too_wide(spark):
    frame = spark.createDataFrame([(1, 2**63 - 1, 2**63 - 1), (1, -(2**63), -(2**63))], "k long, a long, b long")
    with pytest.raises(ValueError):
        g.encoded(frame, [("a", True), ("b", False)])
