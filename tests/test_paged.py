import json
import random
from datetime import UTC, date, datetime

from pyspark.sql import functions as F

from lumenfold.sources import paged

START = int(datetime(2024, 1, 1, tzinfo=UTC).timestamp())


def service(rows, cap, size, broken=()):
    """Answers like a service that refuses pages past its cap."""

    def read(kind, since, until, page):
        if (kind, page) in broken or page * size >= cap:
            raise OSError("refused")
        found = sorted((r for r in rows if r["kind"] == kind and since <= r["at"] < until), key=lambda r: (r["at"], r["id"]))
        return json.dumps({"page": {"totalElements": len(found)}, "list": {"events": found[page * size : (page + 1) * size]}})

    return read


def crawled(spark, rows, cap, size, kinds, **more):
    first = paged.first_windows(spark, kinds, date(2024, 1, 1), 50, 30)
    return paged.crawl(first, paged.fetching(service(rows, cap, size, **more), ("page", "totalElements"), size, cap), cap)


SCHEMA = "id string, at long, kind string, name string"


def test_nothing_is_lost_at_the_cap(spark):
    r = random.Random(5)
    rows = [{"id": f"a{i}", "at": START + r.choice([0, 7, r.randrange(50 * 86400), 86400 * 29 + r.randrange(900)]), "kind": r.choice("xy"), "name": f"n{i}"} for i in range(900)]
    rows += [{"id": f"z{i}", "at": START + 50 * 86400, "kind": "x", "name": "outside"} for i in range(3)] + [{"id": None, "at": START + 9, "kind": "x", "name": "no id"}]
    for row in rows:
        if row["at"] in (START, START + 7) and r.random() < 0.8:
            row["at"] += r.randrange(20, 4000)
    pages = crawled(spark, rows, 60, 20, ["x", "y"])
    assert paged.gaps(pages, "$.list.events", 60).count() == 0
    got = paged.latest(paged.records(pages, "$.list.events", SCHEMA, 60))
    want = [row for row in rows if row["id"] and row["at"] < START + 50 * 86400]
    assert sorted((g.id, g.at, g.kind, g.name) for g in got.collect()) == sorted((w["id"], w["at"], w["kind"], w["name"]) for w in want)
    assert [g.id for g in got.orderBy("first_ord").collect()] == [w["id"] for w in sorted(want, key=lambda w: (w["kind"], w["at"], w["id"]))]
    assert pages.select(F.max("depth")).first()[0] > 3  # some windows were halved


def test_the_last_reading_counts(spark):
    rows = [{"id": "a", "at": START + 5, "kind": "x", "name": "old"}, {"id": "b", "at": START + 6, "kind": "x", "name": "b"}, {"id": "a", "at": START + 9, "kind": "x", "name": "new"}]
    got = paged.latest(paged.records(crawled(spark, rows, 60, 2, ["x"]), "$.list.events", SCHEMA, 60)).orderBy("first_ord").collect()
    assert [(g.id, g.name) for g in got] == [("a", "new"), ("b", "b")]


def test_what_a_service_refuses_is_told(spark):
    rows = [{"id": f"{i}", "at": START + 4, "kind": "x", "name": ""} for i in range(50)] + [{"id": f"y{i}", "at": START, "kind": "y", "name": ""} for i in range(5)]
    pages = crawled(spark, rows, 40, 20, ["x", "y", "w"], broken=(("y", 0),))
    got = sorted((g.kind, g.since - START, g.total, g.n) for g in paged.gaps(pages, "$.list.events", 40).where("kind = 'x'").collect())
    assert got == [("x", 4, 50, 40)]
    assert [(g.total, g.n) for g in paged.gaps(pages, "$.list.events", 40).where("kind = 'y'").collect()] == [(None, 0), (None, 0)]
    assert paged.gaps(pages, "$.list.events", 40).where("kind = 'w'").count() == 0
    assert paged.records(pages, "$.list.events", SCHEMA, 40).count() == 40


def test_halves_share_no_second(spark):
    w = paged.first_windows(spark, ["x"], date(2024, 1, 1), 1, 1).withColumn("span", F.lit(7).cast("long"))
    for _ in range(4):
        w = paged.halves(w)
        b = paged.bounds(w).where("since < until").orderBy("since").collect()
        assert b[0].since == START and b[-1].until == START + 7 and all(p.until == q.since for p, q in zip(b, b[1:]))
        t = spark.range(7).withColumn("s", F.lit(START) + F.col("id")).crossJoin(w).where(paged.number_at(F.col("s"), F.col("origin"), F.col("span"), F.col("depth")) == F.col("number"))
        assert all(r.since <= r.s < r.until for r in paged.bounds(t).collect()) and t.count() == 7


def test_no_records(spark):
    pages = crawled(spark, [], 60, 20, ["x"])
    assert pages.count() == 2 and paged.records(pages, "$.list.events", SCHEMA, 60).count() == 0 and paged.gaps(pages, "$.list.events", 60).count() == 0
