"""Joins with gazetteers against the column forms, and a plan that doesn't grow with the names."""

import random

from pyspark.sql import functions as F

from lumenfold.config import Taste
from lumenfold.operators import gazetteer, places, score, tags

R = random.Random(11)
WORDS = ["blue", "room", "the", "mill", "house", "pier", "é", "café", "o'neil", "club 9", "hall", "bowl", "a", "yard", "old town", "vs", "(live)"]


def phrase(most=4):
    return " ".join(R.choice(WORDS) for _ in range(R.randrange(1, most)))


def venues(spark, n=150):
    rows = [(i, R.choice([None, "", phrase().title(), f"The {phrase()}"]), R.choice([["pool"], ["amphitheater"], []])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, venue string, setting array<string>")


def test_scale(spark):
    names = {phrase(3).lower(): R.choice(["bar", "hall", "arena", "room"]) for _ in range(40)}
    casinos = tuple(R.sample(sorted(names), 15))
    g = tags.Gazetteer(scale=names, casinos=casinos)
    events = venues(spark)
    want = events.select("id", tags.scale_of(F.lower(F.coalesce("venue", F.lit(""))), F.col("setting"), g).alias("scale"))
    table = spark.createDataFrame([(n, i, t, n in casinos) for i, (n, t) in enumerate(names.items())], "name string, turn int, tier string, casino boolean")
    got = gazetteer.with_scale(events, table)
    assert got.columns == [*events.columns, "scale"]
    assert sorted(got.select("id", "scale").collect(), key=str) == sorted(want.collect(), key=str)


def test_venue_places(spark):
    known = {places_key: R.choice(["north", "south"]) for places_key in (phrase(3) for _ in range(30)) if places_key == places_key.strip()}
    known = {k: v for k, v in known.items() if "'" not in k and "(" not in k and not k.startswith("the ")}
    m = places.Map(venues=known)
    events = venues(spark)
    want = events.select("id", places.venue_place("venue", m).alias("venue_place"))
    table = spark.createDataFrame([(n, i, p) for i, (n, p) in enumerate(known.items())], "name string, turn int, place string")
    assert sorted(gazetteer.with_venue_place(events, table).select("id", "venue_place").collect(), key=str) == sorted(want.collect(), key=str)


def test_tracked_and_loved(spark):
    rows = [(i, R.choice([None, phrase(5)]), R.choice([None, [], [phrase(3), f"{phrase(2)} b2b {phrase(2)}"], [f"{phrase(3)} (UK)"]])) for i in range(120)]
    events = spark.createDataFrame(rows, "id long, title string, lineup array<string>")
    named = sorted({phrase(3).title() for _ in range(25)} | {"É", "Ab"})
    vague = tuple(named[::3])
    want = events.select("id", score.tracked_hits("title", "lineup", Taste(tracked=tuple(named), ambiguous=vague)).alias("hits")).where("size(hits) > 0")
    table = spark.createDataFrame([(n, n in vague) for n in named], "name string, ambiguous boolean")
    assert sorted(gazetteer.tracked(events, table, "id").collect(), key=str) == sorted(want.collect(), key=str)
    places_ = venues(spark)
    want = places_.select("id", score.venue_loved("venue", tuple(named)).alias("venue_loved"))
    assert sorted(gazetteer.loved(places_, table).select("id", "venue_loved").collect(), key=str) == sorted(want.collect(), key=str)


def test_a_hundred_thousand_names(spark):
    names = spark.range(100_000).selectExpr("concat('room ', lpad(conv(id, 10, 36), 4, '0')) as name", "cast(id as int) as turn", "id as place").union(spark.sql("select 'room', -1, -1L"))
    texts = spark.range(3000).selectExpr("concat('at room ', lpad(conv(id * 41, 10, 36), 4, '0'), ' tonight') as text").union(spark.createDataFrame([("a roomy place",), ("nowhere",)], "text string"))
    got = {r.text: r.place for r in gazetteer.longest(texts, names).collect()}
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def code(n):
        out = ""
        for _ in range(4):
            n, d = divmod(n, 36)
            out = digits[d] + out
        return out

    assert got == {f"at room {code(i * 41)} tonight": i * 41 if i * 41 < 100_000 else -1 for i in range(3000)} | {"a roomy place": -1}
    size = lambda n: len(gazetteer.longest(texts, n)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(names) - size(names.limit(10))) < 400


def test_ranks_of_nulls_and_one_prefix(spark):
    rows = [(f"aa{i:03}" if i % 9 else None, i % 4 if i % 7 else None) for i in range(200)]
    got = score.global_rank(spark.createDataFrame(rows, "key string, s int"), "s", "key").collect()
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is None, [-ord(c) for c in r[0] or ""]))
    assert len(got) == 200 and [(r.key, r.s) for r in sorted(got, key=lambda r: r.final_rank)] == order
