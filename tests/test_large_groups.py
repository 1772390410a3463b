"""Groups that large tables make: work must grow with the rows, not with their pairs."""

import time
from datetime import date

from pyspark.sql import functions as F

from lumenfold.config import Taste
from lumenfold.operators import affinity, matching


def test_offers_of_a_crowded_day(spark):
    """Twenty thousand events and offers of one day, venue and name, which were 400 million pairs, and offers that only a name or a venue ties."""
    d, n = date(2026, 6, 20), 20_000
    names = F.element_at(F.array(*map(F.lit, ("Ann Tour", "Ann", "Tour Ann Ann", "Zed"))), (F.col("id") % 4 + 1).cast("int"))
    events = spark.range(n).select(F.col("id").alias("key"), F.lit(d).alias("day"), F.when(F.col("id") % 3 == 0, "Pier").otherwise("Blue Hall").alias("venue"), names.alias("name"))
    offers = spark.range(n).select((F.col("id") + 1).alias("offer"), F.lit(d).alias("day"), F.lit("The Blue Hall").alias("venue"), F.when(F.col("id") % 2 == 0, "Bob").otherwise("Tour, Ann").alias("name"), (n - F.col("id")).alias("ord"))
    began = time.perf_counter()
    got = {r.key: (r.offer, r.rank) for r in matching.best_offers(events, offers).collect()}
    assert time.perf_counter() - began < 60

    def best(k):
        rank = 2 * (k % 3 != 0) + (k % 4 in (0, 2))
        return (n, rank) if rank else None  # the last row has the least ord, at the venue and of the name

    assert got == {k: best(k) for k in range(n) if best(k)}


def test_points_of_a_bill_that_many_events_share(spark):
    """A name is tested once for each bill, not for each event: the pattern's test stands below any number of events."""
    events = spark.createDataFrame([(1, "Night", ["Ann"]), (2, "Night", ["Ann"]), (3, "Ann live", None), (4, None, ["Bo", "Ann"]), (5, "", ["Cy"]), (6, None, None)], "id long, title string, lineup array<string>")
    artists = spark.createDataFrame([("p", "ann", "Ann", "core", []), ("q", "ann", "Ann", "hidden", []), ("p", "bo", "Bo", "light", [])], "profile string, artist string, name string, tier string, sources array<string>")
    plain = affinity.artist_points(affinity.billed(events, artists, "id", Taste()), "id", Taste())
    got = affinity.points_of_bills(events, artists, "id", Taste())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) != []

    n = 400_000
    many = spark.range(n).select("id", F.lit("").alias("title"), F.array(F.concat(F.lit("Artist "), (F.col("id") % 2).cast("string"))).alias("lineup"))
    people = spark.range(1000).select(F.col("id").cast("string").alias("profile"), F.lit("artist 1").alias("artist"), F.lit("Artist 1").alias("name"), F.lit("core").alias("tier"), F.array().cast("array<string>").alias("sources"))
    began = time.perf_counter()
    assert affinity.points_of_bills(many, people, "id", Taste()).count() == n // 2 * 1000
    assert time.perf_counter() - began < 60
