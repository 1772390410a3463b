"""Sections of a digest, as rows: what is on tonight, what changed, films, weekends ahead, and the city's pulse.

Candidates: key, day, title, venue, category, rating, score, series, link, ord (their order), added, changed_fields.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import dates
from lumenfold.functions.text import text
from lumenfold.operators.dedupe import first_of
from lumenfold.operators.select import top_in

# The stars that a verdict stands for.
TIER_RATING = {"must-see": 5, "great": 4, "solid": 3, "skip": 1}


def judged(slate: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A slate (key, rating, score) as it is shown: stars by the verdict's tier, its adjustment within the score; verdicts: key, tier, adjust."""
    v = verdicts.select(F.col("key").alias("_key"), F.col("tier").alias("_tier"), F.col("adjust").alias("_adjust"))
    stars = F.try_element_at(F.create_map(*[F.lit(x) for kv in TIER_RATING.items() for x in kv]), F.col("_tier"))
    both = slate.join(v, F.col("key") == F.col("_key"), "left")
    return both.withColumns({"rating": F.coalesce(stars, F.col("rating")), "score": F.coalesce("score", F.lit(0)) + F.coalesce("_adjust", F.lit(0)), "judged": F.col("_key").isNotNull()}).drop("_key", "_tier", "_adjust")


def program() -> Column:
    """What a row is a night of; a row without a programme is one of its own."""
    return F.coalesce("series", F.concat(F.lit("solo:"), F.col("key")))


def collapsed(cands: DataFrame) -> DataFrame:
    """A row for each programme: its best night by score (of equals the first), with ``days``, ``earliest``, ``venues`` in order of their
    first night and ``links``, a venue's link at that night."""
    order = F.struct(F.coalesce("score", F.lit(0)).alias("s"), -F.col("ord"))
    nights = F.sort_array(F.collect_list(F.when(text("venue") != "", F.struct("day", "ord", "venue", "link"))))
    by = cands.groupBy(program().alias("program")).agg(F.max_by(F.struct(*cands.columns), order).alias("r"), F.array_sort(F.collect_set("day")).alias("days"), nights.alias("_n"))
    venues = F.array_distinct(F.transform("_n", lambda x: x["venue"]))
    links = F.transform(venues, lambda v: F.get(F.filter(F.col("_n"), lambda x: x["venue"] == v), F.lit(0))["link"])
    return by.select("program", "r.*", "days", F.coalesce(F.get("days", F.lit(0)), F.col("r.day")).alias("earliest"), venues.alias("venues"), links.alias("links"))


def tonight(cands: DataFrame, today: date, most: int = 3) -> DataFrame:
    """(day, place, ...) the best of today and of tomorrow; a programme of both nights stands once, as listed first."""
    near = cands.where(F.col("day").isin(today, today + timedelta(days=1)))
    once = first_of(near.withColumn("_p", program()), ["_p"], F.asc("ord")).drop("_p")
    order = Window.partitionBy("day").orderBy(F.desc(F.coalesce("rating", F.lit(0))), F.desc(F.coalesce("score", F.lit(0))), F.asc("ord"))
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def changed(cands: DataFrame, most: int = 8) -> DataFrame:
    """(kind, place, n, ...) programmes that are new, and others that moved, the first ``most`` by day and score, with how many there are."""
    moved = cands.where(~F.coalesce("added", F.lit(False)) & (F.size(F.coalesce("changed_fields", F.array().cast("array<string>"))) > 0))
    both = collapsed(cands.where("added")).withColumn("kind", F.lit("new")).unionByName(collapsed(moved).withColumn("kind", F.lit("updated")))
    order = Window.partitionBy("kind").orderBy(F.asc_nulls_last("day"), F.desc(F.coalesce("score", F.lit(0))), F.asc("ord"))
    counts = both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).join(counts, "kind")


def marquee(cands: DataFrame, today: date, openings: int = 8, singles: int = 8, least: int = 4) -> DataFrame:
    """(kind, place, ...) of films: runs that open ahead, or today if they are new, and single nights of the next two weeks worth ``least`` stars."""
    rows = collapsed(cands)
    ahead = (F.col("earliest") > F.lit(today)) | ((F.col("earliest") == F.lit(today)) & F.coalesce("added", F.lit(False)))
    one = F.col("earliest").between(F.lit(today), F.date_add(F.lit(today), 14)) & (F.coalesce("rating", F.lit(0)) >= least)
    kind = F.when((F.size("days") > 1) & ahead, "opening").when((F.size("days") == 1) & one, "single")
    placed = rows.withColumn("kind", kind).where("kind is not null").withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("earliest", "ord")))
    return placed.where(F.col("place") <= F.when(F.col("kind") == "opening", openings).otherwise(singles))


def weekends(cands: DataFrame, most: int = 4) -> DataFrame:
    """(weekend, place, more, ...) the best programmes of each weekend, by its Friday, and how many more there are."""
    rows = collapsed(cands).where("earliest is not null").withColumn("weekend", dates.weekend_anchor("earliest"))
    counts = rows.groupBy("weekend").agg(F.greatest(F.lit(0), F.count(F.lit(1)) - most).alias("more"))
    best = [F.desc(F.coalesce("rating", F.lit(0))), F.desc(F.coalesce("score", F.lit(0))), F.asc("earliest"), F.asc("ord")]
    placed = top_in(rows, most, ["weekend"], *best).withColumn("place", F.row_number().over(Window.partitionBy("weekend").orderBy(*best)))
    return placed.join(counts, "weekend")


def around(rows: DataFrame, slate: DataFrame, most: int = 12) -> DataFrame:
    """What happens in town (key, category, day, ord) that the slate hasn't, films aside: the first ``most`` in order, shown by day."""
    free = rows.where(F.lower(text("category")) != "film").join(slate.select("key").distinct(), "key", "left_anti")
    return free.orderBy("ord").limit(most).orderBy("day", "ord")


def radar_months(rows: DataFrame, most: int = 12) -> DataFrame:
    """(month, place, ...) of what lies far ahead (key, day, rank), the best of each month."""
    best = [F.desc("rank"), F.asc("day"), F.asc("key")]
    month = rows.withColumn("month", F.date_format("day", "yyyy-MM"))
    return top_in(month, most, ["month"], *best).withColumn("place", F.row_number().over(Window.partitionBy("month").orderBy(*best)))
