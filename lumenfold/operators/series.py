"""Programmes of several nights: runs at one venue, films at any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import film_core, normalized, text
from lumenfold.operators.score import global_rank


def series_key(title: str, venue: str, film: Column) -> Column:
    """The programme that a listing is one night of; null without a title."""
    key = F.when(film, F.concat(F.lit("film:"), film_core(title))).otherwise(F.concat(F.lit("run:"), normalized(title), F.lit("|"), normalized(venue)))
    return F.when(F.trim(text(title)) != "", key)


def groups(events: DataFrame) -> DataFrame:
    """(series, n, first, last, venues, nights) of programmes with two listings or more; events: series, day, venue, start, id."""
    by = events.where("series is not null").groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.min("day").alias("first"), F.max("day").alias("last"),
        F.array_sort(F.collect_list(F.struct("day", "id", "start", "venue"))).alias("nights"),
    )
    venues = F.array_distinct(F.filter(F.transform("nights", lambda x: x["venue"]), lambda v: v.isNotNull()))
    return by.where("n >= 2").withColumn("venues", venues)


def representatives(events: DataFrame) -> DataFrame:
    """``events`` with ``final_rank``: the best night of a programme is ranked, its others inherit; events: series, rank_score, key.

    Of equal scores the larger key leads, as everywhere in this ranking.
    """
    unit = F.coalesce("series", "key")
    best = events.groupBy(unit.alias("unit")).agg(F.max(F.struct("rank_score", "key")).alias("best"))
    ranked = global_rank(best.select("unit", "best.rank_score", F.col("best.key").alias("rep_key")), "rank_score", "rep_key")
    return events.withColumn("unit", unit).join(ranked.select("unit", "final_rank", "rep_key"), "unit").withColumn("series_rep", F.col("key") == F.col("rep_key")).drop("unit", "rep_key")


def night_of_n(events: DataFrame) -> DataFrame:
    """``events`` with ``night`` and ``nights`` within the programme, by day and id."""
    here = Window.partitionBy("series")
    return events.where("series is not null").withColumns({"night": F.row_number().over(here.orderBy("day", "id")), "nights": F.count(F.lit(1)).over(here)})


def standing(first: Column, last: Column, n: Column, least_days: int = 14, least_nights: int = 3) -> Column:
    """Whether a programme goes on at about a weekly pace or denser."""
    span = F.datediff(last, first)
    return (span >= least_days) & (n >= least_nights) & (n >= span / 7)
