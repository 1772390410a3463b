"""Keeping a catalogue honest: expiry, markets, ghosts and sources gone quiet."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import has_any, text


def expire_past(events: DataFrame, today: date, day: str = "day") -> DataFrame:
    """Rows from today on, and those without a day."""
    return events.where(F.col(day).isNull() | (F.col(day) >= F.lit(today)))


def in_window(events: DataFrame, today: date, days: int | None, day: str = "day", status: str = "status") -> DataFrame:
    """Dated rows from today to today + days, both included, that aren't unlisted."""
    kept = events.where(F.col(day) >= F.lit(today)).where(F.coalesce(F.col(status), F.lit("")) != "unlisted")
    return kept if days is None else kept.where(F.col(day) <= F.date_add(F.lit(today), days))


def worth_a_trip(title: str, venue: str, billed: Column, arenas: tuple[str, ...]) -> Column:
    """A festival by title, an arena, or a tracked name on the bill."""
    return F.lower(text(title)).rlike(r"\bfestival\b|\bfest\b") | has_any(F.lower(text(venue)), arenas) | F.coalesce(billed, F.lit(False))


def drop_out_of_market(events: DataFrame, places: tuple[str, ...], keep: Column, place: str = "neighborhood") -> DataFrame:
    """Rows outside ``places``, and those inside that ``keep`` speaks for. No places: all rows."""
    if not places:
        return events
    far = F.lower(F.trim(text(place))).isin([p.lower().strip() for p in places])
    return events.where(~far | keep)


def flag_ghosts(events: DataFrame, fetched: DataFrame, today: date, horizon: int, grace: int = 2) -> DataFrame:
    """``events`` with ``status`` "unlisted" where all sources were fetched but none showed the row for ``grace`` days.

    fetched: (source), one row for each source read in this run; it is a handful of names and collected into an array.
    A row that was seen again loses the flag; rows that can't be judged keep what they have.
    """
    names = fetched.agg(F.collect_set("source").alias("fetched"))
    judged = events.crossJoin(F.broadcast(names))  # one row
    open_day = F.col("day").between(F.lit(today), F.date_add(F.lit(today), horizon))
    known = (F.size("sources") > 0) & (F.size(F.array_except("sources", "fetched")) == 0) & F.col("last_seen").isNotNull() & open_day
    late = F.datediff(F.lit(today), F.col("last_seen")) >= grace
    new = F.when(F.coalesce(known, F.lit(False)) & late, F.lit("unlisted")).when(F.coalesce(known, F.lit(False)) & (F.col("status") == "unlisted"), F.lit(None)).otherwise(F.col("status"))
    return judged.withColumn("status", new).drop("fetched")


def source_freshness(events: DataFrame, today: date) -> DataFrame:
    """(source, n, newest, median_seen, days, newest_days): by source, how long ago it was seen; the median is the lower one."""
    seen = events.where("last_seen is not null").select(F.explode("sources").alias("source"), "last_seen")
    by_source = seen.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.max("last_seen").alias("newest"),
        F.expr("percentile_disc(0.5) within group (order by unix_date(last_seen))").cast("int").alias("middle"),
    )
    median = F.expr("date_from_unix_date(middle)")
    return by_source.select("source", "n", "newest", median.alias("median_seen"), F.datediff(F.lit(today), median).alias("days"), F.datediff(F.lit(today), "newest").alias("newest_days"))


def stale_sources(freshness: DataFrame, days: int = 3, least: int = 20) -> DataFrame:
    """Sources of ``least`` rows or more whose bulk wasn't seen for ``days``, the stalest first."""
    return freshness.where((F.col("days") >= days) & (F.col("n") >= least)).orderBy(F.desc("days"), "source")
