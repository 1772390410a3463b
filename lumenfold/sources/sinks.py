"""What leaves the engine: feeds as JSON, calendars, day lists as text and appended logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumenfold.functions import dates
from lumenfold.functions.text import text


def feed(events: DataFrame, by: str = "profile") -> DataFrame:
    """(by, events) with a profile's events as one JSON array each row of which is an event, ordered by final rank."""
    names = [c for c in events.columns if c != by]
    rows = events.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("final_rank", F.struct(*names).alias("e")))).alias("r"))
    return rows.select(by, F.to_json(F.transform("r", lambda x: x["e"])).alias("events"))


def escaped(c: str | Column) -> Column:
    """Text as an iCalendar value."""
    s = F.replace(text(c), F.lit("\\"), F.lit("\\\\"))
    for a, b in ((";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def fold_line(line: str, most: int = 75) -> str:
    """A line in pieces of at most ``most`` octets, none of which cuts a letter, joined by a break and a space."""
    out, now, size = [], "", 0
    for ch in line:
        n = len(ch.encode())
        if size + n > most:
            out.append(now)
            now, size = " ", 1
        now += ch
        size += n
    return "\r\n".join([*out, now])


@F.pandas_udf(StringType())
def folded_line(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: fold_line(x) if x is not None else None)


def calendar_entries(events: DataFrame, stamp: str, zone: str = dates.ZONE) -> DataFrame:
    """(key, day, entry): a VEVENT text for each event (key, day, title, venue, start, url); no hour makes it an all-day one.

    An end before the start lies on the next day; without an end an event lasts three hours.
    """
    r = dates.start_range("start")
    begin, end = r["start"], F.when(r["end"].isNull(), r["start"] + 180).when(r["end"] <= r["start"], r["end"] + 1440).otherwise(r["end"])
    at = lambda minutes: F.date_format(F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), minutes), "yyyyMMdd'T'HHmmss")
    timed = F.concat(F.lit(f"DTSTART;TZID={zone}:"), at(begin), F.lit(f"\r\nDTEND;TZID={zone}:"), at(end))
    whole = F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("day", "yyyyMMdd"))
    lines = F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("key")), F.lit(f"DTSTAMP:{stamp}"), F.when(begin.isNotNull(), timed).otherwise(whole), folded_line(F.concat(F.lit("SUMMARY:"), escaped("title"))),
        F.when(text("venue") != "", folded_line(F.concat(F.lit("LOCATION:"), escaped("venue")))), F.when(text("url") != "", folded_line(F.concat(F.lit("URL:"), text("url")))), F.lit("END:VEVENT"),
    )
    return events.select("key", "day", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\r\n").alias("entry"))


def calendar(entries: DataFrame, by: str, name: str) -> DataFrame:
    """(by, ics) of entries: one calendar text for each group, in order of day."""
    listed = entries.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("day", "key", "entry"))).alias("e"))
    head, tail = f"BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//lumenfold//EN\r\nX-WR-CALNAME:{name}\r\n", "\r\nEND:VCALENDAR\r\n"
    return listed.select(by, F.concat(F.lit(head), F.array_join(F.transform("e", lambda x: x["entry"]), "\r\n"), F.lit(tail)).alias("ics"))


def event_line(events: DataFrame) -> Column:
    """One line of a day list: stars, title, place, time and price."""
    has = set(events.columns)
    bits = F.concat_ws(" · ", F.nullif(text("venue"), F.lit("")), dates.time_label("start") if "start" in has else F.lit(None), F.nullif(text("price"), F.lit("")) if "price" in has else F.lit(None))
    return F.concat(F.lit("- "), F.repeat(F.lit("★"), F.col("rating")), F.lit(" **"), text("title"), F.lit("** "), bits)


def day_lists(events: DataFrame) -> DataFrame:
    """(day, md): each day's picks (day, place, line) under a heading."""
    by = events.withColumn("line", event_line(events)).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
    return by.select("day", F.concat(F.lit("## "), dates.day_label("day"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("md"))


def collapsed_runs(events: DataFrame, by: str = "series") -> DataFrame:
    """A row for each run: its best night, with all days and venues in order."""
    order = F.struct("rank_score", "key")
    g = events.groupBy(F.coalesce(by, "key").alias("run")).agg(F.max_by("key", order).alias("key"), F.array_sort(F.collect_set("day")).alias("days"), F.array_sort(F.collect_list(F.struct("day", "venue"))).alias("v"))
    return g.select("key", "days", F.array_distinct(F.transform("v", lambda x: x["venue"])).alias("venues"))


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a JSON log."""
    rows.write.mode("append").json(path)


def freshness_line(added: int, updated: int, stale: list[tuple[str, int]]) -> str:
    """What a digest says of its catalogue: new and changed rows, and sources that have gone quiet."""
    quiet = ", ".join(f"{name} {days}d" for name, days in stale)
    return f"{added} new, {updated} updated" + (f"; quiet: {quiet}" if quiet else "")


def with_freshness(md: str, line: str) -> str:
    """A document with its freshness line replaced, or put under the heading."""
    mark = "_Fresh: "
    rows = md.split("\n")
    for i, row in enumerate(rows):
        if row.startswith(mark):
            return "\n".join([*rows[:i], f"{mark}{line}_", *rows[i + 1 :]])
    return "\n".join([*rows[:1], f"{mark}{line}_", *rows[1:]])
