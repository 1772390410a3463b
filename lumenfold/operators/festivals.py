"""The watch-list of festivals, and one row for each festival of a catalogue."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import collapsed, festival_core, normalized, text
from lumenfold.operators.dedupe import first_of

_DAY = r"\d{4}-\d{2}-\d{2}"


def scope(location: str | Column, explicit: str | Column, local: tuple[str, ...]) -> Column:
    """"local" or "travel": what is said, else by whether the location names a local place."""
    near = F.lower(text(location)).rlike("|".join(local)) if local else F.lit(False)
    return F.when(text(explicit) != "", F.lower(F.trim(text(explicit)))).when(near, "local").otherwise("travel")


def last_day(when: str | Column) -> Column:
    """The last day of a text such as "2026-06-19..21" or several dates; null without one."""
    w = text(when)
    whole = F.transform(F.regexp_extract_all(w, F.lit(f"({_DAY})"), F.lit(1)), lambda x: x.try_cast("date"))
    ends = F.transform(F.regexp_extract_all(w, F.lit(rf"({_DAY}\.\.\d{{2}})\b"), F.lit(1)), lambda x: F.concat(F.substring(x, 1, 8), F.substring(x, 13, 2)).try_cast("date"))
    return F.array_max(F.concat(whole, ends))


def first_day(when: str | Column) -> Column:
    return F.array_min(F.transform(F.regexp_extract_all(text(when), F.lit(f"({_DAY})"), F.lit(1)), lambda x: x.try_cast("date")))


def pretty(when: str | Column) -> Column:
    """"Jun 19–21" or "Jun 30–Jul 2" for dates, other texts as they are."""
    a, b = first_day(when), last_day(when)
    tail = F.when(a == b, "").when(F.month(a) == F.month(b), F.concat(F.lit("–"), F.dayofmonth(b).cast("string"))).otherwise(F.concat(F.lit("–"), F.date_format(b, "MMM d")))
    return F.when(a.isNotNull(), F.concat(F.date_format(a, "MMM d"), tail)).otherwise(text(when))


def watch_list(rows: DataFrame, today: date, local: tuple[str, ...]) -> DataFrame:
    """Festivals (name, location, when, status, scope) that aren't over, with last_day, scope and pretty dates; undated ones stay."""
    out = rows.withColumns({"last_day": last_day("when"), "scope": scope("location", "scope", local), "shown": pretty("when")})
    return out.where(F.col("last_day").isNull() | (F.col("last_day") >= F.lit(today)))


def timely(rows: DataFrame) -> DataFrame:
    """Those on sale or announced."""
    return rows.where(F.lower(text("status")).isin("on_sale", "on sale", "announced"))


def rollup_key(title: str | Column) -> Column:
    """What the nights of one festival share: the festival-like head before a colon, without edition words, weekdays and numbers."""
    t = text(title)
    head = F.get(F.split(t, ":", 2), F.lit(0))
    named = t.contains(":") & normalized(head).rlike(r"\b(festival|fest|weekender|block party)\b")
    core = F.regexp_replace(festival_core(F.when(named, head).otherwise(t)), r"^the\s+", "")
    core = collapsed(F.regexp_replace(core, r"\b(?:mon|tues?|wednes|thurs?|fri|satur|sun)day\b|\b\d+\b", " "))
    return F.when(core != "", core).otherwise(normalized(t))


def season(events: DataFrame) -> DataFrame:
    """The earliest night of each festival among events (title, day, final_rank, vibe)."""
    fest = events.where(F.array_contains("vibe", "festival")).withColumn("festival", rollup_key("title"))
    return first_of(fest, ["festival"], F.asc("day"), F.asc("final_rank"))
