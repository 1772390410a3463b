"""Days and hours out of the many forms that listings give them in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.text import col, text

ZONE = "America/Los_Angeles"
_AWARE = r"(?:[Zz]|[+-]\d{2}:?\d{2})$"


def event_day(raw: str | Column, zone: str = ZONE) -> Column:
    """The local day of a text: a time with an offset is moved to ``zone`` first, one without is local already."""
    t = text(raw)
    aware = t.rlike(r"T\d") & t.rlike(_AWARE)
    local = F.from_utc_timestamp(F.to_utc_timestamp(F.try_to_timestamp(t), F.current_timezone()), zone)
    return F.when(aware & F.try_to_timestamp(t).isNotNull(), F.to_date(local)).otherwise(F.substring(t, 1, 10).try_cast("date"))


def start_text(start: str | Column, moment: str | Column) -> Column:
    """The start as given, or HH:MM out of a full time in either field."""
    s, m = text(start), text(moment)
    full = F.when(s.contains("T"), s).when(m.contains("T"), m)
    hour = F.regexp_extract(full, r"T(\d{2}:\d{2})", 1)
    return F.when(((s == "") | s.contains("T")) & (F.coalesce(hour, F.lit("")) != ""), hour).otherwise(F.nullif(s, F.lit("")))


def hours(start: str | Column) -> Column:
    """struct(first, last) of the hours named in a start text, as numbers of a 24-hour clock; last only if there are two."""
    s = text(start)
    twelve = F.transform(F.regexp_extract_all(s, F.lit(r"(?i)(\d{1,2}(?::\d{2})?\s*[ap]m)\b"), F.lit(1)), lambda x: F.lower(x))
    half = F.transform(twelve, lambda x: F.regexp_extract(x, r"^(\d{1,2})", 1).cast("int") % 12 + F.when(x.endswith("pm"), 12).otherwise(0))
    whole = F.filter(F.transform(F.regexp_extract_all(s, F.lit(r"\b(\d{1,2}):\d{2}\b"), F.lit(1)), lambda x: x.cast("int")), lambda h: h < 24)
    found = F.when(F.size(half) > 0, half).otherwise(whole)
    return F.struct(F.get(found, F.lit(0)).alias("first"), F.when(F.size(found) > 1, F.get(found, F.size(found) - 1)).alias("last"))


def clock(part: Column) -> Column:
    """Minutes after midnight of one plain time ("8pm", "19:30"); null for anything else, bare digits too."""
    p = F.lower(F.trim(part))
    twelve, whole = r"^(\d{1,2})(?::(\d{2}))?\s*(am|pm)$", r"^(\d{1,2}):(\d{2})$"
    h, m = F.regexp_extract(p, twelve, 1).try_cast("int"), F.coalesce(F.regexp_extract(p, twelve, 2).try_cast("int"), F.lit(0))
    h24, m24 = F.regexp_extract(p, whole, 1).try_cast("int"), F.regexp_extract(p, whole, 2).try_cast("int")
    of_twelve = F.when(h.between(1, 12) & (m <= 59), (h % 12 + F.when(p.endswith("pm"), 12).otherwise(0)) * 60 + m)
    return F.when(p.rlike(twelve), of_twelve).when(p.rlike(whole) & (h24 <= 23) & (m24 <= 59), h24 * 60 + m24)


def start_range(start: str | Column) -> Column:
    """struct(start, end) in minutes of a calendar's strict reading; a start that can't be read makes both null."""
    parts = F.split(F.lower(F.trim(text(start))), r"\s*[-–—]\s*")
    first = clock(F.get(parts, F.lit(0)))
    return F.struct(first.alias("start"), F.when(first.isNotNull(), clock(F.get(parts, F.lit(1)))).alias("end"))


def slug_day(url: str | Column) -> Column:
    """The day that a ticket page's address carries before ``/event/``."""
    u, p = text(url), r"(?i)-(\d{2})-(\d{2})-(\d{4})/event/"
    return F.concat_ws("-", F.regexp_extract(u, p, 3), F.regexp_extract(u, p, 1), F.regexp_extract(u, p, 2)).try_cast("date")


def night_of(day: str | Column, time: str | Column, url: str | Column) -> Column:
    """A show after midnight belongs to the night before, where its address says so."""
    d, slug = col(day).try_cast("date"), slug_day(url)
    early = F.regexp_extract(text(time), r"^(\d{2}):", 1).try_cast("int") <= 5
    return F.when(early & (F.datediff(d, slug) == 1), slug).otherwise(d)


def repaired(day: str | Column, start: str | Column, url: str | Column, zone: str = ZONE) -> Column:
    """struct(day, start, fixed): rows exactly a day off their address's day are moved; a whole stamp in UTC becomes local."""
    d, slug = col(day).try_cast("date"), slug_day(url)
    off = F.abs(F.datediff(d, slug)) == 1
    stamp = F.try_to_timestamp(F.concat_ws(" ", d.cast("string"), col(start)))
    local = F.from_utc_timestamp(stamp, zone)
    utc = off & (F.to_date(local) == slug) & F.coalesce(col(start) != "", F.lit(False))
    new = F.when(utc, F.date_format(local, "HH:mm:ss")).otherwise(col(start))
    return F.struct(F.when(off, slug).otherwise(d).alias("day"), F.when(off, new).otherwise(col(start)).alias("start"), F.coalesce(off, F.lit(False)).alias("fixed"))


def nearest_forward(month: Column, day: Column, today: Column, tolerance: int = 0) -> Column:
    """The day of a month and day without year that isn't over ``tolerance`` days before ``today``."""
    made = F.try_make_timestamp(F.year(today), month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    following = F.try_make_timestamp(F.year(today) + 1, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.when(made >= F.date_sub(today, tolerance), made).otherwise(following)


def weekend_anchor(day: str | Column) -> Column:
    """The Friday of a day's Monday-to-Sunday week."""
    return F.date_add(col(day), 4 - F.weekday(col(day)))


def day_label(day: str | Column) -> Column:
    return F.date_format(col(day), "E M/d")


def time_label(start: str | Column) -> Column:
    """"19:30" as "7:30pm", "20:00" as "8pm"; other texts as they are."""
    s = text(start)
    h, m = F.regexp_extract(s, r"^(\d{1,2}):(\d{2})", 1).try_cast("int"), F.regexp_extract(s, r"^(\d{1,2}):(\d{2})", 2)
    shown = F.concat((F.when(h % 12 == 0, 12).otherwise(h % 12)).cast("string"), F.when(m == "00", F.lit("")).otherwise(F.concat(F.lit(":"), m)), F.when(h < 12, F.lit("am")).otherwise(F.lit("pm")))
    return F.when(h.isNotNull() & (h < 24), shown).otherwise(F.nullif(s, F.lit("")))
