"""Markup that has landed as text: titles, links, visible words, tables and embedded event data, without a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import col, collapsed, text


def title(c: str | Column) -> Column:
    return F.regexp_extract(text(c), r"(?s)<title[^>]*>(.*?)</title>", 1)


def hrefs(c: str | Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))


def json_blocks(c: str | Column) -> Column:
    """The embedded linked-data blocks of a page."""
    return F.regexp_extract_all(text(c), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))


def stripped(c: Column) -> Column:
    return collapsed(F.regexp_replace(c, "<[^>]+>", " "))


def visible_text(c: str | Column) -> Column:
    """What a reader sees: no scripts, styles, comments or tags."""
    body = F.regexp_replace(text(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return stripped(F.regexp_replace(body, r"(?s)<!--.*?-->", " "))


def table_rows(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, row, cells): each table row's cells as texts; a cell that isn't closed ends where the next one starts."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(text(markup), F.lit(r"(?is)<tr[^>]*>(.*?)(?=</tr>|<tr[\s>]|$)"), F.lit(1))).alias("row", "_r"))
    cells = F.transform(F.slice(F.split("_r", r"(?i)<t[dh][^>]*>"), 2, 1 << 20), lambda x: stripped(x))
    return rows.select(key, "row", cells.alias("cells")).where(F.size("cells") > 0)


# Entities of markup, and words of late listings.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
_LATE = r"(?i)\b(after\s?hours|warehouse|all night|2am|3am|4am|5am|6am|late)\b"


def plain(c: Column) -> Column:
    """Markup as words: without tags, entities as what they stand for."""
    out = stripped(c)
    for entity, mark in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(mark))
    return collapsed(out)


def listing_table(pages: DataFrame, key: str, markup: str, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """(key, row, day, start, title, venue, genre, organizers, price, age, late, links, url) of the rows of a listing, of days from ``first`` to ``last``.

    A row's cells are weekday and time in brackets, "title @ venue" with the genre in a cell that opens within it, "price | age",
    organisers, links, and the day to sort by; the last " @ " parts title and venue. Rows without a day go; of rows that repeat
    day, title and venue, in any case of letters, the first stays.
    """
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(text(markup), F.lit(r"(?is)<tr[^>]*>(.*?)(?=</tr>|<tr[\s>]|$)"), F.lit(1))).alias("row", "_r"))
    rows = rows.withColumn("_c", F.slice(F.split("_r", r"(?i)<t[dh][^>]*>"), 2, 1 << 20)).where(F.size("_c") >= 6)
    cell = lambda i: F.get("_c", F.lit(i) if i >= 0 else F.size("_c") + i)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    when, who, info = plain(cell(0)), plain(cell(1)), F.split(plain(cell(-4)), r"\|", 2)
    ymd = [F.lpad(F.regexp_extract(cell(-1), r"\b(20\d{2})/(\d{1,2})/(\d{1,2})\b", k), 4 if k == 1 else 2, "0") for k in (1, 2, 3)]
    time = F.regexp_extract(when, r"\(([^)]*\d[^)]*)\)", 1)
    hour = F.regexp_extract(time, r"(?i)(\d{1,2})\s*(am|pm)", 1).try_cast("int") % 12 + F.when(F.lower(F.regexp_extract(time, r"(?i)(\d{1,2})\s*(am|pm)", 2)) == "pm", 12).otherwise(0)
    parted = who.contains(" @ ")
    urls = F.concat(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("href=[\"']([^\"']+)[\"']"), F.lit(1)) for c in (cell(-2), cell(1), F.when(F.size("_c") > 6, cell(2)))])
    links = F.array_distinct(F.filter(urls, lambda u: ~u.startswith("#")))
    title, venue = F.trim(F.when(parted, F.regexp_extract(who, r"^(.*) @ ", 1)).otherwise(who)), F.trim(F.when(parted, F.substring_index(who, " @ ", -1)))
    late = F.concat_ws(" ", title, plain(cell(-3)), when).rlike(_LATE) | F.coalesce((hour >= 22) | (hour <= 5), F.lit(False))
    out = rows.select(
        key, "row", F.concat_ws("-", *ymd).try_cast("date").alias("day"), blank(time).alias("start"), title.alias("title"), blank(venue).alias("venue"), blank(F.when(F.size("_c") > 6, plain(cell(2)))).alias("genre"),
        blank(plain(cell(-3))).alias("organizers"), blank(F.get(info, F.lit(0))).alias("price"), blank(F.get(info, F.lit(1))).alias("age"), late.alias("late"), links.alias("links"), F.get(links, F.lit(0)).alias("url"),
    ).where("day is not null and title <> ''")
    if first is not None:
        out = out.where(F.col("day") >= first)
    if last is not None:
        out = out.where(F.col("day") <= last)
    once = out.groupBy(key, "day", F.lower("title").alias("_t"), F.lower("venue").alias("_v")).agg(F.min("row").alias("row"))
    return out.join(once.select(key, "row"), [key, "row"], "left_semi")


# How a cinema's page marks films, days, showings and prints.
_FILM, _DAY, _SHOW = r'<div\s+class="film\s*"', r'(?s)<h4 class="date">\s*(.*?)\s*</h4>\s*<ul class="session-times">(.*?)</ul>', r"(?s)<li>(.*?)</li>"
_PRINT, _BUY = r"(?i)\b(70mm|35mm|16mm|nitrate|DCP|IMAX)\b", r'<a\s+href="([^"]*?/purchase/(\d+)[^"]*)"'
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def cinema_sessions(pages: DataFrame, key: str, markup: str, today: Column, days: int, origin: str, schedule: str) -> DataFrame:
    """(key, title, day, start, format, rating, sold_out, image, detail, url, url_label): film blocks by their days by their showings.

    Days without a year lie ahead. A showing counts once, by its ticket's number or by day, time and title; one without a ticket links to
    ``schedule`` and has no label. Addresses of posters are relative to ``origin``.
    """
    from lumenfold.functions.dates import nearest_forward

    part = lambda pattern: F.nullif(plain(F.regexp_extract("_film", pattern, 1)), F.lit(""))
    films = pages.select(key, F.posexplode(F.slice(F.split(text(markup), _FILM), 2, 1 << 20)).alias("_f", "_film"))
    films = films.withColumns({"title": part(r'(?s)<h3 class="title">\s*(.*?)\s*</h3>'), "rating": part(r'(?s)<span class="censor">\s*(.*?)\s*</span>'), "_desc": part(r'(?s)<p class="film-desc">\s*(.*?)\s*</p>'), "image": part(r'(?i)<img[^>]*class="poster"[^>]*src="([^"]+)"')}).where("title is not null")
    films = films.withColumns({"format": F.nullif(F.upper(F.regexp_extract(F.concat_ws(" ", "title", "_desc"), _PRINT, 1)), F.lit("")), "image": F.when(F.col("image").startswith("/"), F.concat(F.lit(origin), "image")).otherwise(F.col("image"))})
    dated = films.select("*", F.posexplode(F.regexp_extract_all("_film", F.lit(_DAY), F.lit(0))).alias("_d", "_day"))
    said = plain(F.regexp_extract("_day", _DAY, 1))
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.regexp_extract(said, r"(\d{1,2})\s*,\s*([A-Za-z]+)", 2))).cast("int")
    dated = dated.withColumn("day", nearest_forward(month, F.regexp_extract(said, r"(\d{1,2})\s*,\s*([A-Za-z]+)", 1).try_cast("int"), today, 0))
    dated = dated.where(F.col("day").between(today, F.date_add(today, days)))
    shows = dated.select("*", F.posexplode(F.regexp_extract_all(F.regexp_extract("_day", _DAY, 2), F.lit(_SHOW), F.lit(1))).alias("_s", "_show"))
    clock, form = F.replace(F.upper(plain(F.regexp_extract("_show", r"(?s)<time>\s*(.*?)\s*</time>", 1))), F.lit("."), F.lit("")), r"^(1[0-2]|0?[1-9])(?::([0-5]\d))? ([AP])M$"
    hour = F.regexp_extract(clock, form, 1).try_cast("int") % 12 + F.when(F.regexp_extract(clock, form, 3) == "P", 12).otherwise(0)
    minute = F.coalesce(F.nullif(F.regexp_extract(clock, form, 2), F.lit("")), F.lit("00"))
    sold, ticket = F.col("_show").contains("sold-out-session") | F.col("_show").contains("tickets-sold-out"), F.nullif(F.regexp_extract("_show", _BUY, 2), F.lit(""))
    label = F.concat(((hour + 11) % 12 + 1).cast("string"), F.when(minute != "00", F.concat(F.lit(":"), minute)).otherwise(""), F.when(hour < 12, "am").otherwise("pm"), F.when(sold, " · sold out").otherwise(""))
    shows = shows.where(clock.rlike(form)).withColumns({
        "start": F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), minute), "sold_out": sold, "_ticket": ticket, "url_label": F.when(ticket.isNotNull(), label),
        "url": F.when(ticket.isNotNull(), plain(F.regexp_extract("_show", _BUY, 1))).otherwise(F.lit(schedule)), "detail": F.nullif(F.concat_ws(" · ", "format", "_desc"), F.lit("")),
    })
    same = Window.partitionBy(key, F.coalesce("_ticket", F.concat_ws("-", "day", "start", F.lower("title")))).orderBy("_f", "_d", "_s")
    first = shows.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    return first.select(key, "title", "day", "start", "format", "rating", "sold_out", "image", "detail", "url", "url_label")


def calendar_cells(pages: DataFrame, key: str, markup: str, today: Column, tolerance: int = 45) -> DataFrame:
    """(key, cell, day, title, start, price) of a hand-made calendar: a cell with a month/day, the next cell's lines being title and notes.

    Cancelled rows go; a date without year is the nearest that isn't over ``tolerance`` days back.
    """
    from lumenfold.functions.dates import nearest_forward

    cells = pages.select(key, F.posexplode(F.transform(F.slice(F.split(text(markup), r"(?i)<td[^>]*>"), 2, 1 << 20), lambda x: F.regexp_replace(x, r"(?i)<br\s*/?>", "\n"))).alias("cell", "raw"))
    plain = cells.withColumn("lines", F.filter(F.transform(F.split(F.regexp_replace("raw", "<[^>]+>", " "), "\n"), lambda x: collapsed(x)), lambda x: x != ""))
    here = Window.partitionBy(key).orderBy("cell")
    plain = plain.withColumn("after", F.lead("lines").over(here))
    first = F.coalesce(F.get("lines", F.lit(0)), F.lit(""))
    month, day = F.regexp_extract(first, r"^(\d{1,2})/(\d{1,2})", 1).try_cast("int"), F.regexp_extract(first, r"^(\d{1,2})/(\d{1,2})", 2).try_cast("int")
    name = F.coalesce(F.get("after", F.lit(0)), F.lit(""))
    notes = F.array_join(F.slice("after", 2, 1 << 20), " ")
    out = plain.select(key, "cell", nearest_forward(month, day, today, tolerance).alias("day"), name.alias("title"), F.nullif(F.regexp_extract(notes, r"(?i)(\d{1,2}(?::\d{2})?\s*[ap]m)", 1), F.lit("")).alias("start"), F.nullif(F.regexp_extract(notes, r"(\$\d+(?:-\d+)?)", 1), F.lit("")).alias("price"))
    return out.where("day is not null and title <> ''").where(~F.lower("title").rlike(r"\bcancel+ed\b"))
