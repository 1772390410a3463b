"""Feeds that have landed as files: paged records, line logs, iCalendar, and what their fields mean."""

from __future__ import annotations

from datetime import date
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import dates
from lumenfold.functions.text import text
from lumenfold.operators.components import saved
from lumenfold.operators.dedupe import first_of


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines with ``_file`` and ``ord``, their order in it; blank, ``#`` and malformed lines are passed over.

    Files are read by blocks. A line's place is the offset of its block and its number there, which is smaller than the
    block's bytes, so places grow along a file, as log files are appended to and never rewritten.
    """
    read = saved(spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("_line")))  # so that both uses see the same numbers
    starts = read.groupBy("_file", "_block").agg(F.min("_id").alias("_first"))
    lines = read.join(starts, ["_file", "_block"]).withColumn("ord", F.col("_block") + F.col("_id") - F.col("_first")).select("_file", "ord", "_line")
    kept = lines.withColumn("_line", F.trim("_line")).where("_line <> '' and not startswith(_line, '#')")
    parsed = kept.withColumn("_r", F.from_json("_line", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("_r is not null and _r._bad is null").select("_file", "ord", "_r.*").drop("_bad")


def windows(today: date, days: int, chunk: int) -> list[tuple[date, date]]:
    """Consecutive day ranges that cover [today, today + days), so that no request passes a result cap."""
    from datetime import timedelta

    return [(today + timedelta(days=a), today + timedelta(days=min(a + chunk, days))) for a in range(0, days, chunk)]


def latest_records(pages: DataFrame) -> DataFrame:
    """Records of paged reads by id, the last read one."""
    return first_of(pages, ["id"], F.desc("ord"))


def ticket_record(raw: DataFrame) -> DataFrame:
    """REST records (name, url, localDate, localTime, venues, priceRanges, segment, genre, attractions) to raw listings."""
    blank = lambda c: F.when(F.lower(F.trim(text(c))).isin("", "undefined", "other", "miscellaneous"), None).otherwise(F.trim(text(c)))
    venue, price = F.get("venues", F.lit(0)), F.get("priceRanges", F.lit(0))
    return raw.select(
        "id", F.col("name").alias("title"), dates.night_of("localDate", "localTime", "url").cast("string").alias("date"), F.substring("localTime", 1, 5).alias("start"), venue["name"].alias("venue"),
        venue["city"].alias("neighborhood"), F.col("segment").alias("category"), blank("genre").alias("genre"), blank(F.get("attractions", F.lit(0))["genre"]).alias("lineup_genre"),
        F.filter(F.transform("attractions", lambda a: a["name"]), lambda n: n.isNotNull()).alias("lineup"), price["min"].cast("string").alias("price_min"), price["max"].cast("string").alias("price_max"), resale_links("id", "url", "outlets").alias("links"),
    )


def resale_links(id: str, url: str, outlets: str) -> Column:
    """Links of a record: a resale one (id Z...) leads with the venue's own box office."""
    link = lambda source, u: F.struct(source.alias("source"), u.alias("url"), F.lit(None).cast("string").alias("label"))
    own = F.transform(F.filter(F.coalesce(F.col(outlets), F.array().cast("array<struct<type:string,url:string>>")), lambda o: (o["type"] == "venueBoxOffice") & (text(o["url"]) != "")), lambda o: link(F.lit("venue"), o["url"]))
    main = F.array(link(F.lit("ticketmaster"), F.col(url)))
    return F.when(text(id).startswith("Z"), F.concat(own, main)).otherwise(main)


def _turn(k: Column, rank: Column, i: Column) -> Column:
    """One number in the order of list, rank and place: bits from 56 on, from 24 on, and below."""
    return F.shiftleft(k.cast("long"), 56) + F.shiftleft(rank.cast("long"), 24) + i


def listening(payload: DataFrame) -> DataFrame:
    """(profile, source, name, rank, genres, ord) signals of landed pulls: profile, top (by window, lists of name and genres), followed, recent.

    Ranks count from 0 within a list; ``ord`` runs through a profile's signals, lists first.
    """
    windows = (("long_term", "top_long"), ("medium_term", "top_medium"), ("short_term", "top_short"))
    parts = [payload.select("profile", F.lit(k).alias("_k"), F.lit(source).alias("source"), F.posexplode(F.try_element_at("top", F.lit(window))).alias("rank", "_a")) for k, (window, source) in enumerate(windows)]
    parts.append(payload.select("profile", F.lit(3).alias("_k"), F.lit("followed").alias("source"), F.posexplode("followed").alias("rank", "_a")))
    plays = payload.select("profile", F.posexplode("recent").alias("rank", "_p")).select("profile", "rank", F.posexplode("_p.track.artists").alias("_i", "_x"))
    none = F.array().cast("array<string>")
    rows = [p.select("profile", "source", F.col("_a.name").alias("name"), "rank", F.coalesce("_a.genres", none).alias("genres"), _turn(F.col("_k"), F.col("rank"), F.lit(0)).alias("ord")) for p in parts]
    rows.append(plays.select("profile", F.lit("recent").alias("source"), F.col("_x.name").alias("name"), "rank", none.alias("genres"), _turn(F.lit(4), F.col("rank"), F.col("_i")).alias("ord")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.where(F.coalesce("name", F.lit("")) != "")


def market_offers(found: DataFrame, metro: str) -> DataFrame:
    """(offer, ord, day, venue, name, price, prefee, url) of a marketplace's search items (event, venue) in a metropolis, for
    ``matching.best_offers``: prices in cents with all fees become amounts; without one there is no offer."""
    e, price = F.col("event"), F.col("event.min_price")
    rows = found.where(F.lower(text("venue.metro")) == metro).where(F.coalesce(price["total"], F.lit(0)) > 0)
    return rows.select(
        F.xxhash64(e["seo_url"], e["name"], e["datetime_local"]).alias("offer"), "ord", F.substring(e["datetime_local"], 1, 10).try_cast("date").alias("day"), F.col("venue.name").alias("venue"), e["name"].alias("name"),
        F.bround(price["total"] / 100, 2).alias("price"), F.when(F.coalesce(price["prefee"], F.lit(0)) > 0, F.bround(price["prefee"] / 100, 2)).alias("prefee"), e["seo_url"].alias("url"),
    )


def cheapest_listing(found: DataFrame) -> DataFrame:
    """(key, price, url) the lowest price before fees among a search's events (key, lowest_price, url, ord), of equals the first."""
    return first_of(found.where(F.coalesce("lowest_price", F.lit(0)) > 0), ["key"], F.asc("lowest_price"), F.asc("ord")).select("key", F.col("lowest_price").cast("double").alias("price"), "url")


def late_listing(raw: DataFrame) -> DataFrame:
    """Listing records (title, date, startTime, endTime, venue, artists, pick) with the late-start flag: from 22 or before 6."""
    hour = F.regexp_extract(text("startTime"), r"T(\d{2}):", 1).try_cast("int")
    return raw.select("title", F.substring("date", 1, 10).alias("date"), F.regexp_extract(text("startTime"), r"T(\d{2}:\d{2})", 1).alias("start"), "venue", F.col("artists").alias("lineup"), F.coalesce("pick", F.lit(False)).alias("ra_pick"), F.coalesce((hour >= 22) | (hour < 6), F.lit(False)).alias("afterhours"))


def least_visible_price(tickets: str | Column) -> Column:
    """The cheapest of structs (price, hidden) that buyers see."""
    c = F.col(tickets) if isinstance(tickets, str) else tickets
    return F.array_min(F.transform(F.filter(c, lambda t: ~F.coalesce(t["hidden"], F.lit(False)) & t["price"].isNotNull()), lambda t: t["price"]))


def active_local(raw: DataFrame, cities: tuple[str, ...], today: date, days: int) -> DataFrame:
    """Feed records (active, private, city, day, headliner, support) of given cities within a window, with their bill."""
    kept = raw.where(F.col("active") & ~F.coalesce("private", F.lit(False)) & F.lower("city").isin(*[c.lower() for c in cities]))
    kept = kept.where(F.col("day").between(F.lit(today), F.date_add(F.lit(today), days)))
    return kept.withColumn("lineup", F.filter(F.concat(F.array("headliner"), F.coalesce("support", F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != ""))


def showtimes(shows: DataFrame, films: DataFrame, posters: DataFrame) -> DataFrame:
    """Shows (show_id, name, day, time) with their film's data by name and poster by show, once for each (day, name, time)."""
    f = films.select(F.lower(F.trim("name")).alias("_name"), *[c for c in films.columns if c != "name"])
    p = posters.select(F.col("show_id").alias("_show"), "image")
    joined = shows.join(f, F.lower(F.trim(shows["name"])) == F.col("_name"), "left").join(p, F.col("show_id") == F.col("_show"), "left").drop("_name", "_show")
    return first_of(joined, ["day", "name", "time"], F.asc("show_id"))


def epoch_items(raw: DataFrame, zone: str = dates.ZONE) -> DataFrame:
    """Site items (title, startDate in ms, body) with their local time; a title that is a date gives way to the body's first sentence."""
    local = F.from_utc_timestamp(F.to_utc_timestamp(F.timestamp_millis("startDate"), F.current_timezone()), zone)
    sentence = F.regexp_extract(F.regexp_replace(text("body"), "<[^>]+>", " "), r"^\s*([^.!?]+)", 1)
    dated = text("title").rlike(r"(?i)^\s*(\d{1,2}[/.-]\d{1,2}|(mon|tue|wed|thu|fri|sat|sun)|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d)")
    return raw.select(F.when(dated & (F.trim(sentence) != ""), F.trim(sentence)).otherwise(F.col("title")).alias("title"), F.to_date(local).cast("string").alias("date"), F.date_format(local, "HH:mm").alias("start"))


def calendar_events(files: DataFrame, body: str = "value", zone: str = dates.ZONE) -> DataFrame:
    """(summary, location, url, description, day, start) of iCalendar texts: unfolded, by VEVENT; UTC and times of a known TZID move to ``zone``."""
    plain = F.regexp_replace(text(body), "\r?\n[ \t]", "")
    one = files.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))).alias("e"))
    field = lambda name: F.nullif(F.regexp_extract("e", rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1), F.lit(""))
    clear = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, r"\\[nN]", "\n"), F.lit("\\,"), F.lit(",")), F.lit("\\;"), F.lit(";")), F.lit("\\\\"), F.lit("\\"))
    raw = field("DTSTART")
    stamp = F.try_to_timestamp(F.concat(F.substring(raw, 1, 8), F.substring(raw, 10, 6)), F.lit("yyyyMMddHHmmss"))
    told = F.regexp_extract("e", r"(?m)^DTSTART;(?:[^:\r\n]*;)?TZID=\"?([^;:\"\r\n]+)", 1)
    known = F.when(told.isin(*sorted(available_timezones())), told).otherwise(zone)
    local = F.when(raw.endswith("Z"), F.from_utc_timestamp(stamp, zone)).otherwise(F.from_utc_timestamp(F.to_utc_timestamp(stamp, known), zone))
    day = F.coalesce(F.to_date(local), F.to_date(F.try_to_timestamp(F.substring(raw, 1, 8), F.lit("yyyyMMdd"))))
    return one.select(clear(field("SUMMARY")).alias("summary"), clear(field("LOCATION")).alias("location"), field("URL").alias("url"), clear(field("DESCRIPTION")).alias("description"), day.alias("day"), F.date_format(local, "HH:mm").alias("start"))


def rsvp_record(articles: DataFrame, today: Column) -> DataFrame:
    """(title, day, start, venue) out of prose: "doors 9pm", "Saturday, June 6 at The Room"; a date without year lies ahead."""
    month = F.regexp_extract(text("body"), r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? (\d{1,2})\b", 1)
    day = F.regexp_extract(text("body"), r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? (\d{1,2})\b", 2).try_cast("int")
    number = F.array_position(F.array(*map(F.lit, ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))), F.lower(month)).cast("int")
    doors = F.regexp_extract(text("body"), r"(?i)\bdoors(?: open)?(?: at)?:? (\d{1,2}(?::\d{2})?\s*[ap]m)", 1)
    venue = F.regexp_extract(text("body"), r"\bat ((?:[A-Z][\w']*)(?: [A-Z][\w']*)*)", 1)
    return articles.select("title", dates.nearest_forward(number, day, today).alias("day"), F.nullif(doors, F.lit("")).alias("start"), F.nullif(venue, F.lit("")).alias("venue"))


def inbox(stream: DataFrame) -> DataFrame:
    """Inbound messages (sid, ts, body), each id once however often it is delivered."""
    return stream.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["sid"]) if stream.isStreaming else first_of(stream, ["sid"], F.asc("ts"))


def organizer_links(pages: DataFrame, key: str, markup: str, registry: DataFrame, most: int = 12) -> DataFrame:
    """(key, url) of the first ``most`` event pages that an organiser's page links to and the registry doesn't know yet."""
    links = F.slice(F.array_distinct(F.regexp_extract_all(text(markup), F.lit(r'href="(https://[^"]*/e/[^"?#]+)'), F.lit(1))), 1, most)
    return pages.select(key, F.explode(links).alias("url")).join(registry.select("url").distinct(), "url", "left_anti")


def fetch_horizon(sources: DataFrame, days: int, far_days: int) -> DataFrame:
    """Sources (name, far) with how far ahead to read them."""
    return sources.withColumn("days", F.when(F.coalesce("far", F.lit(False)), far_days).otherwise(days))
