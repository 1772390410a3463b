"""Linked data in pages, read in the JVM: blocks become variants, which are walked level by level, and events become records.

A level is one pass over all nodes of that depth, however many pages and blocks there are; walking ends where no node has children. Order
within a block is kept in paths: lists of places, which sort children before their parents or after them. Blocks that can't be read are counted. What is
no object or list is passed over; an object with one key twice can't be read.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import collapsed, text
from lumenfold.operators.components import discarded, saved
from lumenfold.sources import images
from lumenfold.sources.html import json_blocks, plain

#: Where nested events are: in graphs and lists; a venue's page nests them further.
GRAPHS = ("@graph", "itemListElement", "item")
NESTED = ("event", "events", "@graph", "itemListElement", "item", "subEvent")
#: Sorts after all places of children.
_LAST = 1 << 30
# Fixed value: words of electronic nights.
ELECTRONIC = r"(?i)\b(dj|techno|house|disco|rave|afters?|warehouse|club night|b2b|vinyl|selectors?)\b"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _at(v: Column, name: str) -> Column:
    """A member of an object, as a variant."""
    return _get(v, f"$['{name}']", "variant")


def _items(v: Column) -> Column:
    """The items of a list; null for anything else."""
    return _get(v, "$", "array<variant>")


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _first(v: Column) -> Column:
    """The first item of a list, or else the value itself."""
    return F.when(_items(v).isNotNull(), F.get(_items(v), F.lit(0))).otherwise(v)


def _plain_text(v: Column) -> Column:
    """A text, or the name or else the id of an object."""
    named = F.coalesce(F.nullif(_get(_first(_at(v, "name")), "$", "string"), F.lit("")), F.nullif(_get(v, "$['@id']", "string"), F.lit("")))
    return F.when(_is_object(v), named).when(_items(v).isNull(), _get(v, "$", "string"))


def _text(v: Column) -> Column:
    return _plain_text(_first(v))


def _events(level: DataFrame, suffix: str) -> Column:
    kinds = F.coalesce(_get(F.col("node"), "$['@type']", "array<string>"), F.array(_get(F.col("node"), "$['@type']", "string")))
    known = (lambda k: k.endswith("Event")) if suffix else (lambda k: k.contains("Event") | (k == "Festival"))
    return _is_object(F.col("node")) & F.coalesce(F.exists(kinds, known), F.lit(False))


def nodes(pages: DataFrame, key: str, markup: str, children: tuple[str, ...] = GRAPHS, parents_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(key, block, path, node) of a page's events, and (key, blocks, unread) of pages that have blocks.

    Sorted by block and path, events come in the order of a walk through ``children`` in turn, an event after the events in it, or before them.
    With ``parents_first`` only types that end in "Event" count, as on venues' pages.
    """
    blocks = saved(pages.select(key, F.posexplode(json_blocks(markup)).alias("block", "_text")))
    whole = F.when(F.col("_text").contains("&quot;"), plain(F.col("_text"))).otherwise(F.trim("_text"))
    level = saved(blocks.select(key, "block", F.array().cast("array<int>").alias("path"), F.try_parse_json(whole).alias("node")))
    counts = level.groupBy(key).agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("node").isNull()).alias("unread"))
    discarded(blocks)
    found = None
    while True:
        own = F.col("path") if parents_first else F.concat("path", F.array(F.lit(_LAST)))
        events = level.where(_events(level, "Event" if parents_first else "")).select(key, "block", own.alias("path"), "node")
        found = events if found is None else found.union(events)
        members = F.filter(F.transform(F.array(*[F.struct(F.lit(k).alias("k"), _at(F.col("node"), c).alias("v")) for k, c in enumerate(children)]), lambda x: x), lambda x: x["v"].isNotNull())
        items = F.transform(_items(F.col("node")), lambda v, i: F.struct(i.alias("k"), v.alias("v")))
        deeper = level.select(key, "block", "path", F.explode(F.coalesce(items, F.when(_is_object(F.col("node")), members))).alias("x"))
        deeper = deeper.where(_is_object(F.col("x.v")) | _items(F.col("x.v")).isNotNull())
        level = saved(deeper.select(key, "block", F.concat("path", F.array("x.k")).alias("path"), F.col("x.v").alias("node")))
        if not level.limit(1).count():
            discarded(level)
            return found, counts


def _offer(v: Column) -> tuple[Column, Column, Column]:
    """(low, plain, high) prices of the first offer as texts."""
    first = _first(_at(v, "offers"))
    return tuple(F.when(_is_object(first), _get(first, f"$.{c}", "string")) for c in ("lowPrice", "price", "highPrice"))


def _filled(c: Column) -> Column:
    return F.when(~F.coalesce(c.isin("", "0"), F.lit(False)), c)


def _image(v: Column) -> Column:
    one = _at(v, "image")
    urls = F.transform(F.coalesce(_items(one), F.array(one)), lambda x: F.when(_is_object(x), F.coalesce(F.nullif(_get(x, "$.url", "string"), F.lit("")), _get(x, "$.contentUrl", "string"))).when(_items(x).isNull(), _get(x, "$", "string")))
    return images.first_clean(urls)


def _people(v: Column) -> Column:
    one = F.coalesce(_at(v, "performer"), _at(v, "performers"))
    names = F.transform(F.coalesce(_items(one), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>")), lambda x: plain(F.coalesce(_text(x), F.lit(""))))
    return F.filter(names, lambda n: n != "")


def records(found: DataFrame, key: str) -> DataFrame:
    """(key, block, path, id, title, date, start, end, venue, neighborhood, address, lat, lng, category, price_min, price, lineup, organizer, detail, image, url) of event nodes."""
    v = F.col("node")
    place = _first(_at(v, "location"))
    at = _at(place, "address")
    street = F.when(_is_object(at), _get(at, "$.streetAddress", "string")).when(_items(at).isNull(), _get(at, "$", "string"))
    low, one, high = _offer(v)
    least = F.coalesce(_filled(low), one)
    free = F.coalesce(one.isin("0", "0.00"), F.lit(False))
    price = F.when(least.isNull() | least.isin("", "0", "0.00"), F.when(free, "free")).when((_filled(high) != least), F.concat(F.lit("$"), least, F.lit("-"), high)).otherwise(F.concat(F.lit("$"), least))
    start = F.nullif(_get(v, "$.startDate", "string"), F.lit(""))
    url = _text(_at(v, "url"))
    kind = _at(v, "@type")
    return found.select(
        key, "block", "path", F.coalesce(F.nullif(url, F.lit("")), _get(v, "$['@id']", "string"), _text(_at(v, "name"))).alias("id"), _text(_at(v, "name")).alias("title"), F.substring(start, 1, 10).alias("date"), start.alias("start"),
        F.nullif(_get(v, "$.endDate", "string"), F.lit("")).alias("end"), _plain_text(place).alias("venue"), F.when(_is_object(at), _get(at, "$.addressLocality", "string")).alias("neighborhood"), street.alias("address"),
        _get(place, "$.geo.latitude", "double").alias("lat"), _get(place, "$.geo.longitude", "double").alias("lng"), F.when(_items(kind).isNull(), _get(kind, "$", "string")).alias("category"), least.alias("price_min"), price.alias("price"),
        _people(v).alias("lineup"), _text(_at(v, "organizer")).alias("organizer"), _get(v, "$.description", "string").alias("detail"), _image(v).alias("image"), url.alias("url"),
    )


def first_of_each(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of rows equal in ``by`` the first of their page, by block and path: an aggregation, so that many may be equal."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)]).agg(F.min_by(whole, F.struct("block", "path")).alias("_row")).select("_row.*")


def page_events(pages: DataFrame, key: str, markup: str) -> tuple[DataFrame, DataFrame]:
    """Records of titled events, of each page's the first by id; and the counts of blocks."""
    found, counts = nodes(pages, key, markup)
    return first_of_each(records(found, key).where("title <> ''"), [key, "id"]), counts


def venue_events(pages: DataFrame, key: str, markup: str, zone: str, today: date, days: int) -> tuple[DataFrame, DataFrame]:
    """Records of venues' pages (key, markup, page_url, name, hood) from ``today`` to ``today`` + ``days`` in a time zone, of each page's the first by address; and the counts.

    Times without an offset are local; ``start`` is local hours and minutes. A page's name and neighbourhood are its records'; an event without an address has the
    page's. A night's words make it electronic, else it is music.
    """
    found, counts = nodes(pages, key, markup, NESTED, parents_first=True)
    said = F.col("start")
    local = F.when(said.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.to_timestamp_ntz(F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(F.try_to_timestamp(said), F.current_timezone()), zone), "yyyy-MM-dd HH:mm:ss")))
    local = F.coalesce(local, F.when(~said.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), said.try_cast("timestamp_ntz")))
    rows = records(found, key).join(pages.select(key, F.col("page_url").alias("_url"), F.col("name").alias("_name"), F.col("hood").alias("_hood")), key).withColumn("_local", local)
    rows = rows.where(F.to_date("_local").between(F.lit(today), F.date_add(F.lit(today), days)))
    rows = rows.withColumns({
        "url": F.coalesce(F.nullif("url", F.lit("")), "_url"), "title": plain(text("title")), "date": F.date_format("_local", "yyyy-MM-dd"), "start": F.date_format("_local", "HH:mm"),
        "venue": F.coalesce(F.nullif("_name", F.lit("")), "venue"), "neighborhood": F.col("_hood"),
    })
    words = collapsed(F.concat_ws(" ", "title", F.array_join("lineup", " ")))
    rows = rows.withColumn("category", F.when(words.rlike(ELECTRONIC), "electronic").otherwise("music")).drop("_url", "_name", "_hood", "_local")
    return first_of_each(rows, [key, "url"]), counts
