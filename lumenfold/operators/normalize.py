"""Raw records of any source to canonical listings, and the gate that keeps advertising out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import dates, prices
from lumenfold.functions.text import col, collapsed, text

# The default category of a source.
SOURCE_CATEGORY = {
    "ra": "electronic", "19hz": "electronic", "posh": "party", "beatport": "electronic", "ticketmaster": "music", "goldenvoice": "music",
    "dice": "live_music", "roadhouse": "live_music", "filmbot": "film", "vidiots": "film", "veezi": "film", "vista": "film", "newbev": "film",
    "eventbrite": "general", "squarespace": "live_music", "ics": "general", "jsonld": "general",
}

# Entities that details are written with, and lines that say nothing.
_ENTITIES = (("&amp;", "&"), ("&nbsp;", " "), ("&#39;", "'"), ("&quot;", '"'), ("&rsquo;", "'"), ("&ldquo;", '"'), ("&rdquo;", '"'))
_EMPTY_LINE = (
    r"(?i)^\s*(buy\s+tickets?|get\s+tickets?|tickets?\s+(on\s+sale|available)|doors?\s+open|21\s*\+|18\s*\+|all\s+ages|presented\s+by|"
    r"follow\s+us|click\s+here|rsvp|sold\s+out|free\s+entry|no\s+refunds?).*$"
)

# What a title must not hold, in the order of the reasons.
PHONE = r"(?:\+?1[\s.\-()]{0,3})?\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}|\b\+?1?8(?:00|33|44|55|66|77|88)\d{7}\b"
SERVICE = (
    r"(?i)\b(customer\s+(?:service|care|support)|help\s?-?line|toll[\s\-]?free|reservations?\s+(?:number|line|phone|desk)|booking\s+number|"
    r"support\s+number|contact\s+number|phone\s+number|call\s+now|24[/x]7\s+(?:support|help|assist))\b"
)
TRAVEL_BRAND = (
    r"(?i)\b(airlines?|airways|ryanair|lufthansa|qantas(?:link)?|expedia|jetblue|easyjet|air\s+canada|air\s+france|british\s+airways|volotea|"
    r"eurowings|air\s+astana|oman\s+air|garuda|aegean|china\s+southern|norse\s+atlantic|arik\s+air|gulf\s+air|virgin\s+australia|breeze\s+airways)\b"
)
TRAVEL_ACTION = (
    r"(?i)\b(book(?:ing)?|reservations?|cancel(?:lation)?s?|refunds?|customer|support|service|helpdesk|phone|number|call|baggage|"
    r"check[\s\-]?in|flight\s+change|name\s+change|ticket\s+change)\b"
)
MONEY_BRAND = (
    r"(?i)\b(insurance|state\s+farm|allstate|geico|progressive\s+insurance|coinbase|robinhood|quickbooks|paypal|venmo|norton|mcafee|antivirus|"
    r"at&t|verizon|t-mobile|comcast|xfinity|ameren|pg&e|con\s+edison|socal\s+edison|duke\s+energy)\b"
)
MONEY_ACTION = (
    r"(?i)\b(customer\s+service|log\s?-?in|sign\s?-?in|bill\s+pay|billing|cancel(?:lation)?s?|policy|grace\s+period|claims?|refunds?|"
    r"credentials?|account\s+access|phone|number|support)\b"
)
FAQ = r"(?i)\bfaq\b.{0,80}(ways?\s+to\s+get|respond\s+quickly|contact\s+(?:tips|options)\s+guide|communication\s+tips)"
AIRLINE = r"(?i)\b\w+\s+air(?:lines?|ways)\b"
DIGITS = r"\d{2}-?\d{7,}|\d{9,}"
UPSELL = r"(?i)\bticketless\s+upgrade\b|\bvip\s+upgrade\b|\bupgrade\s+(?:pass|package)\b|\bparking\s+(?:pass|package)\b|\b(?:pre-?sale)\s+offer\b"
OFFER = r"(?i)^[\w&+.']+(?:\s+[\w&+.']+)?\s+offer\s*[-–—:]"


def clean_detail(detail: str | Column, most: int = 400) -> Column:
    """A description without tags, entities and lines that say nothing, cut at a word; null if under 3 letters remain."""
    s = F.regexp_replace(text(detail), "<[^>]+>", " ")
    for a, b in _ENTITIES:
        s = F.replace(s, F.lit(a), F.lit(b))
    lines = F.transform(F.split(s, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(_EMPTY_LINE))
    s = F.regexp_replace(collapsed(F.array_join(kept, " ")), r"\s+([.,;:!?])", "$1")
    cut = F.regexp_replace(F.substring(s, 1, most), r" [^ ]*$", "")
    cut = F.concat(F.regexp_replace(cut, "[,;:-]+$", ""), F.lit("…"))
    return F.when(F.char_length(s) >= 3, F.when(F.char_length(s) > most, cut).otherwise(s))


def junk_reason(title: str | Column, venue: str | Column | None = None, lineup: str | Column | None = None) -> Column:
    """Why a listing is no event, by its title; null for an event."""
    t = text(title)
    travel, money = t.rlike(TRAVEL_ACTION), t.rlike(MONEY_ACTION)
    out = (
        F.when(t.rlike(PHONE), "phone number in title (call-center spam)")
        .when(t.rlike(SERVICE), "call-center service phrasing in title")
        .when(t.rlike(TRAVEL_BRAND) & travel, "airline-hotline spam title")
        .when(t.rlike(MONEY_BRAND) & money, "insurance/account-service spam title")
        .when(t.rlike(FAQ), "FAQ-guide hotline spam title")
        .when(t.rlike(AIRLINE) & (travel | t.rlike(DIGITS)), "airline-hotline spam title")
        .when(t.rlike(UPSELL) | t.rlike(OFFER), "ticket add-on / presale-offer listing, not an event")
    )
    if venue is not None:
        v, none = text(venue), F.lit(True) if lineup is None else F.coalesce(F.size(col(lineup)), F.lit(0)) <= 0
        out = out.when((t != "") & (v != "") & none & (collapsed(F.lower(t)) == collapsed(F.lower(v))), "title is just the venue (placeholder listing)")
    return out


def split_junk(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, junk with its reason); both filter one column."""
    judged = events.withColumn("junk", junk_reason("title", "venue", "lineup" if "lineup" in events.columns else None))
    return judged.where("junk is null").drop("junk"), judged.where("junk is not null")


def links(existing: Column | None, aliases: list[tuple[str, Column]], source: Column) -> Column:
    """Links as given, else one for each address alias that is set: array of struct(source, url, label)."""
    made = F.array(*[F.struct(F.coalesce(source, F.lit("?")).alias("source"), c.cast("string").alias("url"), F.lit(None).cast("string").alias("label")) for _, c in aliases])
    made = F.filter(made, lambda x: F.coalesce(x["url"], F.lit("")) != "")
    return made if existing is None else F.when(F.coalesce(F.size(existing), F.lit(0)) > 0, existing).otherwise(made)


_ALIASES = {
    "title": ("title", "name", "event_name"), "venue": ("venue", "venue_name"), "organizers": ("organizers", "organizer", "promoter"),
    "detail": ("detail", "description", "desc"),
}
_ADDRESSES = ("url", "ticket_url", "link", "event_url", "tickets")


def normalize_records(raw: DataFrame, source: str | None = None) -> DataFrame:
    """Records with any of the usual column names as canonical listings. Missing columns count as null."""
    has = set(raw.columns)

    def first(*names: str) -> Column:
        found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in has]
        return F.coalesce(*found, F.lit(None).cast("string"))

    many = [F.when(F.size(F.col(n)) > 0, F.col(n)) if raw.schema[n].dataType.typeName() == "array" else F.when(text(n) != "", F.array(F.col(n).cast("string"))) for n in ("lineup", "artists", "artist") if n in has]
    empty = F.array().cast("array<string>")
    lineup = F.filter(F.coalesce(*many, empty).cast("array<string>"), lambda x: F.coalesce(x, F.lit("")) != "")
    origin = first("source") if source is None else F.lit(source)
    sources = F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array(origin)) if "sources" in has else F.array(origin)
    day = F.coalesce(dates.event_day(first("date", "datetime")).cast("string"), F.substring(first("date"), 1, 10))
    flag = lambda *names: F.coalesce(*[F.col(n).cast("boolean") for n in names if n in has], F.lit(False))
    by_source = F.create_map(*[F.lit(x) for kv in SOURCE_CATEGORY.items() for x in kv])
    given = F.col("links") if "links" in has and "struct" in raw.schema["links"].dataType.simpleString() else None
    return raw.select(
        first(*_ALIASES["title"]).alias("title"), day.alias("date"), dates.start_text(first("start", "time"), first("datetime")).alias("start"),
        first(*_ALIASES["venue"]).alias("venue"), first("neighborhood").alias("neighborhood"),
        F.coalesce(first("category"), F.try_element_at(by_source, origin), F.lit("general")).alias("category"),
        first("genre").alias("genre"), first("lineup_genre").alias("lineup_genre"), lineup.alias("lineup"),
        links(given, [(n, F.col(n)) for n in _ADDRESSES if n in has], origin).alias("links"), F.filter(sources, lambda x: x.isNotNull()).alias("sources"),
        first(*_ALIASES["organizers"]).alias("organizers"), clean_detail(first(*_ALIASES["detail"])).alias("detail"), first("image").alias("image"),
        prices.price_text(first("price"), first("price_min"), first("price_max")).alias("price"), flag("ra_pick").alias("ra_pick"), flag("afterhours", "afterhours_flag").alias("afterhours"),
    )


def required(events: DataFrame) -> DataFrame:
    """Rows that have a title and a date."""
    return events.where((text("title") != "") & (text("date") != ""))
