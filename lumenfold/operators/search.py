"""Finding rows and people by what is typed, and pools for price checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import prices
from lumenfold.functions.text import film_core, normalized, person_key, profile_hash, text
from lumenfold.operators.dedupe import first_of

OWNER_ALIASES = ("me", "default", "owner", "root", "self", "us")
RESOLD = ("club", "live-music", "comedy", "stage")


def haystack(events: DataFrame) -> Column:
    """What a catalogue's row is searched in: its title, bill and venue, of those that it has."""
    bill = [F.array_join("lineup", " ")] if "lineup" in events.columns else []
    return normalized(F.concat_ws(" ", *[text(c) for c in ("title",) if c in events.columns], *bill, *[text(c) for c in ("venue",) if c in events.columns]))


def matching_rows(events: DataFrame, query: str) -> DataFrame:
    """Rows whose title, bill and venue hold the phrase, or all of its words; for many lines at once see ``search_index``."""
    hay, phrase = haystack(events), normalized(F.lit(query))
    every = F.size(F.array_except(F.split(phrase, " "), F.split(hay, " "))) == 0
    return events.where((phrase != "") & (hay.contains(phrase) | every))


def priced_rows(events: DataFrame, query: str, today: date) -> DataFrame:
    """Rows (day, status) that a typed line finds among those to come and still listed, by day."""
    return matching_rows(events.where((F.col("day") >= F.lit(today)) & (text("status") != "unlisted")), query).orderBy("day")


def search_link(name: Column, base: str) -> Column:
    """An address that opens a site's search for a name."""
    return F.when(F.trim(name) != "", F.concat(F.lit(base), F.url_encode(F.trim(name))))


def showtimes_link(title: str | Column, city: str, base: str) -> Column:
    core = film_core(title)
    return F.concat(F.lit(base), F.url_encode(F.concat(F.lit('"'), core, F.lit(f'" showtimes {city}'))))


def price_pool(events: DataFrame, today: date, days: int, starred: DataFrame, top: int) -> DataFrame:
    """Rows worth a price check (key, day, lane, price, status, tier, rank_score, act): starred ones at any distance, else resold lanes of the
    window that aren't free or skipped; starred first, then by rank; ``top`` different acts."""
    s = starred.select(F.col("key").alias("_key")).distinct()
    open_rows = events.where(F.col("day") >= F.lit(today)).where(text("status") != "unlisted").join(s, F.col("key") == F.col("_key"), "left").withColumn("starred", F.col("_key").isNotNull()).drop("_key")
    plain = F.split("lane", ":")[0].isin(*RESOLD) & ~prices.is_free("price") & (text("tier") != "skip") & (F.col("day") <= F.date_add(F.lit(today), days))
    order = [F.desc("starred"), F.desc("rank_score"), F.desc("key")]
    return first_of(open_rows.where(F.col("starred") | plain), ["act"], *order).orderBy(*order).limit(top)


def resolve_people(asked: DataFrame, profiles: DataFrame, salt: str) -> DataFrame:
    """(person, id, name, hash) of typed names: the owner by alias or user name, others by user name, then by display name.

    profiles: (username, name, owner). The owner has no hash; unknown people give no row.
    """
    p = profiles.select(F.lower(F.trim("username")).alias("id"), "name", F.coalesce("owner", F.lit(False)).alias("owner"))
    a = asked.select("person", F.lower(F.trim("person")).alias("u"), person_key("person").alias("k")).distinct()
    alias = a.where(F.col("u").isin(*OWNER_ALIASES)).withColumn("_owner", F.lit(True))
    by_user = a.join(p, a["u"] == p["id"]).select("person", "id", "name", "owner", F.lit(0).alias("way"))
    by_user = by_user.unionByName(alias.join(p, F.col("_owner") == F.col("owner")).select("person", "id", "name", "owner", F.lit(0).alias("way")))
    by_name = a.join(p, a["k"] == person_key(p["name"])).select("person", "id", "name", "owner", F.lit(1).alias("way"))
    best = first_of(by_user.unionByName(by_name), ["person"], F.asc("way"), F.desc("owner"), F.asc("id"))
    return best.select("person", "id", "name", F.when(~F.col("owner"), profile_hash("id", salt)).alias("hash"))


def saved_rows(events: DataFrame, stars: DataFrame, profile: str) -> DataFrame:
    """Events that a person has starred; stars: (item, profiles)."""
    mine = stars.where(F.array_contains("profiles", profile)).select(F.col("item").alias("key"))
    return events.join(mine, "key", "left_semi")
