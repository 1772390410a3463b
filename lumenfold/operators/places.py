"""Where a listing is: place names made canonical, and put on the map, by small gazetteers given as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import geo
from lumenfold.functions.text import text


@dataclass(frozen=True)
class Map:
    """Neighbourhoods with coordinates, venues with their neighbourhood, city-level names and cities outside."""

    places: dict[str, tuple[float, float]] = field(default_factory=dict)
    venues: dict[str, str] = field(default_factory=dict)
    city_names: tuple[str, ...] = ()
    city: str = ""
    outside: tuple[str, ...] = ()
    display: dict[str, str] = field(default_factory=dict)
    home: tuple[float, float] | None = None


def place_key(c: str | Column) -> Column:
    """A place's comparable name: without a leading article, marks as spaces, other signs dropped."""
    s = F.regexp_replace(F.lower(F.trim(text(c))), "^the ", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[+&/\-'.]", " "), r"[^\p{L}\p{N} ]", ""), r" +", " "))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _longest_within(key: Column, names: list[str], least: int = 4, whole_words: bool = False) -> Column:
    """The longest of ``names`` within a key, of equals the first; single words must stand alone if ``whole_words``."""
    out = None
    for n in sorted((n for n in names if len(n) >= least), key=lambda n: -len(n)):
        hit = F.concat(F.lit(" "), key, F.lit(" ")).contains(f" {n} ") if whole_words and " " not in n else key.contains(n)
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return F.lit(None).cast("string") if out is None else out


def shown(key: Column, m: Map) -> Column:
    """A place's display name: its own spelling where one is set, else capitals."""
    return F.coalesce(_lookup(key, m.display), F.nullif(F.initcap(key), F.lit("")))


def venue_place(venue: str | Column, m: Map) -> Column:
    """The neighbourhood of a known venue, by its whole name or the longest known name within it."""
    key = place_key(venue)
    return F.coalesce(_lookup(key, m.venues), _lookup(_longest_within(key, list(m.venues)), m.venues))


def canonical_place(venue: str | Column, neighborhood: str | Column, m: Map) -> Column:
    """The best label for a listing's place: its own unless blank or the whole city, then the venue's, a place named in the
    venue, a city outside in its brackets, the city; null if nothing is known."""
    own, key = place_key(neighborhood), place_key(venue)
    specific = (own != "") & ~own.isin(*m.city_names) if m.city_names else own != ""
    inside = place_key(F.trim(F.get(F.split(F.regexp_extract(text(venue), r"\(([^)]+)\)", 1), "[/,]"), F.lit(0))))
    known = inside.isin(*m.places, *m.outside) & ~inside.isin(*m.city_names) if m.places or m.outside else F.lit(False)
    named = _longest_within(key, list(m.places), whole_words=True)
    found = F.coalesce(shown(venue_place(venue, m), m), shown(named, m), F.when(known, shown(inside, m)))
    return F.when(specific, shown(own, m)).otherwise(F.coalesce(found, F.when(own != "", F.lit(m.city))))


def coordinates(place: str | Column, m: Map) -> Column:
    """struct(lat, lon) of home, a neighbourhood, a venue or a text that names one; null if none does."""
    key = place_key(place)
    hood = F.coalesce(_lookup(key, {n: n for n in m.places}), venue_place(place, m), _longest_within(key, list(m.places)))
    hood = F.coalesce(_lookup(hood, {n: n for n in m.places}), _longest_within(hood, list(m.places)))
    lat, lon = (F.try_element_at(F.create_map(*[F.lit(x) for n, c in m.places.items() for x in (n, float(c[i]))]), hood) if m.places else F.lit(None).cast("double") for i in (0, 1))
    if m.home:
        at_home = key.isin("home", "house", "my place")
        lat, lon = F.when(at_home, float(m.home[0])).otherwise(lat), F.when(at_home, float(m.home[1])).otherwise(lon)
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def legs(stops: DataFrame, by: str, order: str, travel: geo.Travel = geo.Travel()) -> DataFrame:  # noqa: B008
    """Each stop (by, order, lat, lon) with the leg to the next one; the last has none."""
    here = Window.partitionBy(by).orderBy(order)
    ahead = stops.withColumns({"_lat": F.lead("lat").over(here), "_lon": F.lead("lon").over(here), "_next": F.lead(order).over(here)})
    return ahead.where("_next is not null").withColumn("leg", geo.leg(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"), travel)).drop("_lat", "_lon", "_next")


def route_totals(found: DataFrame, by: str) -> DataFrame:
    """(by, legs, total_minutes, total_miles, unplaced) of legs."""
    return found.groupBy(by).agg(
        F.count(F.lit(1)).alias("legs"), F.coalesce(F.sum("leg.minutes"), F.lit(0)).alias("total_minutes"), F.bround(F.coalesce(F.sum("leg.miles"), F.lit(0.0)), 1).alias("total_miles"),
        F.count_if(F.col("leg.mode") == "unknown").alias("unplaced"),
    )
