"""Gazetteers of any size: names in a table, looked up in texts by a join instead of a condition for each name.

A plan has the same size for ten names and for a million. A name and a text that holds it meet by the name's rarest run of letters (see
``dedupe.held``), once for each distinct text; what a text then has is joined back by the text. The column forms in ``tags``, ``places`` and ``score`` give
the same results for the few names of a profile, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import folded, text
from lumenfold.operators.components import saved
from lumenfold.operators.dedupe import held
from lumenfold.operators.places import place_key

#: No letter or digit touches the name.
_EDGES = (r"(?<![a-z0-9])", r"(?![a-z0-9])")


def _pattern(name: str) -> Column:
    """A pattern that matches a folded name where no letter or digit touches it."""
    return F.concat(F.lit(_EDGES[0]), F.regexp_replace(name, r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(_EDGES[1]))


def within(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text, name): distinct texts and the names that they hold, or are; rows: text, and name. Null and empty ones hold nothing."""
    one = lambda df, c, mark: df.where(F.col(c) != "").select(F.lit(0).alias("day"), F.concat(F.lit(mark), c).alias("id"), F.col(c).alias("s")).distinct()
    met = held(one(names, "name", "n"), one(texts, "text", "t"))
    return met.select(F.expr("substring(b, 2)").alias("text"), F.expr("substring(a, 2)").alias("name"))


def longest(texts: DataFrame, names: DataFrame, least: int = 1, whole_words: bool = False) -> DataFrame:
    """(text, name, and the other columns of ``names``): the longest name in each distinct text, of equals the first by ``turn``.

    ``names``: name, turn and what goes with them; a name that occurs twice counts by its first turn. With ``whole_words`` names of one word must stand alone.
    """
    known = names.where(F.char_length("name") >= least)
    met = within(texts, known)
    if whole_words:
        alone = F.concat(F.lit(" "), "text", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("name"), F.lit(" ")))
        met = met.where(F.col("name").contains(" ") | alone)
    rest = [c for c in names.columns if c != "name"]
    first = known.groupBy("name").agg(F.min_by(F.struct(*rest), "turn").alias("_known"))
    best = met.join(first, "name").groupBy("text").agg(F.max_by(F.struct("name", "_known"), F.struct(F.char_length("name"), -F.col("_known.turn"))).alias("_best"))
    return best.select("text", F.col("_best.name").alias("name"), *[F.col(f"_best._known.{c}").alias(c) for c in rest])


def with_scale(events: DataFrame, scales: DataFrame, out: str = "scale") -> DataFrame:
    """``events`` (venue, setting) with the tier of the longest name in their venue; ``scales``: name, turn, tier, casino (whether a pool party isn't its hall)."""
    rows = events.withColumn("_venue", F.lower(text("venue")))
    known = longest(rows.select(F.col("_venue").alias("text")), scales)
    told = rows.join(known.select(F.col("text").alias("_venue"), "tier", "casino"), "_venue", "left")
    pool = F.array_contains("setting", "pool") & F.coalesce("casino", F.lit(False)) & (F.col("tier") == "arena")
    rest = F.when(F.array_contains("setting", "amphitheater"), "arena")
    return told.withColumn(out, F.when(F.col("tier").isNull(), rest).when(~F.coalesce(pool, F.lit(False)), F.col("tier"))).drop("_venue", "tier", "casino")


def with_venue_place(events: DataFrame, venues: DataFrame, out: str = "venue_place") -> DataFrame:
    """``events`` with the neighbourhood of their venue, by its whole name or the longest known one of four letters in it; ``venues``: name, turn, place."""
    rows = events.withColumn("_venue", place_key("venue"))
    texts = rows.select(F.col("_venue").alias("text"))
    exact = venues.groupBy("name").agg(F.min_by("place", "turn").alias("_exact")).select(F.col("name").alias("_venue"), "_exact")
    part = longest(texts, venues, 4).select(F.col("text").alias("_venue"), "place")
    return rows.join(exact, "_venue", "left").join(part, "_venue", "left").withColumn(out, F.coalesce("_exact", "place")).drop("_venue", "_exact", "place")


def tracked(events: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, hits): the tracked names billed in title or lineup, sorted; ``names``: name, ambiguous (must be an entry of the lineup). Events without any are left out."""
    bill = F.coalesce("lineup", F.array().cast("array<string>"))
    parts = F.flatten(F.transform(bill, lambda a: F.split(folded(a), r"\s+(?:b2b|b3b|vs\.?|×)\s+")))
    entries = F.transform(F.concat(parts, F.transform(parts, lambda p: F.regexp_replace(p, r"\s*\([^()]*\)\s*$", ""))), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    whole = folded(F.concat_ws(" ", text("title"), F.array_join(bill, " ")))
    rows = saved(events.select(key, whole.alias("_whole"), entries.alias("_entries")))
    plain = F.trim(F.regexp_replace("name", r"\s+", " "))
    named = names.select("name", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.lower(plain).alias("entry"), folded(plain).alias("bare")).where("char_length(entry) >= 2")
    met = within(rows.select(F.col("_whole").alias("text")), named.where("not ambiguous").select(F.col("bare").alias("name"))).withColumnsRenamed({"text": "_whole", "name": "bare"})
    met = met.where(F.regexp_like("_whole", _pattern("bare")))
    in_text = rows.select(key, "_whole").join(met, "_whole").join(named.where("not ambiguous"), "bare").select(key, "name")
    in_bill = rows.select(key, F.explode(F.array_distinct("_entries")).alias("entry")).join(named.where("ambiguous"), "entry").select(key, "name")
    return in_text.union(in_bill).groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("hits"))


def loved(events: DataFrame, names: DataFrame, out: str = "venue_loved") -> DataFrame:
    """``events`` with whether their venue names one of ``names`` (name) or the other way round, by whole words and without a leading article."""
    bare = lambda c: F.regexp_replace(F.trim(F.regexp_replace(text(c), r"\s+", " ")), "(?i)^the ", "")
    rows = events.withColumn("_venue", folded(bare("venue")))
    venues = rows.select(F.col("_venue").alias("text")).distinct()
    known = names.select(bare("name").alias("own")).where("char_length(own) >= 4").select(folded("own").alias("name"), F.lower("own").alias("low")).distinct()
    up = within(venues, known.select("name")).where(F.regexp_like("text", _pattern("name"))).select("text")
    down = within(known.select(F.col("low").alias("text")), venues.select(F.col("text").alias("name"))).where(F.regexp_like("text", _pattern("name"))).select(F.col("name").alias("text"))
    told = up.union(down).distinct().select(F.col("text").alias("_venue"), F.lit(True).alias("_loved"))
    return rows.join(told, "_venue", "left").withColumn(out, F.coalesce("_loved", F.lit(False))).drop("_venue", "_loved")
