"""Logs of reactions, read as states: the last word of a person on an event, in the order of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STAR_KINDS = ("star", "unstar", "hide")


def last_states(reactions: DataFrame) -> DataFrame:
    """(profile, item, kind) with the last star, unstar or hide of each pair, by ``ord`` and not by time."""
    told = reactions.withColumn("kind", F.lower("kind")).where(F.col("kind").isin(*STAR_KINDS)).where("coalesce(item, '') <> '' and coalesce(profile, '') <> ''")
    return told.groupBy("profile", "item").agg(F.max_by("kind", "ord").alias("kind"))


def stars(reactions: DataFrame) -> DataFrame:
    """(item, profiles): who has an item starred now."""
    return last_states(reactions).where("kind = 'star'").groupBy("item").agg(F.array_sort(F.collect_set("profile")).alias("profiles"))


def named_stars(starred: DataFrame, names: DataFrame) -> DataFrame:
    """(item, stars): display structs (name, hash) by name; an unknown person shows as a stub of the hash."""
    one = starred.select("item", F.explode("profiles").alias("hash")).join(names, "hash", "left")
    shown = F.coalesce("name", F.concat(F.lit("friend·"), F.substring("hash", 1, 4)))
    listed = F.array_sort(F.collect_list(F.struct(F.lower(shown).alias("sort"), F.col("hash"), shown.alias("name"))))
    return one.groupBy("item").agg(F.transform(listed, lambda s: F.struct(s["name"].alias("name"), s["hash"].alias("hash"))).alias("stars"))


def latest(reactions: DataFrame) -> DataFrame:
    """(item, reacted_at): the last time of a reaction to each item."""
    return reactions.where("coalesce(item, '') <> '' and ts is not null").groupBy("item").agg(F.max("ts").alias("reacted_at"))


def effective(reactions: DataFrame) -> DataFrame:
    """The log without rows that repeat the state they find: an append that changes nothing isn't made."""
    before = F.lag("kind").over(Window.partitionBy("profile", "item").orderBy("ord"))
    return reactions.withColumn("_before", before).where("_before is null or _before <> kind").drop("_before")
