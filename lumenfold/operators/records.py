"""What leaves for judges and pages: hints, facts, notes and records, as columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import artist_key, folded, profile_hash, text
from lumenfold.operators.affinity import token_grams


def affinity_hint(found: DataFrame, genres: DataFrame, key: str, artists: int = 6, most_genres: int = 4) -> DataFrame:
    """(key, artists, genres): the heaviest names and genres that an event meets a person with; found: (key, name, weight), genres: (key, genre, ord)."""
    a = found.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "name"))), 1, artists), lambda x: x["name"]).alias("artists"))
    g = genres.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "genre"))), 1, most_genres), lambda x: x["genre"]).alias("genres"))
    return a.join(g, key, "full_outer")


def folded_words(c: str | Column) -> Column:
    """The words of a folded text, letters and numbers only."""
    return F.filter(F.split(F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def artist_notes(events: DataFrame, notes: DataFrame, key: str, ambiguous: tuple[str, ...] = (), least: int = 5, most: int = 4) -> DataFrame:
    """(key, notes): cached notes (name, note) of billed artists: entries of the bill, and on music rows long unambiguous names in the title.

    Both are equi-joins: entries by key, titles by their runs of words, in which longer names than ``most`` words meet by their first
    ones and are then looked for whole.
    """
    n = notes.select(artist_key("name").alias("artist"), "name", "note")
    billed = events.select(key, F.explode("lineup").alias("entry")).select(key, artist_key("entry").alias("artist"))
    music = events.where(F.lower(text("category")).isin("music", "live_music", "jazz", "electronic", "party"))
    named = n.where(F.char_length("artist") >= least).select("artist", folded_words("artist").alias("_w")).distinct()
    named = named.select("artist", F.array_join("_w", " ").alias("_all"), F.array_join(F.slice("_w", 1, most), " ").alias("gram"))
    words = music.select(key, F.concat(F.lit(" "), F.array_join(folded_words(text("title")), " "), F.lit(" ")).alias("_title"))
    titled = token_grams(music, key, F.col("title"), most).join(named, "gram").join(words, key)
    titled = titled.where(F.col("_title").contains(F.concat(F.lit(" "), F.col("_all"), F.lit(" ")))).select(key, "artist")
    if ambiguous:
        titled = titled.where(~F.col("artist").isin(*ambiguous))
    met = billed.unionByName(titled).distinct().join(n, "artist")
    return met.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("name", "note"))).alias("notes"))


def store_hash(asked: DataFrame, profiles: DataFrame, salt: str) -> DataFrame:
    """(hash, store) of feed hashes: the owner's store is the default one, null; others keep their hash; profiles: username, owner."""
    owners = profiles.where("owner and username <> ''").select(profile_hash("username", salt).alias("_owner")).distinct()
    both = asked.select("hash").join(owners, F.lower(F.trim("hash")) == F.col("_owner"), "left")
    return both.select("hash", F.when(F.col("_owner").isNull(), F.col("hash")).alias("store"))


def scene_facts(events: DataFrame, cache: DataFrame) -> DataFrame:
    """Events with what research found, opinions left out; cache: (key, card, notes, blurb, ...)."""
    return events.join(cache.select("key", "card", "notes"), "key", "left")


def judging_records(events: DataFrame, hints: DataFrame, taste_brief: str) -> DataFrame:
    """(key, record): one JSON text for each row to judge, with lane, hint, series note and the person's brief."""
    nights = F.when(F.col("nights") > 1, F.format_string("night %d of %d", F.col("night"), F.col("nights"))) if "nights" in events.columns else F.lit(None).cast("string")
    joined = events.withColumn("series_note", nights).join(hints, "key", "left")
    names = [c for c in ("key", "title", "day", "start", "venue", "neighborhood", "price", "lane", "score", "rating", "artists", "genres", "series_note") if c in joined.columns]
    return joined.select("key", F.to_json(F.struct(*names, F.lit(taste_brief).alias("taste"))).alias("record"))


def pool_document(records: DataFrame, summary: DataFrame, today: date, window_days: int, per_lane: int, floor: int, brief: str = "") -> DataFrame:
    """(document) one JSON text with what was asked and every record (key, record) of a pool, which ``top_k`` bounds; summary: artists, genres, a row at most."""
    listed = records.agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "record"))), lambda x: x["record"]).alias("events"), F.count(F.lit(1)).alias("count"))
    music = summary.agg(F.first(F.struct("artists", "genres")).alias("profile_affinity"))
    both = listed.crossJoin(F.broadcast(music))  # one row each
    facts = [F.lit(str(today)).alias("today"), F.lit(window_days).alias("window_days"), F.lit(per_lane).alias("per_lane"), F.lit(floor).alias("floor"), F.nullif(F.lit(brief), F.lit("")).alias("taste_profile")]
    head = F.to_json(F.struct(*facts, "count", "profile_affinity"))
    return both.select(F.concat(F.substr(head, F.lit(1), F.char_length(head) - 1), F.lit(',"events":['), F.array_join("events", ","), F.lit("]}")).alias("document"))


def teaser(md: str | Column) -> Column:
    """struct(text, day) of a document's comment slot; null where it is missing or empty."""
    m = text(md)
    found = F.trim(F.regexp_replace(F.regexp_extract(m, r"(?s)<!--\s*take:(?!start\b|end\b)([^<]*?)-->", 1), r"\s+", " "))
    return F.when(found != "", F.struct(found.alias("text"), F.nullif(F.regexp_extract(m, r"(?m)^# .*?(\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("day")))


def changes(diffed: DataFrame, most: int = 25) -> DataFrame:
    """One row: counts of added and updated rows and a bounded sample of what moved; diffed: added, changed_fields, title, day."""
    moved = diffed.where("changed_fields is not null").select("day", "title", "changed_fields").orderBy("day", "title").limit(most)
    sample = moved.agg(F.array_sort(F.collect_list(F.struct("day", "title", "changed_fields"))).alias("changes"))
    counts = diffed.agg(F.count_if("added").alias("added"), F.count("changed_fields").alias("updated"))
    return counts.crossJoin(F.broadcast(sample))  # one row each


def feed_signature(feed: DataFrame, prefs: str, n: int = 25) -> DataFrame:
    """(signature) over the first ``n`` rows (key, final_rank, tier) and the settings: equal while a digest needn't be rewritten."""
    head = feed.orderBy("final_rank").limit(n).agg(F.array_sort(F.collect_list(F.struct("final_rank", "key", F.coalesce("tier", F.lit("")).alias("tier")))).alias("h"))
    rows = F.array_join(F.transform("h", lambda x: F.concat_ws("|", x["key"], x["final_rank"], x["tier"])), "\n")
    return head.select(F.substring(F.sha2(F.concat(rows, F.lit("\n" + prefs)), 256), 1, 16).alias("signature"))


def fyi(events: DataFrame, acts: DataFrame, shelved: DataFrame, lens_end: date) -> DataFrame:
    """Big rooms with an act that matters and that no shelf shows soon, one row an act and night; events: key, day, final_rank, big."""
    named = events.where("big").join(acts.groupBy("key").agg(F.array_sort(F.collect_set(F.lower("act"))).alias("acts")), "key")
    soon = shelved.select(F.col("key").alias("_key")).distinct()
    free = named.join(soon, F.col("key") == F.col("_key"), "left").where(F.col("_key").isNull() | (F.col("day") > F.lit(lens_end))).drop("_key")
    return free.withColumn("_place", F.row_number().over(Window.partitionBy("day", "acts").orderBy("final_rank"))).where("_place = 1").drop("_place")


def around_town(events: DataFrame, today: date, far: Column, days: int = 14) -> DataFrame:
    """Near rows that fire a signal, whatever their score: not far away, the first night of a run, best signals first.

    events: key, title, venue, day, category, score, signals, rank, run; the window's end isn't part of it.
    """
    near = events.where((F.col("day") >= F.lit(today)) & (F.col("day") < F.date_add(F.lit(today), days))).where(~far)
    quiet = F.lower(text("category")).isin("film", "comedy")
    near = near.withColumn("signals", F.when(quiet, F.array_remove("signals", "civic")).otherwise(F.col("signals"))).where(F.size("signals") > 0)
    first = near.withColumn("_place", F.row_number().over(Window.partitionBy("run").orderBy("day", "key"))).where("_place = 1").drop("_place")
    return first.orderBy(F.desc("rank"), F.asc("day"), F.asc("key"))
