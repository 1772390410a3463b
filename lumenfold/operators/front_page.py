"""The front page of a ranked catalogue: heroes of each lens, and tables by category.

Rows are representatives of programmes (``pool``), with ``section`` as ``select.sections`` tells it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import text
from lumenfold.operators import festivals, select
from lumenfold.operators.dedupe import first_of

FEATURED = ("sets", "events")
#: Keys of a table.
TABLE_ROWS = 40


def pool(events: DataFrame, today: date) -> DataFrame:
    """Rows that may stand on the page: dated, not past, no negative score, no skip, of a programme the representative."""
    kept = events.where(F.col("day") >= F.lit(today)).where(F.coalesce("score", F.lit(0)) >= 0).where(text("tier") != "skip")
    return kept.where(F.col("series").isNull() | F.col("series_rep"))


def heroes(rows: DataFrame, today: date, n: int = 6) -> DataFrame:
    """(lens, key, place): the diverse picks of each lens among featured sections; rows: key, day, section, rank_score, lane, tier.

    A row stands in each lens whose days hold its own, so all lenses are one pass. Programmes have one row here, so none is given.
    """
    windows = select.lens_windows(F.lit(today))
    lenses = F.array_compact(F.array(*[F.when(F.col("day").between(a, b), F.lit(lens)) for lens, (a, b) in windows.items()]))
    seen = rows.where(F.col("section").isin(*FEATURED)).withColumn("lens", F.explode(lenses))
    return select.top_picks(seen.withColumn("series", F.lit(None).cast("string")), "lens", n)


def _table(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    top = rows.orderBy(*order).limit(TABLE_ROWS)  # few rows, which one task can number
    return top.select(F.lit(name).alias("table"), "key", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


def tables(rows: DataFrame, acts: DataFrame, shelved: DataFrame, today: date) -> DataFrame:
    """(table, key, place) of seasonal, movies, theater, festivals and fyi, ``TABLE_ROWS`` of each.

    rows: key, day, section, final_rank, title, vibe, first and last (a programme's days, null without one), big (in a big room);
    acts: key, act, the acts of a bill that matter; shelved: key. Programmes stand by urgency, seasons by their first night, one
    row a festival, and big nights with an act that no shelf shows soon, one row an act and night. Each table reads the rows anew, so
    tagged ones are best saved before.
    """
    first, last = F.coalesce("first", "day"), F.coalesce("last", "day")
    rows = rows.withColumn("_first", first)
    by_night = [F.asc("_first"), F.asc("final_rank")]
    urgent = [select.urgency(first, last, F.lit(today)).asc(), F.asc("final_rank")]
    ends = F.date_add(F.lit(today), 60)
    named = rows.where(F.col("big") & F.col("section").isin("fyi", *FEATURED)).join(acts.groupBy("key").agg(F.array_sort(F.collect_set(F.lower("act"))).alias("_acts")), "key")
    soon = shelved.select(F.col("key").alias("_key")).distinct()
    loose = named.join(soon, F.col("key") == F.col("_key"), "left").where(F.col("_key").isNull() | (F.col("day") > ends))
    parts = {
        "seasonal": (rows.where("section = 'seasonal'"), by_night), "movies": (rows.where("section = 'movies'"), urgent), "theater": (rows.where("section = 'theater'"), urgent),
        "festivals": (festivals.season(rows), [F.asc("day"), F.asc("final_rank")]), "fyi": (first_of(loose, ["_first", "_acts"], F.asc("final_rank")), by_night),
    }
    out = None
    for name, (part, order) in parts.items():
        one = _table(part, name, *order)
        out = one if out is None else out.unionByName(one)
    return out


def joined(rows: DataFrame, feed: DataFrame, cap: int) -> DataFrame:
    """Keys of ``rows`` (key, ord) that the feed has, in order, the first ``cap``: what radar and around-town show."""
    return select.join_in_order(rows, feed, cap)
