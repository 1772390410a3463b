"""Choosing from a scored catalogue: calendars, diverse picks, day slates, pools and shelves.

Everything is a window or a top-k: caps, ends and guaranteed places are counts over an order, not a walk through it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import text
from lumenfold.operators.components import saved
from lumenfold.operators.normalize import split_junk

MOST_EVENTS = 500


@dataclass(frozen=True)
class Selection:
    """The settings of a calendar subscription; empty lists ask for nothing, exclusion wins."""

    least_rating: int = 3
    per_day: int = 3
    horizon: int = 60
    weekdays: tuple[int, ...] = ()
    types: tuple[str, ...] = ()
    not_types: tuple[str, ...] = ()
    genres: tuple[str, ...] = ()
    not_genres: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()

    @staticmethod
    def of(raw: dict[str, str], types: Iterable[str], genres: Iterable[str]) -> Selection:
        """Settings out of request parameters: numbers are clamped, unknown names dropped."""

        def number(name: str, default: int, low: int, high: int) -> int:
            try:
                return max(low, min(high, int(raw.get(name, default))))
            except ValueError:
                return default

        def names(name: str, known: Iterable[str] | None) -> tuple[str, ...]:
            found = [x.strip().lower() for x in raw.get(name, "").split(",") if x.strip()]
            return tuple(dict.fromkeys(x for x in found if known is None or x in set(known)))

        days = tuple(sorted({int(x) for x in names("days", None) if x.isdigit() and int(x) < 7}))
        return Selection(number("min", 3, 1, 5), number("perday", 3, 1, 20), number("horizon", 60, 1, 180), days, names("types", types), names("xtypes", types), names("genres", genres), names("xgenres", genres), names("keys", None))


def eligible(events: DataFrame, s: Selection, today: date) -> DataFrame:
    """Titled rows within the horizon that pass the settings; a verdict of "skip" never does."""
    has = set(events.columns)
    kept = events.where(text("title") != "").where(F.col("day").between(F.lit(today), F.date_add(F.lit(today), s.horizon)))
    if s.keys:
        return kept.where(F.col("key").isin(*s.keys))
    if "tier" in has:
        kept = kept.where("coalesce(tier, '') <> 'skip'")
    kept = kept.where(F.col("rating") >= s.least_rating)
    if s.weekdays:
        kept = kept.where(F.weekday("day").isin(*s.weekdays))
    if s.not_types:
        kept = kept.where(~F.col("type").isin(*s.not_types))
    if s.types:
        kept = kept.where(F.col("type").isin(*s.types))
    if s.not_genres:
        kept = kept.where(~F.arrays_overlap("genre", F.array(*map(F.lit, s.not_genres))))
    if s.genres:
        kept = kept.where(F.arrays_overlap("genre", F.array(*map(F.lit, s.genres))))
    return kept


def calendar(events: DataFrame, s: Selection, today: date, most: int = MOST_EVENTS) -> DataFrame:
    """The best ``per_day`` rows of each day by rating, score and title (then id); at most ``most`` of these overall, the best first."""
    order = [F.desc("rating"), F.desc("score"), F.asc("title"), F.asc("id")]
    of_day = F.row_number().over(Window.partitionBy("day").orderBy(*order))
    best = eligible(events, s, today).withColumn("_place", of_day).where(F.col("_place") <= s.per_day).drop("_place")
    return best.orderBy(*order).limit(most)


def top(events: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows by ``order``."""
    return events.orderBy(*order).limit(n)


def top_in(events: DataFrame, n: int, by: list[str], *order: Column) -> DataFrame:
    """The first ``n`` rows of each group by ``order``."""
    return events.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def top_picks(events: DataFrame, by: str, n: int = 6, lane_cap: int = 2, family_cap: int = 3) -> DataFrame:
    """(by, key, place): diverse picks of each group; events: by, key, rank_score, lane, tier, series.

    A key counts by its best row and not at all if that one is a skip; a programme counts by its best key, even where a cap then
    stops it. A lane that is full stays full, and so does a family of lanes, so both caps are places: first within
    the lane, then within the family of what its lanes let through.
    """
    best = [F.desc("rank_score"), F.desc("key")]
    slim = events.where(f"{by} is not null").select(by, "key", "rank_score", "lane", "tier", "series")
    rows = top_in(slim, 1, [by, "key"], *best).where("coalesce(tier, '') <> 'skip'")
    rows = rows.withColumns({"_unit": F.coalesce(F.concat(F.lit("s:"), F.nullif("series", F.lit(""))), F.concat(F.lit("k:"), F.col("key"))), "_family": F.split("lane", ":")[0]})
    for most, within in ((1, "_unit"), (lane_cap, "lane"), (family_cap, "_family")):
        rows = top_in(rows, most, [by, within], *best)
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*best)).cast("long"))
    return placed.where(F.col("place") <= n).select(by, "key", "place")


def slates(events: DataFrame, weekday: int, weekend: int, gap: float | None = 3, guarantee: tuple[str, ...] = (), mute: tuple[str, ...] = (), caps: dict[str, int] | None = None, least: int = 2) -> DataFrame:
    """(day, key, place): the slate of each day; Friday and Saturday have their own size; events: day, key, score, adjust, rank_score, lane.

    By merit (rank score, then key) rows of lanes below their cap fill the day up to its size, or up to the row whose score with its
    adjustment lies more than ``gap`` under that of the row taken before it. Then guaranteed lanes without a row enter, in their order, with
    their best row of score ``least`` or more: into free places, then into those of the weakest rows that aren't the best of their lane.
    All of it is places and running counts over one order of a day's rows.
    """
    best, worst = [F.desc("rank_score"), F.desc("key")], [F.asc("rank_score"), F.asc("key")]
    slim = events.where("day is not null").select("day", "key", "score", "adjust", "rank_score", "lane").withColumn("strong", F.coalesce("score", F.lit(0)) >= least)
    if mute:
        slim = slim.where(~F.col("lane").isin(*mute))
    # Without caps a slate's rows are among so many of a lane's strong and of its other rows, which is settled before the shuffle.
    rows = slim if caps else top_in(slim, max(weekday, weekend), ["day", "lane", "strong"], *best)
    of_day, of_lane = Window.partitionBy("day").orderBy(*best), Window.partitionBy("day", "lane").orderBy(*best)
    earlier = of_day.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("lane")) if caps else F.lit(None).cast("int")
    rows = rows.withColumns({"size": F.when(F.weekday("day").isin(4, 5), weekend).otherwise(weekday), "plain": F.coalesce("score", F.lit(0)) + F.coalesce("adjust", F.lit(0)), "open": F.row_number().over(of_lane) <= F.coalesce(cap, F.lit(1 << 30))})
    drop = F.last(F.when(F.col("open"), F.col("plain")), True).over(earlier) - F.col("plain")
    full = F.coalesce(F.count_if("open").over(earlier), F.lit(0)) >= F.col("size")
    rows = rows.withColumn("ends", full | (F.coalesce(drop > gap, F.lit(False)) if gap is not None else F.lit(False)))
    rows = rows.withColumn("taken", F.col("open") & ~F.max("ends").over(of_day.rowsBetween(Window.unboundedPreceding, 0)))
    if guarantee:
        turn = F.array_position(F.array(*map(F.lit, guarantee)), F.col("lane"))
        first = F.row_number().over(Window.partitionBy("day", "lane", "strong").orderBy(*best)) == 1
        absent = ~F.max("taken").over(Window.partitionBy("day", "lane"))
        rows = rows.withColumn("spare", F.col("strong") & first & absent & (turn > 0)).where("taken or spare")
        day = Window.partitionBy("day")
        rows = rows.withColumn("movable", F.col("taken") & (F.row_number().over(Window.partitionBy("day", "lane", "taken").orderBy(*best)) > 1))
        rows = rows.withColumn("room", F.col("size") - F.count_if("taken").over(day))
        rows = rows.withColumn("entering", F.least(F.count_if("spare").over(day), F.col("room") + F.count_if("movable").over(day)))
        enters = F.row_number().over(Window.partitionBy("day", "spare").orderBy(turn)) <= F.col("entering")
        leaves = F.row_number().over(Window.partitionBy("day", "movable").orderBy(*worst)) <= F.col("entering") - F.col("room")
        rows = rows.withColumn("taken", F.when(F.col("spare"), enters).otherwise(~(F.col("movable") & leaves)))
    picked = rows.where("taken")
    return picked.select("day", "key", F.row_number().over(of_day).cast("long").alias("place"))


def judge_pool(events: DataFrame, top_k: int, floor: int, skip_lanes: tuple[str, ...]) -> DataFrame:
    """The ``top_k`` best rows of slate lanes, and of the other lanes those that score ``floor`` or more; events: key, score, day, id, lane."""
    side = F.col("lane").isin(*skip_lanes)
    head = top(events.where(~side), top_k, F.desc("score"), F.asc("day"), F.asc("id"))
    return head.unionByName(events.where(side & (F.col("score") >= floor)))


def editor_pool(events: DataFrame, today: date, floor: int = 4, skip_lanes: tuple[str, ...] = ("market", "workshop"), per_lane: int = 0, top_k: int | None = None) -> DataFrame:
    """What is worth a judgement, of events (key, day, title, venue, lineup, lane, score): neither past nor advertising; undated rows pass.

    All rows of slate lanes, or the best ``top_k`` of them, or the best ``per_lane`` of each day and lane; and what scores ``floor`` or
    more, of the other lanes only where ``top_k`` bounds the slate's. Each key once.
    """
    kept = split_junk(events.where(F.col("day").isNull() | (F.col("day") >= F.lit(today))))[0]
    side, high = F.col("lane").isin(*skip_lanes), F.coalesce("score", F.lit(0)) >= floor
    best = [F.desc(F.coalesce("score", F.lit(0))), F.asc("day"), F.asc("key")]
    if per_lane > 0:
        picked = top_in(kept.where(~side), per_lane, ["day", "lane"], *best).unionByName(kept.where(high))
    elif top_k is None:
        picked = kept.where(~side | high)
    else:
        picked = top(kept.where(~side), top_k, *best).unionByName(kept.where(side & high))
    return top_in(picked, 1, ["key"], *best)


def batches(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """``rows`` with ``batch`` 1..k, even cuts in order: row r of n falls into the batch whose bounds i*n//k hold it.

    Rows are dealt to ranges of the order, which are written; a row's place is its place in its range after the ranges before, whose
    sizes, a row each, are all that is summed in one task.
    """
    apart = saved(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = apart.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.select("_range", (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    r = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = apart.join(sizes, "_range").withColumn("batch", F.floor((r * k - 1) / F.col("_total")).cast("long") + 1)
    return placed.drop("_range", "_before", "_total")


def sections(events: DataFrame) -> Column:
    """The front page's section of a programme's representative (lane, vibe, scale, tier, span, standing)."""
    festival = F.array_contains("vibe", "festival")
    season = F.coalesce(F.col("scale").isin("hall", "arena"), F.lit(False)) | (F.col("lane") == "live-music:big") | (F.coalesce("span", F.lit(0)) > 0)
    return (
        F.when(festival & season, "festivals").when(festival, "events").when(F.col("lane") == "film", "movies").when(F.col("lane") == "stage", "theater")
        .when(F.col("lane") == "live-music:big", F.when(F.col("tier").isin("must-see", "great"), "sets").otherwise("fyi"))
        .when(F.col("lane").startswith("club:") | (F.col("lane") == "live-music"), "sets").when(F.col("standing"), "seasonal").otherwise("events")
    )


def lens_windows(today: Column) -> dict[str, tuple[Column, Column]]:
    """First and last day of each lens of the front page."""
    w = F.weekday(today)
    start = F.when(w >= 4, today).otherwise(F.date_add(today, F.pmod(F.lit(4) - w, F.lit(7))))
    sunday = F.date_add(today, 6 - w)
    return {"today": (today, today), "weekend": (start, F.date_add(start, 6 - F.weekday(start))), "twoweeks": (today, F.date_add(sunday, 14)), "ahead": (F.date_add(today, 14), F.date_add(today, 60))}


def urgency(first: Column, last: Column, today: Column) -> Column:
    """Sort key of programme tables: open runs by their last day, then what is to come by its first."""
    return F.when(first <= today, F.struct(F.lit(0).alias("open"), last.alias("a"), first.alias("b"))).otherwise(F.struct(F.lit(1).alias("open"), first.alias("a"), last.alias("b")))


def shelves(events: DataFrame, today: date, near_days: int = 13, cap: int = 40) -> DataFrame:
    """(section, shelf, key, place): near and ahead shelves of each section, by final rank; events: key, section, day, final_rank."""
    shelf = F.when(F.col("day") <= F.date_add(F.lit(today), near_days), "near").otherwise("ahead")
    placed = events.withColumn("shelf", shelf).withColumn("place", F.row_number().over(Window.partitionBy("section", "shelf").orderBy("final_rank")))
    return placed.where(F.col("place") <= cap).select("section", "shelf", "key", F.col("place").cast("long").alias("place"))


def join_in_order(rows: DataFrame, feed: DataFrame, cap: int) -> DataFrame:
    """Keys of ``rows`` (key, ord) that the feed has, in order, the first ``cap``."""
    first = rows.groupBy("key").agg(F.min("ord").alias("ord"))
    return first.join(feed.select("key"), "key", "left_semi").orderBy("ord").limit(cap)
