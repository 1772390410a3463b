"""Paged services that cap what one query may return: a span of time is read by windows, and a window with more than the cap is cut again until none is left over it.

Windows are rows (kind, chunk, origin, span, depth, number): of ``span`` seconds from ``origin`` on, cut into ``2 ** depth`` parts, the part ``number``.
A part has the seconds t with ``t * 2 ** depth div span = number``, so the parts of a part share none of its seconds and lose none.
All windows of a round are asked for in parallel; a round's pages are written before the next one starts, and there are fewer than ten rounds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import UTC, date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.components import saved
from lumenfold.operators.dedupe import first_of
from lumenfold.sources.feeds import windows

WINDOW = "kind string, chunk long, origin long, span long, depth int, number long"
PAGE = WINDOW + ", page int, total long, body string"
_KEYS = ["kind", "chunk", "depth", "number"]


def first_windows(spark: SparkSession, kinds: list[str], today: date, days: int, chunk: int = 30) -> DataFrame:
    """A window for each kind and range of ``chunk`` days in the ``days`` from ``today`` on; times are UTC."""
    at = lambda d: int(datetime(d.year, d.month, d.day, tzinfo=UTC).timestamp())
    rows = [(k, i, at(a), at(b) - at(a), 0, 0) for k in kinds for i, (a, b) in enumerate(windows(today, days, max(1, chunk)))]
    return spark.createDataFrame(rows, WINDOW)


def number_at(second: Column, origin: Column, span: Column, depth: Column) -> Column:
    """Which part of its window a second (since 1970) lies in."""
    return F.floor((second - origin) * F.pow(F.lit(2), depth).cast("long") / span)


def _starts(number: Column) -> Column:
    """The first second, from the origin, of a part."""
    return F.ceil(number * F.col("span") / F.pow(F.lit(2), F.col("depth")).cast("long"))


def bounds(rows: DataFrame) -> DataFrame:
    """``rows`` with their windows' ``since`` and ``until`` (seconds since 1970, the latter excluded)."""
    return rows.withColumn("since", F.col("origin") + _starts(F.col("number"))).withColumn("until", F.col("origin") + _starts(F.col("number") + 1))


def parts(over: DataFrame, bits: Column) -> DataFrame:
    """Each window in ``2 ** bits`` parts, without those that have no second."""
    cut = over.withColumn("_bits", bits).withColumn("_parts", F.pow(F.lit(2), F.col("_bits")).cast("long"))
    cut = cut.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    cut = cut.select("kind", "chunk", "origin", "span", (F.col("depth") + F.col("_bits")).cast("int").alias("depth"), (F.col("number") * F.col("_parts") + F.col("_part")).alias("number"))
    return cut.where(_starts(F.col("number")) < _starts(F.col("number") + 1))


def halves(over: DataFrame) -> DataFrame:
    """The two halves of each window."""
    return parts(over, F.lit(1))


def _split(cap: int) -> Column:
    """Whether a window is read by its parts: it has more than the cap, and more than a second."""
    return (F.col("total") > cap) & (F.col("until") - F.col("since") > 1)


def crawl(first: DataFrame, fetch: Callable[[DataFrame], DataFrame], cap: int = 1000, most_bits: int = 6) -> DataFrame:
    """All pages of ``first`` and of the parts of what passes the cap, as ``PAGE`` with ``since`` and ``until``.

    ``fetch`` gives the pages of windows (with ``since`` and ``until``); of a window over the cap that has more than a second its page 0 is
    enough. A window is cut into as many parts, a power of two, as would hold its records if they were spread evenly, and into more in each later
    round, up to ``2 ** most_bits``: what passes the cap then is a crowded moment, which plain halving would reach after some twenty rounds. Every window has a page 0, be it empty. A window of one second is read as far as the service goes: ``gaps`` tells what is short.
    """
    asked, rounds = first, []
    while True:
        pages = saved(bounds(fetch(bounds(asked)).select(*[c.split()[0] for c in PAGE.split(", ")])))
        rounds.append(pages)
        over = pages.where("page = 0").where(_split(cap))
        if over.isEmpty():
            break
        spread = F.ceil(F.log2(F.col("total") / cap)).cast("int")
        asked = parts(over, F.least(F.greatest(spread, F.lit(len(rounds))), F.lit(most_bits)))
    out = rounds[0]
    for pages in rounds[1:]:
        out = out.unionByName(pages)
    return out


def fetching(read: Callable[[str, int, int, int], str], total: tuple[str, ...], size: int = 100, cap: int = 1000) -> Callable[[DataFrame], DataFrame]:
    """A ``fetch`` for ``crawl`` out of a function that gives the body of one page: (kind, since, until, page) -> JSON text.

    ``total`` is where a body says how many records its window has. A page that fails or can't be parsed ends its window, and the first one counts as
    a page of nothing with an unknown (null) total; both show in ``gaps``. Windows are spread over tasks; a task holds one page at a time.
    """

    def pages_of(w: tuple) -> Iterator[tuple]:
        n = None
        for page in range(0, 1 << 30):
            try:
                body = read(w.kind, int(w.since), int(w.until), page)
                told = json.loads(body)
                for name in total:
                    told = told[name]
                n = int(told)
            except Exception:  # noqa: BLE001 - one page of a remote service; the window is told as a gap
                if page == 0:
                    yield (*w[:6], 0, None, None)
                return
            yield (*w[:6], page, n, body)
            if (page + 1) * size >= n or (n > cap and w.until - w.since > 1):
                return

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PAGE.split(", ")]
        for frame in frames:
            for w in frame.itertuples(index=False):
                for row in pages_of(w):
                    one = pd.DataFrame([row], columns=names)
                    yield one.astype({"total": "Int64"})

    return lambda asked: asked.repartition(*_KEYS).mapInPandas(task, PAGE)


def records(pages: DataFrame, items: str, schema: str, cap: int = 1000) -> DataFrame:
    """(kind, ord, r) the records of a crawl, ``items`` the JSON path of a body's list and ``schema`` that of a record.

    Pages of windows that were read by their parts give none. ``ord`` is a struct that grows in the order of kinds, time, pages and places.
    """
    kept = pages.where(~F.coalesce(_split(cap), F.lit(False)))
    listed = F.from_json(F.get_json_object("body", items), f"array<struct<{schema}>>")
    return kept.select("kind", "since", "page", F.posexplode(listed).alias("_i", "r")).select("kind", F.struct("kind", "since", "page", F.col("_i").alias("place")).alias("ord"), "r")


def latest(found: DataFrame, id: str = "id") -> DataFrame:
    """Each record once by its id, as it was read last, with the first ``ord`` that its id had; without an id it isn't kept."""
    rows = found.select("ord", "r.*").where(F.col(id).isNotNull())
    first = rows.groupBy(id).agg(F.min("ord").alias("first_ord"))
    return first_of(rows, [id], F.desc("ord")).drop("ord").join(first, id)


def gaps(pages: DataFrame, items: str, cap: int = 1000) -> DataFrame:
    """(kind, since, until, total, n) windows of which fewer records have come than the service has; null totals are windows that couldn't be read."""
    kept = pages.where(~F.coalesce(_split(cap), F.lit(False)))
    n = F.coalesce(F.expr(f"json_array_length(get_json_object(body, '{items}'))"), F.lit(0))
    seen = kept.groupBy("kind", "since", "until").agg(F.max("total").alias("total"), F.sum(n).alias("n"))
    return seen.where("total is null or n < total")
