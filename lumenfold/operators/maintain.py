"""Keeping stores up to date: snapshots compared, caches folded, verdicts and prices upserted, schedules expanded."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import text
from lumenfold.operators.dedupe import first_of

VOLATILE = ("price", "start", "status", "lineup")
# What a verdict may say.
TIERS = ("must-see", "great", "solid", "skip")
CONFIDENCE = ("high", "med", "low")


def lineup_signature(lineup: str | Column) -> Column:
    """A bill without its order."""
    names = F.filter(F.transform(F.col(lineup) if isinstance(lineup, str) else lineup, lambda a: F.lower(F.trim(a))), lambda a: a != "")
    return F.coalesce(F.array_join(F.array_sort(names), ","), F.lit(""))


def volatile(df: DataFrame) -> dict[str, Column]:
    return {f: lineup_signature(f) if f == "lineup" and df.schema[f].dataType.typeName() == "array" else text(f) for f in VOLATILE if f in df.columns}


def diff_catalog(old: DataFrame, new: DataFrame, today: date, key: str = "key", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """``new`` with ``added``, ``changed_fields`` and ``updated_at`` against an older snapshot; rows that went aren't reported.

    Where the older snapshot repeats a key, its last row by ``order`` counts, whole.
    """
    fields = volatile(new)
    row = F.struct(*[c.alias(f"_{f}") for f, c in volatile(old).items()])
    before = old.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(*order)).alias("_last")).select("_key", "_last.*")
    both = new.join(before, F.col(key) == F.col("_key"), "left")
    moved = F.filter(F.array(*[F.when(c != F.col(f"_{f}"), F.lit(f)) for f, c in fields.items()]), lambda x: x.isNotNull())
    found = F.when(F.col("_key").isNotNull() & (F.size(moved) > 0), moved)
    out = both.withColumns({"added": F.col("_key").isNull(), "changed_fields": found})
    return out.withColumn("updated_at", F.when(F.col("changed_fields").isNotNull(), F.lit(today))).drop("_key", *[f"_{f}" for f in fields])


def version(rows: DataFrame, *parts: Column) -> DataFrame:
    """(version, n): twelve digits that depend on all rows, repeats too, and not on their order.

    Each row is hashed, and the hashes are added up by four parts, so nothing is sorted or gathered; the sums make the version.
    """
    hashed = rows.select(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256).alias("h"))
    sums = [F.coalesce(F.sum(F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"s{k}") for k in range(4)]
    total = hashed.agg(F.count(F.lit(1)).alias("n"), *sums)
    return total.select(F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3")]), 256), 1, 12).alias("version"), "n")


def needing(rows: DataFrame, store: DataFrame, key: str, stale: Column | None = None) -> DataFrame:
    """Rows without an entry in the store, or with one that is stale (a condition on both)."""
    kept = store.withColumnRenamed(key, "_key")
    if stale is None:
        return rows.join(kept.select("_key"), rows[key] == F.col("_key"), "left_anti")
    names = rows.columns
    return rows.join(kept, rows[key] == F.col("_key"), "left").where(F.col("_key").isNull() | stale).select(*[rows[c] for c in names])


def pruned(store: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Entries whose key is alive."""
    return store.join(live.select(key).distinct(), key, "left_semi")


def verdict_stale(version_now: int, drift: int, refresh_days: int | None, today: date) -> Column:
    """Whether a verdict (input_version, score_at_judge, judged_at) no longer holds for a row (score, reacted_at)."""
    reacted, judged = F.substring(text("reacted_at"), 1, 19), F.substring(text("judged_at"), 1, 19)
    out = ~F.col("input_version").eqNullSafe(version_now)
    out = out | ((reacted != "") & ((judged == "") | (reacted >= F.substring(judged, F.lit(1), F.char_length(reacted)))))
    out = out | F.coalesce(F.abs(F.coalesce("score", F.lit(0)) - F.col("score_at_judge")) >= drift, F.lit(False))
    if refresh_days is not None:
        day = F.substring(text("judged_at"), 1, 10).try_cast("date")
        out = out | day.isNull() | (F.datediff(F.lit(today), day) >= refresh_days)
    return out


def words_within(c: str | Column, most: int) -> Column:
    """A text cut at a word, with a mark, where it is longer than ``most``."""
    t = text(c)
    cut = F.regexp_replace(F.regexp_replace(F.substring(t, 1, most), r" [^ ]*$", ""), r"[ ,;—-]+$", "")
    return F.when(F.char_length(t) > most, F.concat(cut, F.lit(" …"))).otherwise(t)


def valid_verdicts(raw: DataFrame, lanes: tuple[str, ...], most_why: int = 280) -> DataFrame:
    """Raw verdicts of a known tier: adjustment within 3, lane and confidence of the vocabulary, reason cut at a word."""
    adjust = F.greatest(F.lit(-3), F.least(F.lit(3), F.coalesce(F.col("adjust").cast("string").try_cast("int"), F.lit(0))))
    return raw.where(F.col("tier").isin(*TIERS)).withColumns({
        "adjust": adjust, "lane": F.when(F.col("lane").isin(*lanes), F.col("lane")), "why": F.nullif(words_within("why", most_why), F.lit("")),
        "confidence": F.when(F.col("confidence").isin(*CONFIDENCE), F.col("confidence")).otherwise("med"),
    })


def valid_cards(raw: DataFrame) -> DataFrame:
    """Cards with draw 0-3, rarity and lineup_depth 0-2."""
    clamp = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(F.col(c).cast("string").try_cast("int"), F.lit(0)))).alias(c)
    return raw.select(*[c for c in raw.columns if c not in ("draw", "rarity", "lineup_depth")], clamp("draw", 3), clamp("rarity", 2), clamp("lineup_depth", 2))


def upsert(store: DataFrame, batch: DataFrame, by: list[str], order: str) -> DataFrame:
    """Store and batch by key, the last row of the batch wins, and the batch over the store."""
    both = store.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return first_of(both, by, F.desc("_batch"), F.desc(order)).drop("_batch")


def fold_cache(store: DataFrame, results: DataFrame, key: str, order: str) -> DataFrame:
    """A write-once cache: what is there stays, but a full record takes the place of a short one ("blurb")."""
    both = store.withColumn("_batch", F.lit(0)).unionByName(results.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    full = F.when(F.coalesce("enriched_tier", F.lit("full")) == "blurb", 1).otherwise(0)
    return first_of(both, [key], full.asc(), F.col("_batch").asc(), F.col(order).asc()).drop("_batch")


def price_options(options: DataFrame, most: int = 8) -> DataFrame:
    """(key, checked_at, options) of price rows (key, source, price, checked_at, ord): the last row of each source, cheapest first."""
    last = first_of(options, ["key", "source"], F.desc("ord"))
    order = F.struct(F.col("price").isNull().alias("none"), F.coalesce("price", F.lit(0.0)).alias("p"), F.col("source").alias("s"), F.col("price").alias("price"), F.col("checked_at").alias("checked_at"))
    by = last.groupBy("key").agg(F.max("checked_at").alias("checked_at"), F.slice(F.array_sort(F.collect_list(order)), 1, most).alias("o"))
    return by.select("key", "checked_at", F.transform("o", lambda x: F.struct(x["s"].alias("source"), x["price"].alias("price"), x["checked_at"].alias("checked_at"))).alias("options"))


_DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def expand_recurring(rules: DataFrame, today: date, days: int) -> DataFrame:
    """``rules`` (token "weekly:fri" or "monthly:2:sun", except_months) with a ``day`` for each occurrence in [today, today + days)."""
    parts = F.split(F.lower(F.trim(text("token"))), ":")
    dow = F.array_position(F.array(*map(F.lit, _DAYS)), F.substring(F.element_at(parts, -1), 1, 3)) - 1
    nth = F.get(parts, F.lit(1)).try_cast("int")
    all_days = F.sequence(F.lit(today), F.date_add(F.lit(today), days - 1))
    out = rules.withColumns({"_parts": parts, "_dow": dow, "_nth": nth}).withColumn("day", F.explode(all_days)).where("_dow >= 0 and weekday(day) = _dow")
    weekly = (F.size("_parts") == 2) & (F.get("_parts", F.lit(0)) == "weekly")
    monthly = (F.size("_parts") == 3) & (F.get("_parts", F.lit(0)) == "monthly") & (F.ceil(F.dayofmonth("day") / 7) == F.col("_nth"))
    kept = out.where(F.coalesce(weekly | monthly, F.lit(False)))
    return kept.where(~F.coalesce(F.array_contains("except_months", F.month("day")), F.lit(False))).drop("_parts", "_dow", "_nth")


def due_lookups(names: DataFrame, cache: DataFrame, today: date, retry_days: int, most: int) -> DataFrame:
    """Names never looked up, or missed longer than ``retry_days`` ago, the first ``most`` of them."""
    kept = cache.select(F.col("name").alias("_name"), "found", "looked_at")
    both = names.select("name").distinct().join(kept, F.col("name") == F.col("_name"), "left")
    due = F.col("_name").isNull() | (~F.col("found") & (F.datediff(F.lit(today), "looked_at") > retry_days))
    return both.where(due).select("name").orderBy("name").limit(most)


def infer_ends(stops: DataFrame, by: str, start: str, minutes: int) -> DataFrame:
    """Stops with an end: their own, the next one's start, or ``minutes`` after the last one's start."""
    following = F.lead(start).over(Window.partitionBy(by).orderBy(start))
    own = F.col("end") if "end" in stops.columns else F.lit(None).cast("timestamp")
    return stops.withColumn("end", F.coalesce(own, following, F.col(start) + F.expr(f"interval {minutes} minutes")))
