"""Prices as free text: made from ranges, read back as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.text import col, text

_MONEY = r"\$\s?(\d+(?:\.\d+)?)"


def plain(number: Column) -> Column:
    """A number with up to six significant digits and no trailing zeros."""
    digits = F.format_string("%.6f", F.round(number, 6))
    return F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def price_text(price: str | Column, low: str | Column, high: str | Column) -> Column:
    """An explicit price wins; else ``$low-high``, ``$low``, "free", or null."""
    lo, hi = F.expr("double(null)"), F.expr("double(null)")
    lo, hi = col(low).try_cast("double"), col(high).try_cast("double")
    none = (F.coalesce(lo, F.lit(0.0)) == 0) & (F.coalesce(hi, F.lit(0.0)) == 0)
    one = F.when(F.coalesce(lo, F.lit(0.0)) != 0, lo).otherwise(hi)
    both = (F.coalesce(lo, F.lit(0.0)) != 0) & (F.coalesce(hi, F.lit(0.0)) != 0) & (lo != hi)
    made = (
        F.when(none & ((lo == 0) | (hi == 0)), F.lit("free"))
        .when(none, F.lit(None).cast("string"))
        .when(both, F.concat(F.lit("$"), plain(lo), F.lit("-"), plain(hi)))
        .otherwise(F.concat(F.lit("$"), plain(one)))
    )
    return F.when(text(price) != "", col(price).cast("string")).otherwise(made)


def amounts(price: str | Column) -> Column:
    """All dollar figures of a text, as an array of doubles."""
    return F.transform(F.regexp_extract_all(text(price), F.lit(_MONEY), F.lit(1)), lambda x: x.cast("double"))


def least_amount(price: str | Column) -> Column:
    return F.array_min(amounts(price))


def most_whole_amount(price: str | Column) -> Column:
    """The largest whole-dollar figure."""
    return F.array_max(F.transform(F.regexp_extract_all(text(price), F.lit(r"\$\s?(\d+)"), F.lit(1)), lambda x: x.cast("long")))


def is_free(price: str | Column) -> Column:
    return text(price).rlike(r"(?i)\bfree\b|no cover") & ~text(price).rlike(_MONEY)


def listed_option(price: str | Column, source: str | Column, url: str | Column, checked: str | Column) -> Column:
    """The row of a price comparison that a listing's own text makes; null without a figure or "free"."""
    least = least_amount(price)
    made = F.struct(
        F.lower(F.coalesce(col(source), F.lit("listed"))).alias("source"), F.lit("listed").alias("kind"), F.coalesce(least, F.lit(0.0)).alias("price"),
        F.lit(None).cast("double").alias("prefee"), col(url).alias("url"), F.nullif(F.trim(text(price)), F.lit("")).alias("note"), col(checked).alias("checked_at"),
    )
    return F.when(least.isNotNull() | is_free(price), made)


def resale_option(total: str | Column, prefee: str | Column, url: str | Column, checked: str | Column) -> Column:
    """The row that a marketplace's amounts in cents make; null where nothing is for sale."""
    made = F.struct(
        F.lit("market").alias("source"), F.lit("resale").alias("kind"), F.round(col(total) / 100.0, 2).alias("price"), F.when(col(prefee) > 0, F.round(col(prefee) / 100.0, 2)).alias("prefee"),
        col(url).alias("url"), F.lit("all-in").alias("note"), col(checked).alias("checked_at"),
    )
    return F.when(col(total) > 0, made)


def search_name(title: str | Column, lineup: str | Column) -> Column:
    """What to ask a marketplace for: the first billed name, else the title without its dressing."""
    tail = r"\s*\((?:[^)]*)\)\s*$"
    first = F.trim(text(F.get(col(lineup), F.lit(0))))
    head = F.trim(F.regexp_replace(first, tail, ""))
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text(title)), r"(?i)^an evening with\s+", ""), tail, ""))
    cut = F.trim(F.regexp_replace(t, r"(?i)\s*[-–—:]\s*[^-–—:]*\b(tour|live|residency)\b[^-–—:]*$", ""))
    dashed = F.trim(F.regexp_extract(t, r"^(.*?)\s+[-–—]\s+", 1))
    name = F.when((cut != t) & (F.char_length(cut) >= 3), cut).when(F.char_length(dashed) >= 3, dashed).when(t != "", t).otherwise(F.trim(text(title)))
    return F.when(first != "", F.when(head != "", head).otherwise(first)).otherwise(name)
