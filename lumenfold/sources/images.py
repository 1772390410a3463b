"""Choosing an image address that a page can show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.text import col, text

_UNSAFE = r"""[\s"'<>\\`()]"""


def clean(url: str | Column) -> Column:
    """A secure address of at most 2048 letters without unsafe signs, else null; "//" counts as secure."""
    u = F.trim(text(url))
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    return F.when(u.startswith("https://") & (F.char_length(u) <= 2048) & ~u.rlike(_UNSAFE), u)


def first_clean(urls: str | Column) -> Column:
    return F.get(F.filter(F.transform(col(urls), lambda u: clean(u)), lambda u: u.isNotNull()), F.lit(0))


def largest(images: str | Column) -> Column:
    """Of structs (url, width, height) the clean one of the largest area, of equals the last."""
    kept = F.filter(F.transform(col(images), lambda x, i: F.struct((F.coalesce(x["width"], F.lit(0)) * F.coalesce(x["height"], F.lit(0))).alias("area"), i.alias("i"), clean(x["url"]).alias("url"))), lambda x: x["url"].isNotNull())
    return F.array_max(kept)["url"]


def ranked(images: str | Column) -> Column:
    """Of structs (url, ratio, width) a clean wide one (16:9) of the largest width, else any of the largest width."""
    kept = F.filter(F.transform(col(images), lambda x: F.struct((x["ratio"] == "16_9").alias("wide"), F.coalesce(x["width"], F.lit(0)).alias("width"), clean(x["url"]).alias("url"))), lambda x: x["url"].isNotNull())
    return F.array_max(kept)["url"]
