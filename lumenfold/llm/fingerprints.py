"""Operator 2 [native], document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ascending array of the ``K`` smallest distinct 60-bit hashes of a text's five-word shingles (words
as runs outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z; a text of fewer words is one shingle). Sketches of parts merge
into the sketch of the union. With tau the largest hash up to which both sketches are complete, the hashes up to
tau are a random sample of the union, from which resemblance and containment are read; texts of fewer than ``K``
shingles are compared exactly. All is built from SQL functions; higher-order functions keep a text in its row.

Cases: a null text is empty; an empty text has the empty sketch and the empty string as fingerprint, is fully like
another empty one and not at all like a text with words. Documents follow each other by descending id, null last;
rows with one id by hash of the text, over many tasks where an id (or null) is common, unless its texts are all equal; a single row is its own successor. Texts of any length are read whole; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
BITS = 60
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents in a range of ids at least, and about how many ranges at most; beyond it ranges grow, and their sorts spill.
RANGE_ROWS, RANGES = 512, 1 << 20
QUANTILES = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for all places where body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column, k: int = K, words: int = 5) -> Column:
    """The bottom-k sketch (array<bigint>) of a text."""
    found = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    hashes = F.transform(found, lambda w: F.xxhash64(w))
    cut = lambda x: F.shiftrightunsigned(x, 64 - BITS)
    many = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: cut(F.xxhash64(*[F.get(h, i + j) for j in range(words)])))
    few = lambda h: F.array(cut(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x))))
    none = F.array().cast("array<bigint>")
    shingles = let(hashes, lambda h: F.when(F.size(h) >= words, many(h)).when(F.size(h) > 0, few(h)).otherwise(none))
    return F.coalesce(F.slice(F.sort_array(F.array_distinct(shingles)), 1, k), none)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles; exact below ``k``."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit((k - 1) * 2.0**BITS) / F.element_at(s, k))


def _upto(a: Column, b: Column, k: int) -> Column:
    end = lambda s: F.when(F.size(s) >= k, F.element_at(s, k)).otherwise(F.lit(2**63 - 1))
    return F.least(end(a), end(b))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated Jaccard index of two texts' shingles, from 0 to 1."""
    both = let(_upto(a, b, k), lambda t: F.struct(F.size(F.filter(F.array_intersect(a, b), lambda x: x <= t)).alias("i"), F.size(F.filter(F.array_union(a, b), lambda x: x <= t)).alias("u")))
    return let(both, lambda n: F.when(n.u == 0, F.lit(1.0)).otherwise(n.i / n.u))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of the first text's shingles that the second has."""
    both = let(_upto(a, b, k), lambda t: F.struct(F.size(F.filter(F.array_intersect(a, b), lambda x: x <= t)).alias("i"), F.size(F.filter(a, lambda x: x <= t)).alias("u")))
    return let(both, lambda n: F.when(n.u == 0, F.lit(1.0)).otherwise(n.i / n.u))


def encoded(s: Column) -> Column:
    """A sketch as a string of 15 hexadecimal digits a hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def _by_range(docs: DataFrame) -> DataFrame:
    """``docs`` with ``range``, numbers that ascend with doc_id (null lowest), each for a bounded share of the rows, and ``hash`` in the ranges of common ids.

    An id that quantiles repeat, and null, has ranges of its own by its texts' hashes, as many as its share of the rows asks for.
    """
    steps = [i / QUANTILES for i in range(QUANTILES + 1)]
    n, known, least, ends = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.min("doc_id"), F.percentile_approx("doc_id", steps, 10_000)).first()
    ends = [] if least is None else [least, *ends]
    common = {x: ends.count(x) for x in ends if ends.count(x) > (2 if x == least else 1)}
    lowest = sorted({*ends, *[x + 1 for x in common if x < 2**63 - 1]})
    parts = max(1, min(n // RANGE_ROWS, RANGES) // (len(lowest) + 1))
    nulls = -(-(n - known) * QUANTILES // n) if n else 0
    widths = [max(1, -(-(b - a) // parts)) for a, b in zip(lowest, lowest[1:], strict=False)] + [2**62]
    # By place in ``lowest``, null's being 0: how many ranges an id's hashes are dealt over, none where ids are.
    dealt = [parts * nulls] + [parts * common.get(x, 0) for x in lowest]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    docs = docs.withColumn("at", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), F.size(F.filter(longs(lowest), lambda x: x <= F.col("doc_id"))))))
    inside = F.lit(0)
    if lowest:
        inside = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id") - F.try_element_at(longs(lowest), F.greatest(F.lit(1), "at"))) / F.element_at(longs(widths), F.greatest(F.lit(1), "at")))))
    if not any(dealt):
        return docs.select("*", (F.col("at") * parts + inside).alias("range"), F.lit(None).cast("long").alias("hash")).drop("at")
    docs = docs.withColumn("over", F.get(longs(dealt), F.col("at")))
    docs = docs.withColumn("hash", F.when(F.col("over") > 0, F.xxhash64("text")))
    by_hash = F.col("over") - 1 - F.shiftright((F.shiftright("hash", 33) + F.lit(1 << 30)) * F.col("over"), 31)
    return docs.withColumn("range", F.col("at") * max(parts, *dealt) + F.when(F.col("over") > 0, by_hash).otherwise(inside)).drop("at", "over")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sketch, next) of each row, next being the struct (text, sketch) of the next row by descending id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = _by_range(docs)
    # As many rows as ranges (each range's first one), a bounded number: which range's first row follows the last row of a range.
    tops = ranged.groupBy("range").agg(F.max("doc_id").alias("top"), F.min("hash").alias("lowest"))
    order = Window.orderBy("range")
    around = F.coalesce(F.lead("range").over(order), F.first("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = tops.select(F.col("range").alias("r"), "top", "lowest", around.alias("for"))
    first = F.col("doc_id").eqNullSafe(F.col("top")) & F.col("hash").eqNullSafe(F.col("lowest"))
    heads = ranged.join(F.broadcast(tops), (F.col("range") == F.col("r")) & first)
    heads = heads.groupBy("for").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("h"))
    heads = heads.select(F.col("for").alias("range"), F.col("h.text").alias("head")).withColumn("head", F.struct(F.col("head").alias("text"), sketch(F.col("head")).alias("sketch")))
    here = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    rows = ranged.drop("hash").withColumn("sketch", sketch(F.col("text"))).withColumn("next", F.lead(F.struct("text", "sketch")).over(here))
    return rows.join(heads, "range", "left").select("doc_id", "text", "sketch", F.coalesce("next", "head").alias("next"))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles) of each row."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars") - half), F.substr("next.text", F.lit(1), half))
    rows = rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("after"), edited.alias("edited"))
    rows = rows.withColumn("e", let(sketch(F.col("edited")), lambda e: F.struct(encoded(e).alias("code"), resemblance(F.col("sketch"), e).alias("near"))))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), encoded(F.col("sketch")).alias("fingerprint"), F.col("e.code").alias("edited_fingerprint"),
        F.col("e.near").alias("near_edited"), resemblance(F.col("sketch"), F.col("after")).alias("near_next"), distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )
