"""Operator 11, ranking with ties in groups: the rows of every group's first places, by a distributed multi-select.

``encoded`` turns a pair of values into one number in the order of pairs. ``first_places`` looks for every group's last pair to return by
binary search in the space of those numbers, for all groups at once: an exact count pass tells, by group, how many distinct pairs lie up to
each point that the next ``HALVINGS`` halvings may ask for, and the group's interval shrinks to the part that holds the pair sought. Groups
whose interval is one pair, or ends right after the last place, are settled and need no further pass, so there are at most 62 / ``HALVINGS`` passes (124 /
``HALVINGS`` where numbers are decimals). The cut filters rows before they are sorted by ranges over all groups, and a row's position
comes from its place in that order: counts of whole partitions before it, less the place of its pair's first row.

Nothing that grows with the rows meets in one task. Distinct pairs are counted before they are shuffled. Groups with more than one row of ``HEAVY`` are
fewer than ``HEAVY``, so they may be broadcast: their pairs and rows are dealt by ``SALTS`` salts, of which all others use one. Rows of one pair, equal
rows too, are split by the range sort, for which a row's number breaks ties. The driver sees the ends of the pairs' values, one count a pass, and one number a partition.

Cases: groups and pairs are what they are after the caller's own rules for nulls (``encoded`` puts nulls last and makes them equal). Nulls in the columns
that order the rows of a pair are last. Equal rows are rows each, with positions in any order, which can't be told apart. A group with fewer pairs than
places is returned whole; an empty table gives an empty one. Columns that are not named go; names of the operator's own columns may not be among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import written

#: Halvings of every group's interval that one count pass settles.
HALVINGS = 3
#: A group with more than one row of so many is split; there are fewer such groups than this.
HEAVY = 1024
#: Parts that such a group is split into.
SALTS = 64


def encoded(rows: DataFrame, keys: list[tuple[str, bool]], name: str = "code") -> DataFrame:
    """``rows`` with a number that orders them by the whole-number columns ``keys``, each (column, larger first); nulls are last and equal.

    The number is a long where the columns' ranges allow, or else a decimal; a ValueError is raised beyond 31 digits, which no int and long together need.
    """
    ends = rows.agg(*[f(c).cast("decimal(38,0)").alias(f"{k}_{c}") for c, _ in keys for k, f in (("low", F.min), ("high", F.max))]).first()
    spans = {c: (int(ends[f"low_{c}"] or 0), int(ends[f"high_{c}"] or 0)) for c, _ in keys}
    size = 1
    for low, high in spans.values():
        size *= high - low + 2
    if size >= 10**31:  # quotients of decimals have six more digits after the point
        raise ValueError("the columns' ranges are too wide for one number of 31 digits")
    kind = "long" if size < 2**61 and all(abs(x) < 2**61 for span in spans.values() for x in span) else "decimal(38,0)"
    number = lambda x: F.lit(str(x)).cast(kind)
    code = number(0)
    for c, larger in keys:
        low, high = spans[c]
        place = number(high) - F.col(c).cast(kind) if larger else F.col(c).cast(kind) - number(low)
        code = (code * number(high - low + 2) + F.coalesce(place, number(high - low + 1))).cast(kind)
    return rows.withColumn(name, code)


def _parts(large: Column) -> Column:
    """The salts of a group: all of them where it is split."""
    return F.explode(F.when(large, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))


def _dealt(rows: DataFrame, heavy: DataFrame, group: list[str], by: Column) -> DataFrame:
    """``rows`` with the salt that ``by`` gives them in the groups of ``heavy``, 0 in others."""
    split = rows.join(F.broadcast(heavy), group, "left")  # fewer than HEAVY rows
    return split.withColumn("salt", F.when(F.col("large"), F.pmod(by, F.lit(SALTS)).cast("int")).otherwise(0))


def cuts(pairs: DataFrame, groups: DataFrame, group: list[str], places: int) -> list[DataFrame]:
    """(group, large, cut): the number that the first ``places`` distinct pairs of each group are up to, in tables to be read together.

    ``pairs`` has (group, code, n); ``groups`` has for each (large, lo, hi, distinct).
    """
    heavy = groups.where("large").select(*group, "large")
    spread = _dealt(pairs.select(*group, "code"), heavy, group, F.xxhash64("code")).drop("large")
    settled = [groups.where(F.col("distinct") <= places).select(*group, "large", F.col("hi").alias("cut"))]
    searched = groups.where(F.col("distinct") > places).select(*group, "large", "lo", "hi", F.lit(0).cast("long").alias("below"))
    parts = 1 << HALVINGS
    kind = pairs.schema["code"].dataType
    width = F.expr(f"(hi - lo) div {parts} + 1" if kind.typeName() == "long" else f"cast(floor((hi - lo) / {parts}) + 1 as decimal(38,0))")
    while searched.select(F.count(F.lit(1))).first()[0]:
        asked = searched.withColumn("salt", _parts(F.col("large"))).hint("shuffle_hash")
        inside = spread.join(asked, [*group, "salt"]).where("code between lo and hi").withColumn("width", width).withColumn("part", F.expr("(code - lo) div width"))
        counted = inside.groupBy(*group, "large", "lo", "hi", "below").agg(*[(F.col("below") + F.count(F.when(F.col("part") <= k, 1))).alias(f"upto{k}") for k in range(parts)])
        upto = F.array(F.col("below"), *[F.col(f"upto{k}") for k in range(parts)])
        chosen = sum((F.col(f"upto{k}") < places).cast("int") for k in range(parts))
        told = counted.select(*group, "large", "lo", "hi", width.alias("width"), upto.alias("upto"), chosen.alias("chosen"))
        told = told.select(
            *group, "large", (F.col("lo") + F.col("chosen") * F.col("width")).cast(kind).alias("lo"),
            F.least("hi", (F.col("lo") + (F.col("chosen") + 1) * F.col("width") - 1).cast(kind)).alias("hi"), F.col("upto")[F.col("chosen")].alias("below"), F.col("upto")[F.col("chosen") + 1].alias("reached"),
        )
        told = written(told.withColumn("done", (F.col("lo") >= F.col("hi")) | (F.col("reached") == places)))
        settled.append(told.where("done").select(*group, "large", F.col("hi").alias("cut")))
        searched = told.where("not done").select(*group, "large", "lo", "hi", "below")
    return settled


def _numbered(rows: DataFrame, by: list) -> DataFrame:
    """``rows`` sorted over all partitions by ``by``, with ``at``: the partition's number above 33 bits of the place in it."""
    return written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))


def _before(rows: DataFrame, count: Column) -> DataFrame:
    """(part, ahead): what ``count`` gives over the partitions before each, a row a partition."""
    found, total = [], 0
    for part, n in sorted(rows.groupBy(F.shiftright("at", 33)).agg(count).collect()):
        found.append((part, total))
        total += n
    return F.broadcast(rows.sparkSession.createDataFrame(found, "part long, ahead long"))


def first_places(rows: DataFrame, group: list[str], order: list[str], places: int = 5) -> DataFrame:
    """The rows of ``rows`` whose place in their group is at most ``places``: (group, code, order, pos, place, tied).

    ``group``: whole-number columns without nulls; ``code``: the number of a row's pair; ``order``: what orders rows of a pair. ``place`` is 1 and the
    group's distinct smaller pairs, ``pos`` counts the group's rows by pair and ``order``, ``tied`` is how many of the group's rows have the pair.
    """
    pairs = written(rows.groupBy(*group, "code").agg(F.count(F.lit(1)).alias("n")))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    groups = written(
        pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("distinct"), F.min("code").alias("lo"), F.max("code").alias("hi"), (F.sum("n") > total / HEAVY).alias("large"))
    )
    found = cuts(pairs, groups, group, places)
    cut = found[0]
    for more in found[1:]:
        cut = cut.union(more)
    heavy = cut.where("large")
    first = _dealt(pairs, heavy.drop("cut"), group, F.xxhash64("code")).drop("large").join(cut.withColumn("salt", _parts(F.col("large"))).hint("shuffle_hash"), [*group, "salt"]).where("code <= cut")
    ranked = Window.partitionBy(*group).orderBy("code")
    earlier = F.coalesce(F.sum("n").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select(*group, "code", "large", F.row_number().over(ranked).cast("long").alias("place"), earlier.alias("earlier"), F.col("n").alias("tied"))
    first = _numbered(written(first), [*group, "code"])
    part = F.shiftright("at", 33).alias("part")
    upto = F.sum("tied").over(Window.partitionBy("part").orderBy("at"))
    first = first.withColumn("part", part).withColumn("upto", upto).join(_before(first, F.sum("tied")), "part").select(*group, "code", "large", "place", "earlier", "tied", (F.col("ahead") + F.col("upto") - F.col("tied")).alias("start"))
    kept = _dealt(rows.select(*group, "code", *order), heavy, group, F.monotonically_increasing_id()).where("cut is null or code <= cut").drop("large", "cut")
    kept = kept.join(first.withColumn("salt", _parts(F.col("large"))).drop("large").hint("shuffle_hash"), [*group, "code", "salt"]).drop("salt")
    kept = written(kept.withColumn("row", F.monotonically_increasing_id()))
    sorted_rows = _numbered(kept, [*group, "code", *[F.col(c).asc_nulls_last() for c in order], "row"])
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    out = sorted_rows.withColumn("part", part).join(_before(sorted_rows, F.count(F.lit(1))), "part")
    return out.select(*group, "code", *order, (F.col("earlier") + F.col("ahead") + place - F.col("start") + 1).alias("pos"), "place", "tied")


def _whole(x: Column) -> Column:
    """floor(100 * x + 0.5) as a long; null where ``x`` is null, isn't finite or too large for one."""
    scaled = F.floor(100 * x + F.lit(0.5))
    return F.when(F.abs(x) < 9e16, scaled)


def ranked_lines(lines: DataFrame) -> DataFrame:
    """The lines of the first five places by vendor, part and month of ``sale_lines``; sales whose id's crc32 is divisible by 5 form one group.

    A null vendor is a group's vendor like others; ``part`` is 0 or 1 of items below 0 too; discounts and amounts that aren't finite count as null; a null percent
    comes after all others.
    """
    one = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    month = F.coalesce(100 * F.year("shipped_at").cast("long") + F.month("shipped_at"), F.lit(-1))
    part = F.coalesce(F.pmod(F.col("item_id").cast("long"), F.lit(2)), F.lit(-1))
    long = lambda c: F.col(c).cast("long").alias(c)
    # One number for part, month and whether the vendor is null, so that groups are two numbers without nulls.
    tags = F.when(one, F.lit(0)).otherwise(((month + 1) * 4 + part + 1) * 2 + F.col("vendor_id").isNull().cast("long"))
    rows = lines.select(
        F.when(one, F.lit(-1)).otherwise(F.coalesce(long("vendor_id"), F.lit(0))).cast("long").alias("vendor"), tags.cast("long").alias("tags"), long("sale_id"), long("line_no"), long("quantity"),
        _whole(F.col("amount")).alias("amount_cents"), _whole(F.col("discount")).alias("percent"), F.floor(F.col("quantity") / 10).cast("long").alias("tens"),
    )
    rows = encoded(rows, [("tens", True), ("percent", False)])
    # A pair's percent is the same on all its lines, so to order by it changes nothing and carries it along.
    out = first_places(rows, ["vendor", "tags"], ["sale_id", "line_no", "quantity", "amount_cents", "percent"])
    half = F.expr("tags div 2")
    return out.select(
        F.when(F.col("tags") % 2 == 0, F.col("vendor")).alias("vendor_id"), (half % 4 - 1).alias("part"), (F.expr("tags div 8") - 1).alias("month"),
        "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied",
    )


#: A sale's crc32, by a table made from its polynomial; then the contract's ranking.
SQL = """WITH bytes AS (SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256))::BIGINT AS i)),
ids AS (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL),
one AS (SELECT sale_id FROM ids, bytes WHERE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 5 = 0),
told AS (SELECT o.sale_id IS NOT NULL AS merged, l.vendor_id, coalesce(((l.item_id % 2) + 2) % 2, -1)::BIGINT AS part, coalesce(100 * year(l.shipped_at) + month(l.shipped_at), -1)::BIGINT AS month, l.sale_id, l.line_no::BIGINT AS line_no, l.quantity::BIGINT AS quantity,
  CASE WHEN abs(discount) < 9e16 THEN floor(100 * discount + 0.5)::BIGINT END AS percent, CASE WHEN abs(amount) < 9e16 THEN floor(100 * amount + 0.5)::BIGINT END AS amount_cents, floor(quantity / 10)::BIGINT AS tens FROM sale_lines l LEFT JOIN one o ON l.sale_id = o.sale_id),
grouped AS (SELECT CASE WHEN merged THEN -1 ELSE vendor_id END::BIGINT AS vendor_id, CASE WHEN merged THEN -1 ELSE part END::BIGINT AS part, CASE WHEN merged THEN -1 ELSE month END::BIGINT AS month, sale_id, line_no, quantity, percent, amount_cents, tens FROM told),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
  dense_rank() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST) AS place, count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied FROM grouped)
SELECT vendor_id, part, month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied FROM ranked WHERE place <= 5"""
