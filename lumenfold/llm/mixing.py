"""Operator 4 [native], mixing sources to target weights: a splitting tree over source blocks.

A source's documents fall into 256 blocks by hash, and those of a block into 256 parts. Its target in words is served by whole passes over the
source and, for the rest, by its blocks in a permuted order; the block in which the target is reached gives its
first documents in permuted order, the last of them in part, so that the words taken equal the rounded target.
Each block drawn (once for each pass) is a unit of quota. A tree splits the quotas among the output shards: at
each node a random half of the units, drawn without replacement, goes left, so the counts by source follow the
multivariate hypergeometric law and add up exactly. Then every source's draws, permuted, are dealt to shards by these
quotas, and each shard is shuffled by hash. All orders come from md5, so reruns agree.

Weights are 1, 2, 3, repeating over the sources by code point with null last. A target stops at ``MOST`` times
the source's size; the excess goes to the others by weight, which has the closed form of filling water: sources
by size over weight, those below the level are full.

Cases: a null text has size 0; null is a source like others; sources of size 0 have target 0; repeated rows are
documents of their own; a text of any length is one document; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
SHARD_LEVELS = 4
SHARD_WORDS = 1 << 22


def _text(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key, block) of each row, written once as later steps read it several times."""
    key = F.md5(F.concat_ws("|", _text("doc_id"), _text("source"), F.md5(_text("text"))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"))
    return written(rows.withColumn("block", F.substring("key", 1, 2)))


def source_targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, target): a row for each source; these few rows meet in one task."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    ranked = ranked.withColumn("most", F.col("source_size") * MOST).withColumn("ratio", F.col("most").cast("double") / F.col("weight"))
    filling = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most")
    left = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    levels = ranked.withColumn("level", (total - before).cast("double") / left).withColumn("place", F.row_number().over(filling))
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(Window.partitionBy())
    return levels.withColumn("level", level).select(
        "source", "source_size", F.when(F.col("ratio") <= F.col("level"), F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target")
    )


def block_plan(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, block, source_size, target, passes, rest): whole passes over a block and the words of a last, partial one."""
    t = targets.withColumn("quota", F.round("target").cast("long"))
    t = t.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("left", F.col("quota") - F.col("passes") * F.col("source_size"))
    words = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    joined = words.join(t, words["source"].eqNullSafe(t["source"])).drop(t["source"])
    drawn = Window.partitionBy("source").orderBy(F.md5(F.concat_ws("|", F.lit("draw"), _text("source"), "block")), "block")
    before = F.sum("words").over(drawn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    rest = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("left") - before))
    return joined.select("source", "block", "words", "source_size", "target", "passes", rest.alias("rest"))


def shard_plan(plan: DataFrame, levels: int = SHARD_LEVELS) -> DataFrame:
    """(source, block, pass, shard): the splitting tree over the units of quota, then the dealing of permuted draws."""
    units = plan.withColumn("pass", F.explode(F.expr("sequence(1L, passes + if(rest > 0, 1L, 0L))"))).where("passes > 0 or rest > 0").select("source", "block", "pass")
    name = F.concat_ws("|", _text("source"), "block", "pass")
    tree = units.withColumn("node", F.lit(0).cast("long"))
    for level in range(levels):
        here = Window.partitionBy("node")
        rank = F.row_number().over(here.orderBy(F.md5(F.concat_ws("|", F.lit(f"split{level}"), name)), "source", "block", "pass"))
        tree = tree.withColumn("node", F.col("node") * 2 + F.when(rank * 2 <= F.count(F.lit(1)).over(here), 0).otherwise(1))
    quota = tree.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("node"))).select("source", "turn", F.col("node").alias("shard"))
    dealt = units.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.concat_ws("|", F.lit("deal"), name)), "block", "pass")))
    return dealt.join(quota, dealt["source"].eqNullSafe(quota["source"]) & (dealt["turn"] == quota["turn"])).select(dealt["source"], "block", "pass", "shard")


def mixed(docs: DataFrame, levels: int | None = SHARD_LEVELS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards, key): a row for each row of ``docs``; shards of its passes in turn.

    With ``levels`` None there are as many shards as keep each near ``SHARD_WORDS`` words.
    """
    rows = sized(docs)
    if levels is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        levels = max(0, (total // SHARD_WORDS).bit_length())
    plan = block_plan(rows, source_targets(rows))
    shards = shard_plan(plan, levels).groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda s: s.shard).alias("shards"))
    plan = plan.join(shards.withColumnRenamed("source", "s").withColumnRenamed("block", "b"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    plan = written(plan.withColumnRenamed("source", "s").withColumnRenamed("block", "b"))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    cut = joined.where("rest > 0 and rest < words").withColumn("part", F.substring("key", 3, 2))
    sums = cut.groupBy("source", "part").agg(F.sum("size").alias("s"))  # a source has one such block
    parts = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(F.col("source").alias("ps"), F.col("part").alias("pp"), (F.sum("s").over(parts) - F.col("s")).alias("before"))
    cut = cut.join(sums, F.col("source").eqNullSafe(F.col("ps")) & (F.col("part") == F.col("pp"))).drop("ps", "pp")
    order = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("rest") - F.col("before") - F.sum("size").over(order) + F.col("size")
    cut = cut.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))).drop("part", "before")
    whole = joined.where("not (rest > 0 and rest < words)").withColumn("extra", F.when(F.col("rest") > 0, F.col("size")).otherwise(0).cast("long"))
    both = whole.unionByName(cut).withColumn("taken", F.col("passes") * F.col("size") + F.col("extra"))
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return both.select("doc_id", "size", "source_size", "target", "taken", F.slice(F.coalesce("shards", F.array().cast("array<bigint>")), F.lit(1), copies).alias("shards"), "key")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards), the shards of a document's passes joined by commas."""
    return mixed(docs).drop("key").withColumn("shards", F.array_join(F.col("shards").cast("array<string>"), ","))


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, a row for each pass, a last partial one cut after its last word; by shard."""
    key = F.md5(F.concat_ws("|", _text("doc_id"), _text("source"), F.md5(_text("text"))))
    plan = mixed(docs, None).groupBy(F.col("key").alias("k")).agg(F.sort_array(F.collect_list(F.struct("taken", "size", "shards")), asc=False).alias("plans"))
    # Equal rows, which share a key, take the key's plans in turn; the join has left them sorted by key.
    rows = docs.withColumn("k0", key).join(plan, F.col("k0") == F.col("k"))
    rows = rows.withColumn("mine", F.get("plans", F.row_number().over(Window.partitionBy("k").orderBy("k")) - 1))
    rows = rows.select(*docs.columns, "k", "mine.size", "mine.taken", F.posexplode("mine.shards").alias("pass", "shard"))
    words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)), F.lit(1), words.cast("int")), "")
    rows = rows.withColumn("text", F.when(words < F.col("size"), part).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(words < F.col("size"), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.repartition("shard").sortWithinPartitions("shard", F.md5(F.concat_ws("|", "shard", "k", "pass"))).select(*docs.columns)


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, size, key, substr(key, 1, 2) AS block FROM (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
      md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, ''))) AS key
    FROM documents)),
ranked AS (
  SELECT source, source_size, weight, 3 * source_size AS most, (3 * source_size)::DOUBLE / weight AS ratio FROM (
    SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
    FROM rows GROUP BY source)),
levels AS (
  SELECT *, row_number() OVER f AS place,
    (sum(source_size) OVER () - (sum(most) OVER f - most))::BIGINT::DOUBLE
      / (sum(weight) OVER (ORDER BY ratio DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING))::BIGINT AS level
  FROM ranked WINDOW f AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN ratio <= (SELECT min_by(level, place) FROM levels WHERE level <= ratio) THEN most::DOUBLE
    ELSE (SELECT min_by(level, place) FROM levels WHERE level <= ratio) * weight END AS target FROM levels),
quotas AS (
  SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes,
    quota - CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END * source_size AS remains
  FROM (SELECT *, round(target)::BIGINT AS quota FROM targets)),
plan AS (
  SELECT b.*, q.source_size, q.target, q.passes, greatest(0, least(words, remains - (sum(words) OVER d - words)))::BIGINT AS rest
  FROM (SELECT source, block, sum(size)::BIGINT AS words FROM rows GROUP BY ALL) b JOIN quotas q ON b.source IS NOT DISTINCT FROM q.source
  WINDOW d AS (PARTITION BY b.source ORDER BY md5('draw|' || coalesce(b.source, '') || '|' || block), block ROWS UNBOUNDED PRECEDING)),
cut AS (
  SELECT r.*, p.source_size, p.target, p.passes, p.rest, p.words,
    sum(size) OVER (PARTITION BY r.source, r.block ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source AND r.block = p.block),
units AS (SELECT source, block, pass, coalesce(source, '') || '|' || block || '|' || pass AS name FROM (
  SELECT source, block, unnest(range(1, passes + CASE WHEN rest > 0 THEN 2 ELSE 1 END)) AS pass FROM plan WHERE passes > 0 OR rest > 0)),
tree0 AS (SELECT *, 0 AS node FROM units),
@TREE@
quota AS (SELECT source, node AS shard, row_number() OVER (PARTITION BY source ORDER BY node) AS turn FROM tree@LEVELS@),
dealt AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('deal|' || name), block, pass) AS turn FROM units),
shards AS (SELECT d.source, d.block, list(q.shard ORDER BY d.pass) AS shards FROM dealt d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source AND d.turn = q.turn GROUP BY ALL),
took AS (SELECT *, (passes * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM cut)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN array_to_string(s.shards[1:((taken + size - 1) // size)], ',') ELSE '' END AS shards
FROM took t LEFT JOIN shards s ON t.source IS NOT DISTINCT FROM s.source AND t.block = s.block
"""
#: A level of the tree: at each node a random half of the units goes left.
_LEVEL = """tree{next} AS (SELECT source, block, pass, name, node * 2 + CASE WHEN 2 * row_number() OVER (PARTITION BY node ORDER BY md5('split{level}|' || name), source NULLS FIRST, block, pass)
  <= count(*) OVER (PARTITION BY node) THEN 0 ELSE 1 END AS node FROM tree{level}),"""
SQL = SQL.replace("@TREE@", "\n".join(_LEVEL.format(level=k, next=k + 1) for k in range(SHARD_LEVELS))).replace("@LEVELS@", str(SHARD_LEVELS))
