"""Connected components of links between numbers, set-wise."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="catalogue-")


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:  # a local session without one: a folder for the process, as the setting can't be changed once a session runs
        base = _own_folder()
    return f"{base.rstrip('/')}/catalogue-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all executors share, and read back: its lineage ends there."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._saved_at = path
    return back


def discarded(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` returned and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._saved_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows of a partition, about, where a table has more of them than the session's partitions would hold.
PART_ROWS = 500_000
#: Rows of a table that may still be small enough for a broadcast, which is left to the optimizer.
FEW_ROWS = 2_000_000


def partitions(table: DataFrame) -> int:
    """How many partitions the rows of ``table`` ask for, a table of files (their count is read of these alone); 0 where the session's are enough."""
    n = -(-table.count() // PART_ROWS)
    return n if n > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


def dealt(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """``rows`` by ``by`` over ``n`` partitions, so that a task's share doesn't grow with them; as they are if ``n`` is 0."""
    return rows.repartition(n, *by) if n else rows


def sides(rows: DataFrame, by: str, other: DataFrame, other_by: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join: ``rows`` and a table of files, ``other``, dealt over ``n`` partitions where that is too large for a broadcast."""
    if n and other.count() > FEW_ROWS:
        return dealt(rows, n, by), dealt(other, n, other_by)
    return rows, other


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str = "number") -> DataFrame:
    """``rows`` with their place, from 0, within rows that are equal in ``by`` (all rows, if empty), in ``order``.

    One sort by ranges over all rows; the driver gets one count a partition. A group may span any number of partitions. Rows that are equal in
    ``order`` stay in one partition, in any order.
    """
    rows = saved(rows)  # read twice: for the ranges, and to be sorted
    n = partitions(rows)
    ranges = rows.repartitionByRange(*([n] if n else []), *by, *order)
    at = saved(ranges.sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id()))
    discarded(rows)
    part, ahead, total = F.shiftright("_at", 33), [], 0
    for k, n in sorted(at.groupBy(part).count().collect()):
        ahead.append((k, total))
        total += n
    starts = at.sparkSession.createDataFrame(ahead, "_part long, _ahead long")
    placed = at.join(F.broadcast(starts), part == F.col("_part")).withColumn("_place", F.col("_ahead") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))  # a row a partition
    if by:
        first = placed.groupBy(*by).agg(F.min("_place").alias("_first"))
        placed = placed.join(first, by).withColumn("_place", F.col("_place") - F.col("_first"))
    return placed.select(*rows.columns, F.col("_place").alias(name))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b); the component is its smallest node. Labels spread until no link joins two of them.

    Each round links every label to the least one next to it and follows these links once; rounds grow with the
    logarithm of a path, and each round's labels are written to the shared folder.
    """
    edges = saved(edges.where("a <> b").select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = saved(nodes.withColumn("component", F.col("node")))
    while True:
        a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        across = edges.join(a, "a").join(b, "b").where("ca <> cb").select(F.greatest("ca", "cb").alias("high"), F.least("ca", "cb").alias("low"))
        found = least = saved(across.groupBy("high").agg(F.min("low").alias("low")))
        if not least.limit(1).count():
            discarded(edges, found)
            return labels
        hop = least.select(F.col("high").alias("low"), F.col("low").alias("lower"))
        least = least.join(hop, "low", "left").select("high", F.coalesce("lower", "low").alias("to"))
        moved = labels.join(least, labels["component"] == least["high"], "left")
        before, labels = labels, saved(moved.select("node", F.coalesce("to", "component").alias("component")))
        discarded(before, found)
