"""Views that give the supplied tables the shapes of a listing catalogue; each with its DuckDB spelling."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.components import partitions, sides

TODAY = date(1998, 6, 1)
SQL_TODAY = "DATE '1998-06-01'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What stands for a listing's category, by kind of part.
CATEGORIES = {"ECONOMY": "film", "PROMO": "electronic", "SMALL": "comedy", "LARGE": "music", "MEDIUM": "market", "STANDARD": "general"}


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing for each order line: a part on the day of the order at a supplier's. Where lines and orders are many, an order's stand in one of as many partitions as they ask for."""
    li, orders, part = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    supplier, nation = (table(spark, sf_dir, n) for n in ("supplier", "nation"))
    n = partitions(li)
    lines, parts = sides(li, "l_partkey", part, "p_partkey", n)
    lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == supplier["s_suppkey"]).join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    lines, orders = sides(lines, "l_orderkey", orders, "o_orderkey", n)
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    number = ((F.col("l_orderkey") * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    by_type = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return joined.select(
        number.alias("id"), F.col("p_name").alias("title"), F.to_date("o_orderdate").alias("day"),
        F.concat(F.lpad((F.col("l_partkey") % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad(((F.col("l_suppkey") % 4) * 15).cast("string"), 2, "0")).alias("start"),
        F.col("s_name").alias("venue"), F.col("n_name").alias("neighborhood"), F.element_at(by_type, F.col("p_type")).alias("category"), F.col("o_orderpriority").alias("source"),
        F.col("l_extendedprice").alias("amount"), F.col("l_linestatus").alias("line"), F.to_date("l_shipdate").alias("last_seen"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").alias("quantity"), F.col("o_custkey").alias("cust"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").cast("long").alias("place"), F.col("n_nationkey").cast("long").alias("nation"),
    )


LISTING = """listing AS (
  SELECT ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS id, p_name AS title, o_orderdate::DATE AS day,
    lpad((l_partkey % 24)::VARCHAR, 2, '0') || ':' || lpad(((l_suppkey % 4) * 15)::VARCHAR, 2, '0') AS start, s_name AS venue, n_name AS neighborhood,
    CASE p_type WHEN 'ECONOMY' THEN 'film' WHEN 'PROMO' THEN 'electronic' WHEN 'SMALL' THEN 'comedy' WHEN 'LARGE' THEN 'music' WHEN 'MEDIUM' THEN 'market' WHEN 'STANDARD' THEN 'general' END AS category,
    o_orderpriority AS source, l_extendedprice AS amount, l_linestatus AS line, l_shipdate::DATE AS last_seen, l_partkey AS part, l_suppkey AS supp,
    l_quantity AS quantity, o_custkey AS cust, l_orderkey AS ord, l_linenumber::BIGINT AS place, n_nationkey::BIGINT AS nation
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of reactions: a person, an item of a hundred, a kind, in the order of the log."""
    kinds = {"purchase": "star", "view": "unstar", "error": "hide", "click": "less", "signup": "seen"}
    by_type = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("profile"), F.get_json_object("props", "$.k").alias("item"),
        F.element_at(by_type, F.col("event_type")).alias("kind"), "ts", "event_type",
    )


REACTIONS = """reactions AS (
  SELECT event_id AS ord, user_id::VARCHAR AS profile, json_extract_string(props, '$.k') AS item, event_type, ts,
    CASE event_type WHEN 'purchase' THEN 'star' WHEN 'view' THEN 'unstar' WHEN 'error' THEN 'hide' WHEN 'click' THEN 'less' WHEN 'signup' THEN 'seen' END AS kind FROM events)"""
