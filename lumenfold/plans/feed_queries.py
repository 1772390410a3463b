"""Queries over landed feeds: the shop's sales as a paged service with a cap, and logs of reactions as streams."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.components import new_folder, numbered, saved
from lumenfold.plans.registry import query
from lumenfold.plans.views import REACTIONS, reactions, table
from lumenfold.sources import paged
from lumenfold.streaming import stars

_CAP, _SIZE = 1000, 100
_ITEM = "id long, at string, kind string, client long"


def _answers(sales: DataFrame):
    """Pages of windows over sales (kind, at, id, client), in order of time and id; what passes the cap tells its total only."""

    def fetch(asked: DataFrame) -> DataFrame:
        w = asked.select(*[c.split()[0] for c in paged.WINDOW.split(", ")], "since", "until")
        second = F.unix_seconds(F.col("at").cast("timestamp"))
        number = paged.number_at(F.col("_second"), F.col("origin"), F.col("span"), F.col("depth"))
        spans = w.select("kind", "chunk", "origin", "span", "depth").distinct()  # at most six depths of the first windows, which the driver made
        near = sales.withColumn("_second", second).join(F.broadcast(spans), ["kind"]).where("_second >= origin and _second < origin + span").withColumn("number", number)
        inside = near.join(w.select("kind", "chunk", "depth", "number", "until", "since"), ["kind", "chunk", "depth", "number"])
        keys = ["kind", "chunk", "depth", "number"]
        totals = w.join(inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")), keys, "left").withColumn("total", F.coalesce("total", F.lit(0)))
        read = totals.where((F.col("total") <= _CAP) | (F.col("until") - F.col("since") <= 1)).select(*keys)
        listed = numbered(inside.join(read, keys).select(*keys, "at", "id", "client"), keys, ["at", "id", "client"], "place").withColumn("page", F.floor(F.col("place") / _SIZE).cast("int"))
        item = F.struct("place", F.struct("id", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "kind", "client").alias("e"))
        bodies = listed.groupBy(*keys, "page").agg(F.to_json(F.struct(F.struct(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("events")).alias("list"))).alias("body"))
        return totals.join(bodies, keys, "left").withColumn("page", F.coalesce("page", F.lit(0)))

    return fetch


@query("""WITH found AS (SELECT coalesce(status, 'none') AS kind, sale_id AS id, sold_at AS sold, coalesce(client_id, -1) AS client FROM sales WHERE sale_id IS NOT NULL AND sold_at IS NOT NULL),
placed AS (SELECT *, row_number() OVER (ORDER BY kind, sold, id, client) AS n FROM found),
kept AS (SELECT id, max_by(kind, n) AS kind, max_by(sold, n) AS sold, max_by(client, n) AS client, min(n) AS first FROM placed GROUP BY id)
SELECT row_number() OVER (ORDER BY strftime(sold, '%Y-%m-%dT%H:%M:%S'), first) AS place, id, kind, strftime(sold, '%Y-%m-%dT%H:%M:%S') AS sold, client FROM kept""")
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sales by a service that answers with at most 1,000 of a kind and a window: windows are cut again, ids read twice count once, as read last, in order of time."""
    t = table(spark, sf_dir, "sales")
    sales = saved(t.where("sale_id is not null and sold_at is not null").select(F.coalesce("status", F.lit("none")).alias("kind"), F.col("sold_at").alias("at"), F.col("sale_id").alias("id"), F.coalesce("client_id", F.lit(-1)).cast("long").alias("client")))
    kinds = [r.kind for r in sales.select("kind").distinct().collect()]  # a handful
    days = sales.agg(F.min(F.to_date("at")).alias("a"), F.datediff(F.max("at"), F.min("at")).alias("n")).first()
    pages = paged.crawl(paged.first_windows(spark, sorted(kinds), days.a or date(2024, 1, 1), (days.n or 0) + 1, 40), _answers(sales), _CAP)
    found = paged.latest(paged.records(pages, "$.list.events", _ITEM, _CAP))
    return numbered(found, [], ["at", "first_ord"], "place").select((F.col("place") + 1).alias("place"), "id", "kind", F.col("at").alias("sold"), "client")


@query(f"""WITH {REACTIONS} SELECT profile, item, max_by(kind, ord) AS kind FROM reactions WHERE kind IN ('star', 'unstar', 'hide') AND coalesce(profile, '') <> '' AND coalesce(item, '') <> '' AND ord IS NOT NULL GROUP BY ALL""")
def star_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States by a stream that knows the log up to the middle of its time and reads it as a whole: rows delivered again change nothing."""
    log = saved(reactions(spark, sf_dir).select("profile", "item", "ord", "kind", "ts"))
    own = stars.with_ordered_state(spark)
    rows = own.read.schema(log.schema).parquet(log._saved_at)
    middle = rows.select(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("t"))  # one row
    known = saved(stars.last_rows(rows.join(F.broadcast(middle), F.col("ts") <= F.col("t"))))
    changes = stars.read_all(stars.state_changes(own.readStream.schema(log.schema).parquet(log._saved_at), known), new_folder(own))
    found = saved(stars.last_rows(known.unionByName(changes)).select("profile", "item", "kind"))
    return spark.read.schema(found.schema).parquet(found._saved_at)
