"""Tables of more rows than the session's partitions hold are dealt over more of them, with the same results."""

from pyspark.sql import functions as F

from lumenfold.operators import components
from lumenfold.plans import registry

SF = "/root/testdata/sf0.001"


def test_a_large_listing_is_dealt_over_more_partitions(spark, monkeypatch):
    ask = registry.queries()
    some = ("haversine_leg", "group_matrix", "rank_blend", "link_components", "venue_block_pairs")
    before = {name: sorted(map(str, ask[name](spark, SF).collect())) for name in some}
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 50)
    monkeypatch.setattr(components, "PART_ROWS", 50)
    monkeypatch.setattr(components, "FEW_ROWS", 0)
    assert ask["haversine_leg"](spark, SF).rdd.getNumPartitions() == n
    assert {name: sorted(map(str, ask[name](spark, SF).collect())) for name in some} == before


def test_a_large_ranking_is_dealt_over_more_partitions(spark, monkeypatch):
    monkeypatch.setattr(components, "PART_ROWS", 10)
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"))
    found = components.numbered(rows, [], ["id"], "place")
    assert found.select(F.input_file_name().alias("f")).distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.where("id <> place").count() == 0 and found.count() == 1000
