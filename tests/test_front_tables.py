"""The tables of the front page share one pass over the listings."""

from lumenfold.plans import registry

SF = "/root/testdata/sf0.001"


def test_listings_are_read_once_for_all_tables(spark):
    tables = registry.queries()["front_tables"](spark, SF)
    assert not [f for f in tables.inputFiles() if f.startswith(f"file://{SF}/")]  # each table would read and tag them anew
    assert tables.count() > 0
