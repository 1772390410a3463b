"""The search index against each line's own scan."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import search
from lumenfold.operators.search_index import SearchIndex

WORDS = ["art", "party", "night", "a", "dj", "djs", "Ann", "anna", "R&B", "öl", "the", "theatre", "x-ray", "smart", "12th"]


@pytest.fixture(scope="module")
def catalogue(spark):
    rnd = random.Random(3)
    some = lambda k: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, k)))
    rows = [(i, some(4), [some(2), None], some(2)) for i in range(150)]
    rows += [(150 + i, "the the the", ["dj"], "hall") for i in range(80)]  # a word that a third of all rows have
    rows += [(7, "another art fair", None, None), (None, "art", ["art"], "art"), (400, None, None, None), (401, "", [], "")]
    return spark.createDataFrame(rows, "key long, title string, lineup array<string>, venue string")


def lines(n, seed):
    rnd = random.Random(seed)
    out = [None, "", "!!", "a", "the", "dj the", "the the", "zzz", "art zzz", "rt nig", "t party n", "RANDB", "Ann, ann", "night night a"]
    for _ in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(1, 4))]
        words[0] = words[0][rnd.randint(0, 1):] or "a"
        words[-1] = words[-1][: rnd.randint(1, 5)]
        out.append(" ".join(words))
    return out


def test_equals_a_scan_for_each_line(spark, catalogue, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), buckets=8, parts=3)
    index.write(catalogue)
    asked = lines(40, 5)
    rows = spark.createDataFrame([(x,) for x in asked + asked[:5]], "line string")
    got = sorted((r.line, r.key) for r in index.search(rows).collect())
    hays = [(r.key, r.hay) for r in catalogue.select("key", search.haystack(catalogue).alias("hay")).collect() if r.key is not None]
    norm = {r.line: r.p for r in rows.select("line", search.normalized("line").alias("p")).collect()}
    want = sorted({(x, k) for x, p in norm.items() if x is not None and p for k, h in hays if p in h or set(p.split()) <= set(h.split())})
    assert got == want and len(got) > 500
    one = {r.key for r in search.matching_rows(catalogue, "rt nig").where("key is not null").collect()}
    assert one == {k for x, k in got if x == "rt nig"}


def test_reads_only_the_buckets_asked_for(spark, catalogue, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), buckets=32, parts=2)
    index.write(catalogue)
    phrases = spark.createDataFrame([("the x ray",)], "phrase string")
    asked = index.asked(phrases)
    assert {r.word for r in asked.collect()} <= {"ray", "x ray", "the x"} and asked.where("word = 'ray'").count() == 1  # as rare as "x", and first by letters
    found = index.postings(asked)
    files = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_bucket#" in plan.split("PushedFilters")[0] and 1 <= len(files) <= 4 < len(found.inputFiles())


def test_empty_tables(spark, catalogue, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), buckets=4)
    index.write(catalogue)
    assert index.search(spark.createDataFrame([], "line string")).count() == 0
    index.write(catalogue.limit(0))
    assert index.search(spark.createDataFrame([("art",)], "line string")).count() == 0


def test_priced_rows(spark):
    from datetime import date

    rows = [("k1", date(2026, 6, 2), "Jazz", "Blue Hall", None), ("k2", date(2026, 6, 1), "Jazz", "Hall", "unlisted"), ("k3", date(2026, 5, 1), "Jazz", "Hall", None), ("k4", date(2026, 6, 1), "Hall jazz", "", None)]
    e = spark.createDataFrame(rows, "key string, day date, title string, venue string, status string")
    assert [r.key for r in search.priced_rows(e, "hall jazz", date(2026, 6, 1)).collect()] == ["k4", "k1"]


def test_nothing_of_the_index_is_broadcast(spark, catalogue, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), 4, 2)
    index.write(catalogue)
    typed = spark.createDataFrame([("dj the",), ("part",)], "line string")
    for plan in (index.asked(typed.select(F.col("line").alias("phrase"))), index.search(typed)):
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
        assert plan.count() > 0
