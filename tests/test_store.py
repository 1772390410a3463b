"""Stores in versions: merges against dicts, runs that are repeated or stopped, what a merge and a comparison read, stamps."""

import random

from pyspark.sql import functions as F

from lumenfold.operators import store as st


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, v int, ord int")


def test_merges_equal_dicts(spark, tmp_path):
    r = random.Random(4)
    for name, fold in (("last", st.last_wins("id", "ord")), ("first", st.first_stays("id", "ord"))):
        kept, want = st.Store(spark, str(tmp_path / name), "id", 5), {}
        for version in (1, 2, 3):
            rows = [(f"k{r.randrange(12)}" if i else None, r.randrange(100), version * 100 + i) for i in range(9 if version > 1 else 20)]
            rows = rows if version > 1 else list({x[0]: x for x in rows}.values())
            (kept.publish(table(spark, rows), 1) if version == 1 else kept.merge(table(spark, rows), version, fold))
            before, now = dict(want), {}
            for x in rows:
                now[x[0]] = x if name == "last" else now.get(x[0], x)
            want = before | now if name == "last" else now | before
            got = kept.read().collect()
            assert {x.id: tuple(x) for x in got if x.id is not None} == {k: v for k, v in want.items() if k is not None}
        assert kept.versions() == [1, 2, 3]


def test_a_version_is_there_as_a_whole_or_not_at_all(spark, tmp_path):
    kept = st.Store(spark, str(tmp_path / "s"), "id", 4)
    kept.publish(table(spark, [(f"k{i}", i, i) for i in range(40)]), 1)
    table(spark, [("k1", -1, 0)]).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(str(tmp_path / "s/data/2"))  # a run that was stopped
    assert kept.versions() == [1] and kept.read().count() == 40
    kept.merge(table(spark, [("k3", 99, 1)]), 2, st.last_wins("id", "ord"))
    kept.merge(table(spark, [("k3", 55, 1)]), 2, st.last_wins("id", "ord"))  # published already
    assert {x.id: x.v for x in kept.read().collect()} == {f"k{i}": i for i in range(40)} | {"k3": 99}
    assert {x.id: x.v for x in kept.read(1).collect()}["k3"] == 3
    assert len(kept.differing(1, 2)) == 1 and [tuple(x) for x in kept.changes(1, 2).collect()] == [("k3", "changed")]
    assert sum(folder == 2 for folder, _, _ in kept.manifest(2).values()) == 1
    kept.merge(table(spark, [("new", 1, 1), ("k3", 3, 3)]), 3, lambda old, batch: old.where("id <> 'k3'").union(batch.where("id = 'new'")))
    assert sorted(map(tuple, kept.changes(2, 3).collect())) == [("k3", "removed"), ("new", "added")]
    kept.merge(table(spark, []), 4, st.last_wins("id", "ord"))
    assert kept.differing(3, 4) == set() and kept.read(4).count() == 40 and kept.changes(3, 4).count() == 0
    plan = kept.read(3, {1})._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan


def test_stamps_and_rules(spark):
    rows = [("a", (5, -1, "x"), [("Ann!", "sings"), ("", "no")], 1), ("", (1, 1, "2"), [], 2), ("b", None, [("ann!", "other"), ("Bo", "plays")], 3)]
    results = spark.createDataFrame(rows, "id string, card struct<draw:int,rarity:int,lineup_depth:string>, artist_notes array<struct<name:string,note:string>>, ord int")
    got = {r.id: r for r in st.enriched(results, "now").collect()}
    assert sorted(got) == ["a", "b"] and tuple(got["a"].card) == (3, 0, "0") and got["b"].card is None and got["a"].enriched_tier == "full" and got["a"].enriched_at == "now"
    notes = st.first_stays("name", "ord")(st.artist_notes(results, "old").limit(0), st.artist_notes(results, "now")).collect()
    assert sorted((n.name, n.note, n.seen) for n in notes) == [("ann!", "sings", "now"), ("bo", "plays", "now")]
    raw = spark.createDataFrame([("a", "great", "9", "film", "why", "high", 2.5), ("b", "odd", "1", "film", "why", "high", 1.0), ("c", "skip", None, "no", None, "sure", 4.0)], "id string, tier string, adjust string, lane string, why string, confidence string, score double")
    told = {r.id: r for r in st.judged(raw, ("film",), "t", 7, spark.createDataFrame([("a", 6.0)], "id string, score double"), "m").collect()}
    assert sorted(told) == ["a", "c"] and (told["a"].adjust, told["a"].lane, told["a"].score_at_judge, told["a"].judged_at, told["a"].input_version, told["a"].model) == (3, "film", 6.0, "t", 7, "m")
    assert (told["c"].adjust, told["c"].lane, told["c"].confidence, told["c"].score_at_judge) == (0, None, "med", 4.0)
    catalog = spark.createDataFrame([("2026-06-01", "Music", ["Ann"], 1), ("2026-07-01", "Music", [" Léon ", "Bo"], 2), ("2026-07-01", "film", ["No"], 3), (None, "music", ["Old"], 4)], "date string, category string, lineup array<string>, ord int")
    names = st.wanted_names(catalog, spark.createDataFrame([("leon", 1), ("Cy", 2)], "name string, ord int"), "2026-06-15", ("music",))
    assert sorted((n.key, n.name) for n in names.collect()) == [("bo", "Bo"), ("cy", "Cy"), ("leon", "Léon")]
