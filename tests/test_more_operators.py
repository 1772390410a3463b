from datetime import date

from pyspark.sql import functions as F

from lumenfold.operators import festivals, maintain, matching, quality, records, search, settings

TODAY = date(2026, 6, 17)


def test_festivals(spark):
    rows = [("A", "City Park", "2026-06-19..21", "on_sale", None), ("B", "Far", "2026-06-01", "announced", None), ("C", "Far", "TBA", "rumour", "local"), ("D", "Far", "2026-06-30, 2026-07-02", "announced", "")]
    out = {r.name: r for r in festivals.watch_list(spark.createDataFrame(rows, "name string, location string, when string, status string, scope string"), TODAY, ("city",)).collect()}
    assert set(out) == {"A", "C", "D"} and out["A"].shown == "Jun 19–21" and out["D"].shown == "Jun 30–Jul 2" and out["C"].shown == "TBA"
    assert (out["A"].scope, out["C"].scope, out["D"].scope) == ("local", "local", "travel")
    titles = ["The Windy Festival: Full Festival Passes", "Windy Festival: Saturday Drums", "Talk: a night"]
    keys = [r[0] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(festivals.rollup_key("t")).collect()]
    assert keys == ["windy", "windy", "talk a night"]


def test_search_and_people(spark):
    e = spark.createDataFrame([("k1", "Big Night Out", ["Ann"]), ("k2", "Other", ["Night Ann"])], "key string, title string, lineup array<string>")
    assert [r.key for r in search.matching_rows(e, "ann night").orderBy("key").collect()] == ["k1", "k2"] and search.matching_rows(e, "").count() == 0
    profiles = spark.createDataFrame([("own", "Boss", True), ("lori", "Dr. Who", False), ("drwho", "Lori", False)], "username string, name string, owner boolean")
    asked = spark.createDataFrame([("me",), ("Lori",), ("dr who",), ("nobody",)], "person string")
    got = {r.person: (r.id, r.hash is None) for r in search.resolve_people(asked, profiles, "s:").collect()}
    assert got == {"me": ("own", True), "Lori": ("lori", False), "dr who": ("lori", False)}


def test_price_pool(spark):
    ddl = "key string, day date, lane string, price string, status string, tier string, rank_score int, act string"
    d, far = date(2026, 6, 20), date(2026, 9, 1)
    rows = [("a", d, "club:day", "$5", None, None, 5, "x"), ("b", d, "film", "$5", None, None, 9, "y"), ("c", far, "film", None, None, "skip", 1, "z"), ("d", d, "stage", "free", None, None, 9, "w"), ("e", d, "club:day", None, None, None, 4, "x"), ("f", d, "comedy", None, "unlisted", None, 9, "v")]
    starred = spark.createDataFrame([("c",)], "key string")
    assert [r.key for r in search.price_pool(spark.createDataFrame(rows, ddl), TODAY, 21, starred, 5).collect()] == ["c", "a"]


def test_market_matches(spark):
    d = date(2026, 6, 20)
    events = spark.createDataFrame([("k", d, "The Blue Hall", "Ann Tour"), ("m", d, "Elsewhere", "Bob"), ("n", d, "Pier", "Cy")], "key string, day date, venue string, name string")
    offers = spark.createDataFrame([("o1", d, "Other", "Ann", 1), ("o2", d, "Blue Hall", "Zed", 2), ("o3", d, "Blue Hall LA", "Ann", 3), ("o4", date(2026, 6, 21), "Elsewhere", "Bob", 4), ("o5", d, "X", "Cy", 5), ("o6", d, "Y", "Cy", 6)], "offer string, day date, venue string, name string, ord int")
    assert {r.key: (r.offer, r.rank) for r in matching.best_offers(events, offers).collect()} == {"k": ("o3", 3), "n": ("o5", 1)}


def test_ghosts_and_freshness(spark):
    ddl = "id int, day date, sources array<string>, last_seen date, status string"
    near, old, new = date(2026, 6, 25), date(2026, 6, 10), date(2026, 6, 17)
    rows = [(1, near, ["a"], old, None), (2, near, ["a", "z"], old, None), (3, near, ["a"], new, "unlisted"), (4, date(2026, 9, 1), ["a"], old, None), (5, near, [], old, None), (6, near, ["a"], None, "unlisted"), (7, None, ["a"], old, None)]
    df = spark.createDataFrame(rows, ddl)
    got = {r.id: r.status for r in quality.flag_ghosts(df, spark.createDataFrame([("a",), ("b",)], "source string"), TODAY, 28).collect()}
    assert got == {1: "unlisted", 2: None, 3: None, 4: None, 5: None, 6: "unlisted", 7: None}
    assert {r.id for r in quality.flag_ghosts(df, spark.createDataFrame([], "source string"), TODAY, 28).where("status = 'unlisted'").collect()} == {3, 6}
    fresh = {r.source: r for r in quality.source_freshness(df, TODAY).collect()}
    assert (fresh["a"].n, fresh["a"].days, fresh["a"].newest_days) == (5, 7, 0)


def test_records(spark):
    md = "# Digest 2026-06-17\n<!-- take: hello\n there -->"
    got = spark.createDataFrame([(md,), ("# x",), ("<!-- take:start -->",)], "m string").select(records.teaser("m").alias("t")).collect()
    assert (got[0].t.text, got[0].t.day) == ("hello there", "2026-06-17") and got[1].t is None and got[2].t is None
    events = spark.createDataFrame([("k", "Night with Long Name", "music", ["Ann"]), ("m", "Long Name quiz", "general", [])], "key string, title string, category string, lineup array<string>")
    notes = spark.createDataFrame([("ann", "a"), ("Long Name", "b")], "name string, note string")
    assert {r.key: [x.note for x in r.notes] for r in records.artist_notes(events, notes, "key").collect()} == {"k": ["b", "a"]}


def test_staleness_and_prices(spark):
    ddl = "id int, input_version int, score int, score_at_judge int, judged_at string, reacted_at string"
    rows = [(1, 2, 5, 5, "2026-06-10T00:00:00", None), (2, 1, 5, 5, "2026-06-10", None), (3, 2, 7, 5, "2026-06-10", None), (4, 2, 5, 5, "2026-06-10T10:00:00", "2026-06-10"), (5, 2, 5, 5, "2026-06-10", "2026-06-09"), (6, 2, 5, 5, "bad", None)]
    df = spark.createDataFrame(rows, ddl)
    assert sorted(r.id for r in df.where(maintain.verdict_stale(2, 2, None, TODAY)).collect()) == [2, 3, 4]
    assert sorted(r.id for r in df.where(maintain.verdict_stale(2, 2, 7, TODAY)).collect()) == [1, 2, 3, 4, 5, 6]
    o = spark.createDataFrame([("k", "a", 9.0, "1", 1), ("k", "a", 12.0, "2", 2), ("k", "b", 10.0, "1", 3), ("k", "c", None, "0", 4)], "key string, source string, price double, checked_at string, ord int")
    r = maintain.price_options(o).first()
    assert ([x.source for x in r.options], r.checked_at) == (["b", "a", "c"], "2")


def test_recurring(spark):
    rules = spark.createDataFrame([("m", "weekly:Fri", [7]), ("s", "monthly:2:Sunday", []), ("x", "yearly:1", None)], "name string, token string, except_months array<int>")
    got = sorted((r.name, str(r.day)) for r in maintain.expand_recurring(rules, TODAY, 35).collect())
    assert got == [("m", "2026-06-19"), ("m", "2026-06-26"), ("s", "2026-07-12")]


def test_settings():
    assert settings.edited(None, ["A", "b"], add=["a", "C"], remove=["B"]) == ["A", "C"]
    assert settings.weighted(None, {"x": 9}, {"x": 1, "y": 2}) == {"x": 5, "y": 2}


def test_signature_is_stable(spark):
    df = spark.createDataFrame([(f"k{i}", i, None if i % 2 else "great") for i in range(40)], "key string, final_rank int, tier string")
    a = records.feed_signature(df, "p").first()[0]
    assert a == records.feed_signature(df.orderBy(F.desc("key")).repartition(4), "p").first()[0]
    assert a == records.feed_signature(df.where("final_rank < 30"), "p").first()[0] != records.feed_signature(df.where("final_rank > 0"), "p").first()[0]
