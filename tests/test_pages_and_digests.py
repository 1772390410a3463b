"""The front page, digest sections, verdict studies and loaders, each against a loop or worked cases."""

import json
import random
from datetime import date, timedelta

from lumenfold.config import Taste
from lumenfold.operators import affinity, digest, front_page, matching, records, search, select
from lumenfold.functions.text import profile_hash
from lumenfold.sources import feeds

TODAY = date(2026, 6, 17)  # a Wednesday


def day(n):
    return TODAY + timedelta(days=n)


ROWS = "key string, day date, section string, final_rank int, rank_score int, score int, lane string, tier string, series string, series_rep boolean, title string, vibe array<string>, first date, last date, big boolean"


def row(key, n, section="sets", rank=9, lane="club:day", title="T", first=None, last=None, vibe=(), **more):
    base = {"score": 3, "tier": None, "series": None, "series_rep": None, "big": False} | more
    return (key, day(n), section, rank, 100 - rank, base["score"], lane, base["tier"], base["series"], base["series_rep"], title, list(vibe), day(first) if first is not None else None, day(last) if last is not None else None, base["big"])


def test_pool_and_heroes(spark):
    rows = [row("a", 0, rank=1), row("b", 0, rank=2), row("c", 0, rank=3), row("d", 0, rank=4, lane="art", section="events"), row("e", 3, rank=5, lane="club:afters"), row("f", 30, rank=6), row("m", 0, rank=0, section="movies", lane="film")]
    rows += [row("past", -1), row("skip", 0, tier="skip"), row("low", 0, score=-1), row("night2", 0, series="s", series_rep=False)]
    pool = front_page.pool(spark.createDataFrame(rows, ROWS), TODAY)
    assert {r.key for r in pool.collect()} == set("abcdefm")
    got = {}
    for r in sorted(front_page.heroes(pool, TODAY).collect()):
        got.setdefault(r.lens, []).append(r.key)
    assert got == {"today": ["a", "b", "d"], "weekend": ["e"], "twoweeks": ["a", "b", "d", "e"], "ahead": ["f"]}


def test_tables(spark):
    rows = [row("s1", 5, "seasonal", first=5, last=40), row("s2", 9, "seasonal", first=2, last=30), row("m1", 1, "movies", first=1, last=9), row("m2", 0, "movies", first=-3, last=4), row("m3", 0, "movies", first=-5, last=2)]
    rows += [row("t1", 3, "theater", 2), row("t2", 3, "theater", 1), row("f1", 8, "festivals", title="Reed Festival: Night", vibe=["festival"]), row("f2", 6, "events", title="The Reed Fest 2026", vibe=["festival"]), row("f3", 2, "events", title="Other fest", vibe=["festival"])]
    rows += [row("y1", 70, "sets", 3, big=True), row("y2", 70, "sets", 2, big=True), row("y3", 10, "sets", 1, big=True), row("y4", 12, "fyi", 4, big=True), row("y5", 12, "fyi", 4)]
    acts = spark.createDataFrame([("y1", "Ann"), ("y2", "ANN"), ("y3", "Bo"), ("y4", "Bo"), ("y5", "Cy")], "key string, act string")
    shelved = spark.createDataFrame([("y3",), ("y2",)], "key string")
    got = {}
    for r in sorted(front_page.tables(spark.createDataFrame(rows, ROWS), acts, shelved, TODAY).collect(), key=lambda r: (r.table, r.place)):
        got.setdefault(r.table, []).append(r.key)
    assert got == {"seasonal": ["s2", "s1"], "movies": ["m3", "m2", "m1"], "theater": ["t2", "t1"], "festivals": ["f3", "f2"], "fyi": ["y4", "y2"]}


CANDS = "key string, day date, title string, venue string, category string, rating int, score int, series string, link string, ord int, added boolean, changed_fields array<string>"


def cand(key, n, series=None, rating=3, score=3, venue="V", added=False, moved=None, category="music"):
    return (key, day(n) if n is not None else None, key, venue, category, rating, score, series, f"l{key}", int(key[1:]), added, moved)


def test_digest_sections(spark):
    rows = [cand("k1", 0, "s", 3, 9, "A"), cand("k2", 1, "s", 5, 9, "B"), cand("k3", 1, None, 4), cand("k4", 1, None, 4, 8), cand("k5", 1, None, 2), cand("k6", 1, None, 1), cand("k7", 9, "t", 4, 1, "A", True), cand("k8", 8, "t", 4, 5, "B", True), cand("k9", 16, None, 5, added=False, moved=["price"])]
    df = spark.createDataFrame(rows, CANDS)
    assert sorted((r.day, r.place, r.key) for r in digest.tonight(df, TODAY).collect()) == [(day(0), 1, "k1"), (day(1), 1, "k4"), (day(1), 2, "k3"), (day(1), 3, "k5")]
    runs = {r.program: r for r in digest.collapsed(df).collect()}
    assert (runs["s"].key, runs["s"].days, runs["s"].venues, runs["s"].links) == ("k1", [day(0), day(1)], ["A", "B"], ["lk1", "lk2"]) and runs["t"].key == "k8" and runs["solo:k3"].earliest == day(1)
    assert sorted((r.kind, r.place, r.n, r.key) for r in digest.changed(df).collect()) == [("new", 1, 1, "k8"), ("updated", 1, 1, "k9")]
    assert sorted((r.kind, r.place, r.key) for r in digest.marquee(df, TODAY).collect()) == [("opening", 1, "k8"), ("single", 1, "k3"), ("single", 2, "k4")]
    assert sorted((r.weekend, r.place, r.more, r.key) for r in digest.weekends(df, 3).collect()) == [(day(2), 1, 2, "k4"), (day(2), 2, 2, "k3"), (day(2), 3, 2, "k1"), (day(9), 1, 0, "k8"), (day(16), 1, 0, "k9")]
    town = spark.createDataFrame([cand("k1", 4), cand("k20", 3), cand("k21", 2, category="Film"), cand("k22", 9)], CANDS)
    assert [r.key for r in digest.around(town, df, 2).collect()] == ["k20", "k22"]
    far = spark.createDataFrame([("a", day(40), 2.0), ("b", day(41), 3.0), ("c", day(75), 1.0)], "key string, day date, rank double")
    assert sorted((r.month, r.place, r.key) for r in digest.radar_months(far, 1).collect()) == [("2026-07", 1, "b"), ("2026-08", 1, "c")]


def test_verdicts_shown(spark):
    slate = spark.createDataFrame([("a", 2, 4), ("b", 2, None), ("c", 3, 1)], "key string, rating int, score int")
    verdicts = spark.createDataFrame([("a", "great", 2), ("b", "none", None)], "key string, tier string, adjust int")
    assert sorted((r.key, r.rating, r.score, r.judged) for r in digest.judged(slate, verdicts).collect()) == [("a", 4, 6, True), ("b", 2, 0, True), ("c", 3, 1, False)]


def test_verdict_studies(spark):
    r = random.Random(5)
    rows = [(f"{i * 7919 % 997:03x}{i}", r.choice(["must-see", "great", "solid", "skip"]), r.choice([None, 0, -3, 1, 4]), r.choice([None, *range(12)])) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, tier string, adjust int, score int").selectExpr("*", "score + coalesce(adjust, 0) as rank_score")
    known = [x for x in rows if x[3] is not None]
    lower = lambda s: sum(x[3] < s for x in known) / len(known) * 100
    want = {}
    for key, tier, adjust, score in known:
        kinds = ["promoted_low_score"] * (tier in ("must-see", "great") and lower(score) <= 40) + ["demoted_high_score"] * (tier == "skip" and lower(score) >= 75) + ["big_adjust"] * (abs(adjust or 0) >= 3)
        if kinds:
            want[key] = (kinds, round(lower(score)))
    assert {x.key: (x.kinds, x.score_pct) for x in matching.disagreements(df).collect()} == want
    order = lambda worth: {k: i for i, (_, k) in enumerate(sorted(((worth(x), x[0]) for x in known), reverse=True))}
    was, now = order(lambda x: x[3]), order(lambda x: x[3] + (x[2] or 0))
    moves = sorted(abs(was[k] - now[k]) / len(known) * 100 for k in was)
    got = matching.displacement(df).first()
    assert (got.n, got.mean_pct, got.p90_pct, got.max_pct) == (len(known), round(sum(moves) / len(moves), 1), round(moves[int(len(moves) * 0.9)], 1), round(moves[-1], 1))
    assert matching.displacement(df.limit(0)).collect() == []


def test_loaders(spark):
    ddl = "profile string, top map<string, array<struct<name:string,genres:array<string>>>>, followed array<struct<name:string,genres:array<string>>>, recent array<struct<track:struct<artists:array<struct<name:string>>>>>"
    payload = [("p", {"long_term": [("Ann", ["House"]), ("Bo", [])], "short_term": [("Ann", ["house"])]}, [("Cy", ["Dub"])], [((([("Ann",), ("Di",)]),),)]), ("empty", {}, [], [])]
    signals = feeds.listening(spark.createDataFrame(payload, ddl))
    assert sorted((r.profile, r.source, r.name, r.rank) for r in signals.collect()) == [("p", "followed", "Cy", 0), ("p", "recent", "Ann", 0), ("p", "recent", "Di", 0), ("p", "top_long", "Ann", 0), ("p", "top_long", "Bo", 1), ("p", "top_short", "Ann", 0)]
    said = spark.createDataFrame([("p", "loved", ["Di"], ["dub"], 1), ("q", "hide", ["Ann"], [], 2)], "profile string, kind string, artists array<string>, genres array<string>, ord int")
    artists, genres = affinity.merged(signals, said)
    assert {(r.profile, r.artist): r.tier for r in artists.collect()} == {("p", "ann"): "core", ("p", "bo"): "strong", ("p", "cy"): "strong", ("p", "di"): "core", ("q", "ann"): "hidden"}
    assert {(r.profile, r.genre) for r in genres.collect()} == {("p", "house"), ("p", "dub")}


def test_marketplaces(spark):
    ddl = "ord int, event struct<name:string,datetime_local:string,min_price:struct<total:int,prefee:int>,seo_url:string>, venue struct<name:string,metro:string>"
    found = spark.createDataFrame([(0, ("Ann", "2026-06-20T20:00", (5150, 4000), "u1"), ("Blue Room", "LosAngeles")), (1, ("Ann", "2026-06-20T20:00", (0, 0), "u2"), ("Blue Room", "losangeles")), (2, ("Bo", "2026-06-20T20:00", (900, 0), "u3"), ("Pier", "sf"))], ddl)
    offers = feeds.market_offers(found, "losangeles")
    assert [(r.price, r.prefee, str(r.day), r.url) for r in offers.collect()] == [(51.5, 40.0, "2026-06-20", "u1")]
    events = spark.createDataFrame([("e", date(2026, 6, 20), "The Blue Room", "Ann and others")], "key string, day date, venue string, name string")
    assert [r["rank"] for r in matching.best_offers(events, offers).collect()] == [3]
    low = spark.createDataFrame([("e", 30.0, "a", 0), ("e", 20.0, "b", 1), ("e", 20.0, "c", 2), ("e", None, "d", 3)], "key string, lowest_price double, url string, ord int")
    assert [(r.price, r.url) for r in feeds.cheapest_listing(low).collect()] == [(20.0, "b")]


def test_people_and_stores(spark):
    profiles = spark.createDataFrame([("Own", "The Owner", True), ("ann", "Ann B.", False), ("bo", "Ann B", None)], "username string, name string, owner boolean")
    asked = spark.createDataFrame([(x,) for x in ("me", "ANN", "ann b", "own", "nobody")], "person string")
    found = {r.person: r for r in search.resolve_people(asked, profiles, "s:").collect()}
    assert {k: (r.id, r["hash"] is None) for k, r in found.items()} == {"me": ("own", True), "ANN": ("ann", False), "ann b": ("ann", False), "own": ("own", True)}
    hashes = profiles.select(profile_hash("username", "s:").alias("hash"), "username").collect()
    own = next(r["hash"] for r in hashes if r.username == "Own")
    got = {r["hash"]: r.store for r in records.store_hash(spark.createDataFrame([(own.upper(),), ("other",)], "hash string"), profiles, "s:").collect()}
    assert got == {own.upper(): None, "other": "other"}


def test_notes_of_long_names(spark):
    events = spark.createDataFrame([(1, "A night with The Very Long Name Of A Band live", [], "music"), (2, "The Very Long Name Of Another", ["Bo"], "music"), (3, "Short act", [], "market")], "id int, title string, lineup array<string>, category string")
    notes = spark.createDataFrame([("The Very Long Name Of A Band", "n1"), ("bo", "n2"), ("Short act", "n3")], "name string, note string")
    assert {r.id: [x.note for x in r.notes] for r in records.artist_notes(events, notes, "id").collect()} == {1: ["n1"], 2: ["n2"]}


def test_genres_of_events(spark):
    events = [(1, "Warehouse of Blues popup", ["deep-house"]), (2, "A french house night, balearic!", ["techno"]), (3, "Deep  house all night", None), (4, "house and pop", []), (5, "Hard techno", ["hard-techno"])]
    genres = [("p", "Deep House", 0.9, 1), ("p", "house", 1.0, 0), ("p", "french house", 0.6, 2), ("p", "balearic", 0.5, 3), ("p", "pop", 0.4, 4), ("q", "techno", 1.0, 0)]
    hits = affinity.genre_hits(spark.createDataFrame(events, "id int, text string, tags array<string>"), spark.createDataFrame(genres, "profile string, genre string, weight double, ord int"), "id", Taste())
    assert sorted((r.id, r.profile, r.genre) for r in hits.collect()) == [(1, "p", "Deep House"), (1, "p", "house"), (2, "p", "balearic"), (2, "p", "french house"), (2, "q", "techno"), (3, "p", "Deep House"), (3, "p", "house")]
    assert {(r.id, r.profile): (r.points, r.genre) for r in affinity.genre_points(hits, "id", Taste()).collect()} == {(1, "p"): (1, "house"), (2, "p"): (1, "french house"), (2, "q"): (1, "techno"), (3, "p"): (1, "house")}


def test_pool_of_the_judge(spark):
    ddl = "key string, day date, title string, venue string, lineup array<string>, lane string, score int"
    rows = [("a", day(0), "Fine night", "V", [], "film", 9), ("b", day(0), "Other", "V", [], "film", 5), ("c", day(0), "Third", "V", [], "film", 1), ("d", day(-1), "Past", "V", [], "film", 9), ("e", None, "Undated", "V", [], "art", 2)]
    rows += [("f", day(1), "Stall", "V", [], "market", 4), ("g", day(1), "Small stall", "V", [], "market", 3), ("h", day(1), "VIP upgrade", "V", [], "art", 9), ("i", day(1), "Call 1-800-555-1234 now", "V", [], "art", 9), ("b", day(0), "Other", "V", [], "film", 4)]
    df = spark.createDataFrame(rows, ddl)
    keys = lambda **k: sorted(r.key for r in select.editor_pool(df, TODAY, **k).collect())
    assert keys() == ["a", "b", "c", "e", "f"] and keys(top_k=1) == ["a", "f"] and keys(per_lane=1) == ["a", "b", "e", "f"] and keys(per_lane=1, floor=99) == ["a", "e"]
    artists = spark.createDataFrame([("p", "ann", "Ann", 3.0, "core"), ("p", "bo", "Bo", 5.0, "core"), ("p", "cy", "Cy", 1.0, "light")], "profile string, artist string, name string, weight double, tier string")
    genres = spark.createDataFrame([("p", "dub", 0.5, 1), ("p", "house", 1.0, 0)], "profile string, genre string, weight double, ord int")
    told = affinity.summary(artists, genres, 2, 1)
    assert [([(x.name, x.tier) for x in r.artists], r.genres) for r in told.collect()] == [([("Bo", "core"), ("Ann", "core")], ["house"])]
    made = spark.createDataFrame([("b", '{"key": "b"}'), ("a", '{"key": "a"}')], "key string, record string")
    doc = json.loads(records.pool_document(made, told, TODAY, 28, 0, 4, "likes dub").first().document)
    assert [x["key"] for x in doc["events"]] == ["a", "b"] and doc["count"] == 2 and doc["today"] == "2026-06-17" and doc["taste_profile"] == "likes dub" and doc["profile_affinity"]["genres"] == ["house"]
    assert json.loads(records.pool_document(made.limit(0), told.limit(0), TODAY, 28, 0, 4).first().document)["events"] == []
