"""Every flag, setting and rule of kinds, each by a row of its own."""

import pytest

from lumenfold.operators import tags

DDL = "title string, venue string, detail string, organizers string, category string, genre string, lineup_genre string, lineup array<string>, sources array<string>, start string, price string, neighborhood string, ra_pick boolean"
NAMES = [f.strip().split()[0] for f in DDL.split(", ")]


def tagged(spark, rows, g=tags.Gazetteer()):
    base = dict.fromkeys(NAMES) | {"title": "Plain", "venue": "Room", "category": "general", "lineup": [], "sources": []}
    df = spark.createDataFrame([(i, *((base | r)[n] for n in NAMES)) for i, r in enumerate(rows)], "id int, " + DDL)
    return {r.id: r for r in tags.tagged(df, g).collect()}


CLUB = {"category": "electronic"}
FILM = {"category": "film"}
VIBES = [
    ("afterhours", {"title": "Night afters"}), ("afterhours", CLUB | {"start": "02:00"}), ("afterhours", {"detail": "after hour set"}), ("day-party", CLUB | {"start": "13:00"}), ("sunset", {"detail": "at golden hour"}),
    ("all-vinyl", {"detail": "vinyl-only"}), ("all-night-set", CLUB | {"title": "X open to close"}), ("b2b", {"title": "A b2b B"}), ("residency", {"detail": "monthly residency"}), ("queer", {"title": "Pride night"}),
    ("drag", {"title": "Drag brunch"}), ("burlesque", {"title": "Burlesque"}), ("tribute", {"title": "A tribute to Y"}), ("album-release", {"title": "Y album release"}), ("festival", CLUB | {"title": "Beach festival"}),
    ("analog-film", FILM | {"title": "Z in 35mm"}), ("q&a", FILM | {"detail": "with q&a"}), ("guest-in-person", FILM | {"detail": "director in person"}), ("matinee", FILM | {"start": "14:00"}), ("block-party", {"title": "Block party"}),
    ("pop-up", {"title": "Pop-up dinner"}), ("boat-party", {"title": "Boat party"}), ("tba-location", {"venue": "TBA"}), ("ra-pick", {"ra_pick": True}), ("free", {"price": "Free"}), ("free-rsvp", {"price": "free w/ RSVP"}),
    ("sold-out", {"detail": "sold out"}), ("21+", {"detail": "21+ only"}), ("18+", {"detail": "18 and over"}), ("all-ages", {"detail": "all ages"}),
]


def test_every_vibe_fires(spark):
    got = tagged(spark, [r for _, r in VIBES])
    for i, (vibe, row) in enumerate(VIBES):
        assert vibe in got[i].vibe, (vibe, row, got[i].vibe)
    assert {v for v, _ in VIBES} == {v for r in got.values() for v in r.vibe} and len({v for v, _ in VIBES}) == 28


def test_after_parties_are_not_afterhours(spark):
    got = tagged(spark, [{"title": "Big Show After Party"}, {"title": "Words come after"}, {"title": "Big afters"}, {"title": "Big after-hours"}])
    assert [("afterhours" in got[i].vibe, got[i].afters_billed) for i in range(4)] == [(False, False), (False, False), (True, True), (True, True)]


def test_every_setting_fires(spark):
    words = {"rooftop": "rooftop", "warehouse": "warehouse", "outdoor": "open air", "pool": "poolside", "listening-bar": "listening room", "gallery": "museum"}
    got = tagged(spark, [{"detail": w} for w in words.values()])
    assert [got[i].setting for i in range(len(words))] == [[s] for s in words]
    known = tags.Gazetteer(setting={"low bar": ("bar", "diy"), "bowl": ("amphitheater",)}, cinemas=("old film house",))
    got = tagged(spark, [{"venue": "The Low Bar"}, {"venue": "Old Film House"}, {"venue": "The Bowl", "title": "rooftop"}], known)
    assert [got[i].setting for i in range(3)] == [["bar", "diy"], ["cinema"], ["amphitheater", "rooftop"]] and got[2].scale == "arena"


TYPES = [
    ({"title": "World Cup final watch party"}, "community"), ({"title": "World Cup after party", "category": "party"}, "club"), ({"category": "farmers_market"}, "market"), ({"category": "film"}, "film"),
    ({"title": "Heat on 35mm"}, "film"), ({"title": "A matinée"}, "film"), ({"category": "arts & theatre", "genre": "Opera"}, "stage"), ({"category": "arts & theatre", "genre": "Opera", "title": "Improv opera"}, "comedy"),
    ({"title": "Open mic"}, "comedy"), ({"category": "dance"}, "stage"), ({"category": "arts & theatre", "title": "The nutcracker"}, "stage"), ({"category": "arts & theatre", "title": "Mariachi gala"}, "live-music"),
    ({"category": "arts & theatre", "title": "Else"}, "other"), ({"title": "Vintage market"}, "market"), ({"title": "Clay seminar"}, "workshop"), ({"title": "Techno rave"}, "club"), ({"title": "Warehouse night"}, "club"),
    ({"category": "music", "title": "Ann"}, "live-music"), ({"category": "music", "genre": "dance/electronic", "title": "Disco party"}, "club"), ({"detail": "live music all evening"}, "live-music"), ({"detail": "deep house"}, "club"),
    ({"category": "art"}, "art"), ({"sources": ["ra"], "category": "x"}, "club"), ({}, "other"),
]


def test_kinds(spark):
    got = tagged(spark, [r for r, _ in TYPES])
    assert [(r, got[i].type) for i, (r, _) in enumerate(TYPES)] == TYPES


@pytest.mark.parametrize("rules,row", [(tags.ELECTRONIC, CLUB), (tags.LIVE, {"category": "music"})])
def test_genres_by_their_own_names(spark, rules, row):
    names = [n for n, _ in rules if n not in ("dnb", "edm", "progressive", "hard-dance", "funk-soul", "bass")]
    got = tagged(spark, [row | {"title": f"All of {n.replace('-', ' ')}"} for n in names])
    for i, n in enumerate(names):
        assert n in got[i].genres or got[i].type not in ("club", "live-music"), (n, got[i].genres)


def test_plan_has_each_rule_once(spark):
    df = spark.createDataFrame([tuple([*[None] * 7, [], [], None, None, None, False])], DDL)
    plan = tags.tagged(df).where("type = 'club' or array_contains(vibe, 'drag')")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("burlesque") == 2  # pattern and name
