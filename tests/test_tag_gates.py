"""The one pattern that lets flags be looked for must hold every one of theirs, and texts be prepared once."""

import re

import pytest

from lumenfold.operators import tags

SAID = [
    "open-to-close", "all night long", "all nightset", "[all night", "extended set", "21+", "21 and over", "18 +", "18 and over", "after hours", "afters", "sunset", "golden hour", "all-vinyl", "vinyl only", "b2b", "residency", "resident",
    "queer", "drag", "tributes", "cover band", "ep release", "35mm", "q&a", "q & a", "in person", "in attendance", "in conversation", "introduced by", "q &a with", "block party", "pop-up", "boat party", "yacht party",
    "location tba", "tba", "drops after", "sold out", "all ages",
]


@pytest.mark.parametrize("said", SAID)
def test_a_flag_opens_the_gate(said):
    assert re.search(tags._ANY_SAID, f"a night, {said} here")


def test_tags_are_those_of_rules_alone(spark):
    """Rules on prepared columns tell what they tell of a plain row, where every pattern is looked for in its own text."""
    rows = [(k, "party" if k % 2 else "film", f"Night {s} techno drum and bass jazz", "9pm - 6am", "Hall TBA", s.upper() if k % 3 else None, "Free RSVP") for k, s in enumerate([*SAID, "nothing"])]
    df = spark.createDataFrame(rows, "id int, category string, title string, start string, venue string, detail string, price string")
    got = {r.id: r for r in tags.tagged(df).select("id", "type", "genres", "vibe", "setting", "afters_billed").collect()}
    typed = df.withColumn("type", tags.type_of(df, tags.Gazetteer()))
    plain = typed.select("id", "type", tags.genres_of(typed, typed["type"], tags.Gazetteer()).alias("genres"), tags.vibes_of(typed, typed["type"]).alias("vibe"), tags.settings_of(typed, tags.Gazetteer()).alias("setting"))
    for r in plain.collect():
        assert (r.type, r.genres, r.vibe, r.setting) == (got[r.id].type, got[r.id].genres, got[r.id].vibe, got[r.id].setting)
    assert sum(r.afters_billed for r in got.values()) == 2 and not [c for c in tags.tagged(df).columns if c.startswith("_")]
    plan = tags.tagged(df).select("vibe", "genres")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("speed garage") <= 8  # once to open the gate and once as a rule, for types and genres; 30 times before


def test_facets_take_one_pass(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, None, None), (3, "a", ["x", None])], "id int, type string, vibe array<string>")
    out = tags.facets(df, ("type", "vibe"))
    assert {tuple(r) for r in out.collect()} == {("type", "a", 2), ("vibe", "x", 2), ("vibe", "y", 1)}
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
