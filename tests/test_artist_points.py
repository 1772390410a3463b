"""Artist points of everyone, against a loop over events and the (SQL-tested) artists of each person."""

import json

from lumenfold.plans import registry

DIR = "/root/testdata/sf0.001"


def test_points_of_all_people(spark):
    fans = {}
    for r in registry.queries()["affinity_build"](spark, DIR).collect():
        fans.setdefault(r.artist, []).append((r.profile, 2 if r.tier == "core" else 1))
    want = {}
    for e in spark.read.parquet(f"{DIR}/events.parquet").select("event_id", "props").collect():
        for profile, points in fans.get(f"artist {json.loads(e.props)['k']}", []):
            want[e.event_id, profile] = min(4, want.get((e.event_id, profile), 0) + points)
    got = {(r.id, r.profile): r.points for r in registry.queries()["artist_points"](spark, DIR).collect()}
    assert len({p for _, p in got}) > 3 and got == want
