"""Linked data against a plain walk, all fields, venues' pages, and blocks that can't be read."""

import json
import random
from datetime import date

from lumenfold.sources import linked_data as ld


def page(*blocks):
    return "<p>x</p>" + "".join(f'<script type="application/ld+json"> {b if isinstance(b, str) else json.dumps(b)} </script>' for b in blocks)


def table(spark, pages):
    return spark.createDataFrame(list(enumerate(pages)), "id long, html string")


def plain_walk(node, out):
    """Children, in the order of graphs, lists and items, before parents."""
    if isinstance(node, list):
        for x in node:
            plain_walk(x, out)
    elif isinstance(node, dict):
        for c in ld.GRAPHS:
            if isinstance(node.get(c), (dict, list)):
                plain_walk(node[c], out)
        kinds = node.get("@type")
        if any("Event" in str(k) or k == "Festival" for k in (kinds if isinstance(kinds, list) else [kinds])):
            out.append(node["name"])


def test_walk(spark):
    r = random.Random(2)

    def made(depth):
        if depth == 0 or r.random() < 0.2:
            return {"@type": r.choice(["MusicEvent", "Festival", "Place", ["Thing", "Event"], None]), "name": f"n{r.randrange(10**9)}", "item": r.choice(["text", 5, None])}
        if r.random() < 0.4:
            return [made(depth - 1) for _ in range(r.randrange(4))]
        node = {"@type": r.choice(["Event", "ItemList", "SocialEvent"]), "name": f"n{r.randrange(10**9)}"}
        return node | {c: made(depth - 1) for c in ld.GRAPHS if r.random() < 0.6}

    blocks = [[made(5) for _ in range(r.randrange(1, 4))] for _ in range(20)]
    found, _ = ld.nodes(table(spark, [page(*b) for b in blocks]), "id", "html")
    got: dict = {}
    for x in found.selectExpr("id", "block", "path", "try_variant_get(node, '$.name', 'string') as name").collect():
        got.setdefault(x.id, []).append((x.block, x.path, x.name))
    for k, own in enumerate(blocks):
        want: list = []
        for b in own:
            plain_walk(b, want)
        assert [n for *_, n in sorted(got.get(k, []))] == want


def test_fields_and_counts(spark):
    full = {
        "@type": "MusicEvent", "name": "Show", "url": ["https://e.example/1"], "startDate": "2026-06-20T20:00", "endDate": "2026-06-20T23:00", "description": "words", "image": ["http://no", {"url": "//i.example/a.png"}],
        "location": [{"name": "Room", "address": {"addressLocality": "North", "streetAddress": "1 Way"}, "geo": {"latitude": "34.5", "longitude": -118.25}}], "offers": [{"lowPrice": 5, "highPrice": 9}], "performer": [{"name": "Ann &amp; Bo"}, "Cy"], "organizer": {"name": "Org"},
    }
    again = {"@type": ["Event"], "name": "Other", "url": "https://e.example/1"}
    few = {"@type": "Festival", "name": {"name": "Fest"}, "@id": "f1", "location": "Field", "offers": "free entry"}
    there = {"@type": "Event", "name": "Bare", "location": {"name": "Hut", "address": "2 Way"}, "offers": {"price": "0"}}
    pages = [page({"@graph": [full, {"@type": "Place", "name": "p"}]}, again, "{bad", [few, there]), "no blocks", page(), None, page({"@type": "Event"}, json.dumps(there).replace('"', "&quot;"))]
    got, counts = ld.page_events(table(spark, pages).withColumnRenamed("id", "page"), "page", "html")
    rows = {(r.page, r.title): r for r in got.collect()}
    assert sorted(rows) == [(0, "Bare"), (0, "Fest"), (0, "Show"), (4, "Bare")]
    x = rows[0, "Show"]
    assert (x.id, x.date, x.start, x.end, x.venue, x.neighborhood, x.address, x.lat, x.lng) == ("https://e.example/1", "2026-06-20", "2026-06-20T20:00", "2026-06-20T23:00", "Room", "North", "1 Way", 34.5, -118.25)
    assert (x.category, x.price_min, x.price, x.lineup, x.organizer, x.detail, x.image) == ("MusicEvent", "5", "$5-9", ["Ann & Bo", "Cy"], "Org", "words", "https://i.example/a.png")
    y, z = rows[0, "Fest"], rows[0, "Bare"]
    assert (y.id, y.venue, y.price, y.start, y.lineup) == ("f1", "Field", None, None, []) and (z.id, z.venue, z.address, z.price) == ("Bare", "Hut", "2 Way", "free")
    assert sorted((c.page, c.blocks, c.unread) for c in counts.collect()) == [(0, 4, 1), (4, 2, 0)]


def test_venue_pages(spark):
    place = {"@type": "Place", "name": "Hall", "event": [
        {"@type": "MusicEvent", "name": "Techno <b>Night</b>", "url": "https://v.example/a", "startDate": "2026-06-21T03:30:00Z", "subEvent": {"@type": "MusicEvent", "name": "Late part", "url": "https://v.example/b", "startDate": "2026-06-21T01:00:00-07:00"}},
        {"@type": "MusicEvent", "name": "Again", "url": "https://v.example/a", "startDate": "2026-06-22T20:00:00"}, {"@type": "Event", "name": "Songs", "startDate": "2026-06-22T20:00"}, {"@type": "Event", "name": "Old", "url": "o", "startDate": "2026-06-01T20:00"},
        {"@type": "Event", "name": "Odd", "url": "p", "startDate": "soon"}, {"@type": "Festival", "name": "No event", "url": "q", "startDate": "2026-06-22"},
    ]}
    pages = spark.createDataFrame([(1, page(place), "https://v.example", "The Hall", "East")], "id long, html string, page_url string, name string, hood string")
    got, _ = ld.venue_events(pages.withColumnRenamed("id", "page"), "page", "html", "America/Los_Angeles", date(2026, 6, 20), 10)
    assert sorted((r.url, r.title, r.date, r.start, r.venue, r.neighborhood, r.category) for r in got.collect()) == [
        ("https://v.example", "Songs", "2026-06-22", "20:00", "The Hall", "East", "music"), ("https://v.example/a", "Techno Night", "2026-06-20", "20:30", "The Hall", "East", "electronic"),
        ("https://v.example/b", "Late part", "2026-06-21", "01:00", "The Hall", "East", "music"),
    ]
