import unicodedata

from pyspark.sql import functions as F

from lumenfold.config import Taste, resolved
from lumenfold.functions import dates, prices, text
from lumenfold.operators import maintain, normalize, score, tags
from lumenfold.sources import images, sinks


def values(spark, expr, rows, ddl="x string"):
    return [r[0] for r in spark.createDataFrame([x if isinstance(x, tuple) else (x,) for x in rows], ddl).select(expr).collect()]


def test_normalised(spark):
    assert values(spark, text.normalized("x"), ["Déjà  Vu & Co!", None, "a_b-c", "x y"]) == ["déjà vu and co", "", "a_b c", "x y"]
    assert values(spark, text.venue_key("x"), ["The Roxy at LA"]) == ["roxy"]
    assert values(spark, text.film_core("x"), ["Jaws 50th Anniversary 4K", "The Odyssey (70mm)", "4K", "Heat (1995)"]) == ["jaws", "the odyssey", "4k", "heat"]


def test_fold_is_nfkd(spark):
    chars = [chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    want = ["".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower() for x in chars]
    got = values(spark, text.folded("x"), chars)
    assert [(a, b, c) for a, b, c in zip(chars, got, want, strict=True) if b != c and len(c) == 1] == []


def test_days(spark):
    cases = ["2026-06-20T02:30:00Z", "2026-06-20T02:30:00", "2026-06-20", "20xx", None, "2026-06-20T23:00:00+02:00"]
    assert list(map(str, values(spark, dates.event_day("x"), cases))) == ["2026-06-19", "2026-06-20", "2026-06-20", "None", "None", "2026-06-20"]
    assert values(spark, F.to_json(dates.hours("x")), ["10pm-3am", "22:30", "8:30pm", "TBA", "12am", "25:00"]) == ['{"first":22,"last":3}', '{"first":22}', '{"first":20}', "{}", '{"first":0}', "{}"]
    assert values(spark, F.to_json(dates.start_range("x")), ["19:30", "10pm-2am", "8", "13pm", "8:00 PM"]) == ['{"start":1170}', '{"start":1320,"end":120}', "{}", "{}", '{"start":1200}']
    assert values(spark, dates.time_label("x"), ["19:30", "00:00", "noonish", "12:05"]) == ["7:30pm", "12am", "noonish", "12:05pm"]


def test_date_roll(spark):
    url = "https://t.example/show-06-20-2026/event/1"
    rows = [("2026-06-21", "01:30", url), ("2026-06-21", "20:00", url), ("2026-06-22", "20:00", url), ("2026-06-20", "20:00", url), ("2026-06-21", None, url)]
    got = values(spark, F.to_json(dates.repaired("d", "s", "u")), rows, "d string, s string, u string")
    assert [g.replace('"', "") for g in got] == ["{day:2026-06-20,start:18:30:00,fixed:true}", "{day:2026-06-20,start:20:00,fixed:true}", "{day:2026-06-22,start:20:00,fixed:false}", "{day:2026-06-20,start:20:00,fixed:false}", "{day:2026-06-20,fixed:true}"]


def test_prices(spark):
    rows = [("$9", "1", "2"), (None, "20", "45"), ("", "25.0", "25"), (None, "0", "0"), (None, None, None), (None, "0", "12.5"), (None, "x", None)]
    assert values(spark, prices.price_text("p", "a", "b"), rows, "p string, a string, b string") == ["$9", "$20-45", "$25", "free", None, "$12.5", None]
    assert values(spark, prices.is_free("x"), ["Free w/ RSVP", "free before 10, $20 after", "no cover", None]) == [True, False, True, False]
    got = values(spark, prices.search_name("t", "l"), [("An Evening with Ann (21+)", []), ("Bob - The Big Tour", []), ("Cyd - Dee", []), ("x", ["Eve (Touring)"])], "t string, l array<string>")
    assert got == ["Ann", "Bob", "Cyd", "Eve"]


def test_details_and_junk(spark):
    assert values(spark, normalize.clean_detail("x"), ["<p>Great &amp; loud</p>\nDoors open 8pm\nBuy tickets now\nyes , ok", "ab", None, "word " * 100]) == ["Great & loud yes, ok", None, None, ("word " * 100)[:400].rsplit(" ", 1)[0].rstrip() + "…"]
    titles = ["Call 1-800-555-1234", "Delta airlines booking number", "Acme Airlines", "VIP Upgrade: Show", "PayPal login help", "Jazz Night"]
    assert [bool(x) for x in values(spark, normalize.junk_reason("x"), titles)] == [True, True, False, True, True, False]
    assert values(spark, normalize.junk_reason("t", "v", "l"), [("The Roxy", "the  roxy", []), ("The Roxy", "the roxy", ["A"])], "t string, v string, l array<string>") == ["title is just the venue (placeholder listing)", None]


def test_raw_aliases(spark):
    df = spark.createDataFrame([("Show", "Room", "2026-06-20T21:00:00", "Ann", "https://x.example", "12", "20")], "name string, venue_name string, datetime string, artist string, url string, price_min string, price_max string")
    r = normalize.normalize_records(df, "dice").first()
    assert (r.title, r.venue, r.date, r.start, r.lineup, r.category, r.price, r.sources) == ("Show", "Room", "2026-06-20", "21:00", ["Ann"], "live_music", "$12-20", ["dice"])
    assert [(x.source, x.url) for x in r.links] == [("dice", "https://x.example")]


def test_scores(spark):
    taste = Taste(tracked=("Ann", "Train"), ambiguous=("train",), venues_loved=("The Mill House",), venues_banned=("pit",), near_home=("north",), far=("farland",), comedians=("zed",))
    ddl = "title string, venue string, category string, neighborhood string, lineup array<string>, day date, detail string"
    from datetime import date

    wed, fri = date(2026, 6, 17), date(2026, 6, 19)
    cases = [
        (("Show", "x", "party", "", [], wed, None), 3), (("Show", "x", None, "", [], fri, None), 2), (("Ann live", "x", "music", "North", [], wed, None), 5), (("Train songs", "x", "music", "", [], wed, None), 2),
        (("Show", "x", "music", "", ["Train (UK)"], wed, None), 4), (("Laughs", "x", "comedy", "", [], wed, None), -1), (("Zed", "x", "comedy", "", [], wed, None), 5), (("Show", "Mill House", "music", "", [], wed, None), 3),
        (("Show", "The Pit", "music", "", [], wed, None), -3), (("Bingo karaoke", "x", "music", "", [], wed, None), -2), (("Show", "x", "music", "farland", [], wed, None), 0), (("Big festival", "x", "music", "farland", [], wed, None), 2),
        (("Show", "x", "music", "", [], wed, "on the rooftop"), 3),
    ]
    out = score.scored(spark.createDataFrame([c for c, _ in cases], ddl), taste).collect()
    assert [r.score for r in out] == [w for _, w in cases]
    assert out[4].reasons == ["+2 music (medium interest)", "+2 tracked artist (Train)"] and out[2].rating == 3
    assert resolved({"far": ["a"]}, {"far": ["b"], "near_home": ["c"]}) == Taste(far=("a",), near_home=("c",))


def test_tags(spark):
    ddl = "title string, venue string, category string, genre string, lineup_genre string, detail string, start string, price string, lineup array<string>, sources array<string>"
    cases = [
        (("World Cup Finals Watch", "bar", "music", None, None, None, None, None, [], []), "community"), (("Deep House Night", "x", "party", None, None, None, "23:00", None, [], []), "club"),
        (("Hamlet", "x", "Arts & Theatre", "Theatre", None, None, None, None, [], []), "stage"), (("Some Name", "x", "Arts & Theatre", None, None, None, None, None, [], []), "other"),
        (("Quartet", "x", "Music", "Jazz", None, None, None, None, [], []), "live-music"), (("DJ", "x", "Music", "Dance/Electronic", None, None, None, None, [], ["ra"]), "club"), (("Old Movie", "x", "film", None, None, "35mm", "14:00", None, [], []), "film"),
    ]
    rows = tags.tagged(spark.createDataFrame([c for c, _ in cases], ddl)).collect()
    assert [r.type for r in rows] == [w for _, w in cases]
    assert rows[1].genres == ["deep-house"] and rows[4].genres == ["jazz"] and rows[6].vibe == ["analog-film", "matinee"] and rows[2].genres == ["theater"]


def test_verdicts_and_upkeep(spark):
    raw = spark.createDataFrame([("a", "great", "7", "film", "x" * 400, "sure"), ("b", "best", "1", None, None, None), ("c", "skip", None, "nope", "fine", "low")], "id string, tier string, adjust string, lane string, why string, confidence string")
    got = {r.id: (r.tier, r.adjust, r.lane, r.confidence) for r in maintain.valid_verdicts(raw, tags.LANES).collect()}
    assert got == {"a": ("great", 3, "film", "med"), "c": ("skip", 0, None, "low")}
    assert values(spark, images.clean("x"), ["http://a", "//b.example/i.png", "https://c d", None]) == [None, "https://b.example/i.png", None, None]


def test_calendar_lines(spark):
    assert sinks.fold_line("é" * 60).split("\r\n ")[0] == "é" * 37 and sinks.fold_line("é" * 60).replace("\r\n ", "") == "é" * 60
    from datetime import date

    df = spark.createDataFrame([("k", date(2026, 6, 20), "A; b, c", "Room", "10pm-2am", None)], "key string, day date, title string, venue string, start string, url string")
    entry = sinks.calendar_entries(df, "20260101T000000Z").first().entry
    assert "SUMMARY:A\\; b\\, c" in entry and "DTSTART;TZID=America/Los_Angeles:20260620T220000" in entry and "DTEND;TZID=America/Los_Angeles:20260621T020000" in entry
    assert sinks.with_freshness("# T\nx", "1 new") == "# T\n_Fresh: 1 new_\nx" and sinks.with_freshness("# T\n_Fresh: a_\nx", "b") == "# T\n_Fresh: b_\nx"
