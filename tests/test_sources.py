from datetime import date

from pyspark.sql import functions as F

from lumenfold.sources import feeds, html
from lumenfold.streaming import stars as stream
from lumenfold.operators import reactions


def test_listing_table(spark):
    row = "<tr class=x><td>Sat: Jun 20 <br />({time})</td><td><a href='https://t.example/{n}'>{title}</a> @ {venue}<td>{genre}</td><td>{info}</td><td>{by}</td><td><a href=\"#x\">x</a> <a href=\"https://l.example/{n}\">l</a></td><td><div class='s'>{day}</div></td></tr>"
    one = {"time": "10pm-2am", "n": 1, "title": "Night @ One &amp; Co", "venue": "Room (Town)", "genre": "tech house", "info": "$10-15 | 21+", "by": "Crew", "day": "2026/6/20"}
    rows = [one, one | {"n": 2, "title": "NIGHT @ one &amp; Co", "genre": ""}, one | {"n": 3, "time": "8pm", "title": "Early", "genre": "", "info": "free", "by": ""}, one | {"n": 4, "time": "8pm", "title": "All night thing", "day": "2026/07/30"}, one | {"day": "soon"}]
    page = "<table><tr><td>a</td><td>b</td></tr>" + "".join(row.format(**r) for r in rows) + "</table>"
    df = spark.createDataFrame([(1, page)], "id long, html string")
    got = [(str(r.day), r.start, r.title, r.venue, r.genre, r.price, r.age, r.organizers, r.late, r.url, len(r.links)) for r in html.listing_table(df, "id", "html").orderBy("row").collect()]
    assert got == [
        ("2026-06-20", "10pm-2am", "Night @ One & Co", "Room (Town)", "tech house", "$10-15", "21+", "Crew", True, "https://l.example/1", 2),
        ("2026-06-20", "8pm", "Early", "Room (Town)", None, "free", None, None, False, "https://l.example/3", 2),
        ("2026-07-30", "8pm", "All night thing", "Room (Town)", "tech house", "$10-15", "21+", "Crew", True, "https://l.example/4", 2),
    ]
    assert html.listing_table(df, "id", "html", F.lit(date(2026, 7, 1)), F.lit(date(2026, 7, 30))).count() == 1


def test_cinema_sessions(spark):
    show = '<li><a href="https://c.example/purchase/{n}?t=1&amp;u=2"><time>{time}</time></a></li>'
    page = "<div>top</div>" + '<div class="film "><h3 class="title"> The Long\n Film (35mm) </h3><span class="censor">PG</span><p class="film-desc">Words &amp; more</p><img class="poster" src="/Media/p.png">' + \
        '<h4 class="date">Saturday 20, June</h4>\n<ul class="session-times">' + show.format(n=5, time="7:30 PM") + show.format(n=5, time="7:30 PM") + '<li class="x"></li><li><span class="sold-out-session"><time>10 p.m.</time></span></li></ul>' + \
        '<h4 class="date">Monday 4, January</h4><ul class="session-times">' + show.format(n=6, time="12:05 AM") + show.format(n=7, time="later") + "</ul></div>" + '<div class="film"><p>no title</p></div>'
    df = spark.createDataFrame([(1, page)], "id long, html string")
    got = html.cinema_sessions(df, "id", "html", F.lit(date(2026, 6, 1)), 400, "https://c.example", "https://c.example/all").orderBy("day", "start").collect()
    assert [(str(r.day), r.start, r.sold_out, r.url, r.url_label) for r in got] == [
        ("2026-06-20", "19:30", False, "https://c.example/purchase/5?t=1&u=2", "7:30pm"), ("2026-06-20", "22:00", True, "https://c.example/all", None), ("2027-01-04", "00:05", False, "https://c.example/purchase/6?t=1&u=2", "12:05am"),
    ]
    assert {(r.title, r.format, r.rating, r.detail, r.image) for r in got} == {("The Long Film (35mm)", "35MM", "PG", "35MM · Words & more", "https://c.example/Media/p.png")}


def test_calendar_table(spark):
    page = "<td>6/20</td><td>Band One<br>8pm $10-15</td><td>6/21</td><td>Band Two CANCELLED</td><td>1/5</td><td>New Year Act</td>"
    got = html.calendar_cells(spark.createDataFrame([(1, page)], "id long, html string"), "id", "html", F.lit(date(2026, 6, 1))).orderBy("cell").collect()
    assert [(str(r.day), r.title, r.start, r.price) for r in got] == [("2026-06-20", "Band One", "8pm", "$10-15"), ("2027-01-05", "New Year Act", None, None)]


def test_calendar_file(spark):
    body = "BEGIN:VEVENT\r\nSUMMARY:Long na\r\n me\\, here\r\nDTSTART:20260620T033000Z\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:All day\r\nDTSTART;VALUE=DATE:20260621\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:Local\r\nDTSTART;TZID=America/Los_Angeles:20260622T200000\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:East\r\nDTSTART;X=1;TZID=America/New_York:20260623T013000\r\nEND:VEVENT"
    got = feeds.calendar_events(spark.createDataFrame([(body,)], "value string")).collect()
    assert [(r.summary, str(r.day), r.start) for r in got] == [("Long name, here", "2026-06-19", "20:30"), ("All day", "2026-06-21", None), ("Local", "2026-06-22", "20:00"), ("East", "2026-06-22", "22:30")]


def test_logs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"kind": "star", "item": "x"}\n\n# note\nnot json\n{"kind": "hide", "item": "y"}\n')
    got = feeds.json_lines(spark, str(tmp_path / "a.jsonl"), "kind string, item string").orderBy("ord").collect()
    assert [(r.ord, r.kind, r.item) for r in got] == [(0, "star", "x"), (4, "hide", "y")]
    whole = "".join(f'{{"kind": "k{i}", "item": "{i * 7}"}}\n' for i in range(5000))
    (tmp_path / "b.jsonl").write_text(whole)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # lines of many blocks keep their order
    try:
        got = feeds.json_lines(spark, str(tmp_path), "kind string, item string").where("_file like '%b.jsonl'").orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.kind for r in got] == [f"k{i}" for i in range(5000)] and len({r.ord for r in got}) == 5000


def test_records(spark):
    ddl = "id string, name string, url string, localDate string, localTime string, venues array<struct<name:string,city:string>>, priceRanges array<struct<min:double,max:double>>, segment string, genre string, attractions array<struct<name:string,genre:string>>, outlets array<struct<type:string,url:string>>"
    row = ("Z1", "Late", "https://t.example/late-06-20-2026/event/Z1", "2026-06-21", "01:00:00", [("Room", "Town")], [(5.0, 9.0)], "Music", "Undefined", [("Ann", "Rock")], [("venueBoxOffice", "https://v.example")])
    r = feeds.ticket_record(spark.createDataFrame([row], ddl)).first()
    assert (r.date, r.genre, r.lineup_genre, r.price_max, [x.source for x in r.links]) == ("2026-06-20", None, "Rock", "9.0", ["venue", "ticketmaster"])
    assert feeds.windows(date(2026, 6, 1), 10, 4) == [(date(2026, 6, 1), date(2026, 6, 5)), (date(2026, 6, 5), date(2026, 6, 9)), (date(2026, 6, 9), date(2026, 6, 11))]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"p{i % 3}", f"x{i * 7 % 5}", ["star", "unstar", "hide", "seen"][i * 5 % 4]) for i in range(60)]
    ddl = "ord long, profile string, item string, kind string"
    for k in range(3):
        spark.createDataFrame(rows[2 - k :: 3], ddl).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream.state_changes(source).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.sql("select profile, item, max_by(kind, ord) as kind from changes group by all")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, reactions.last_states(spark.createDataFrame(rows, ddl)).select("profile", "item", "kind").collect()))
