import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenfold.operators import reactions
from lumenfold.streaming import stars as stream

LOG = "profile string, item string, ord long, kind string, extra int"


def log(seed, n=400):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", "c", None, ""]), r.choice(["x", "y", "z", None]), i if r.random() < 0.95 else None, r.choice(["star", "UNSTAR", "hide", "less", None]), 1) for i in range(n)]
    return rows + [r.choice(rows) for _ in range(60)]  # delivered twice


def states(df):
    return sorted((r.profile, r.item, r.kind) for r in df.collect())


def batch(spark, rows):
    return states(reactions.last_states(spark.createDataFrame(rows, LOG).where("ord is not null")))


def land(spark, rows, folder):
    """Rows as files of a log, in no order."""
    spark.createDataFrame(rows, LOG).repartition(3).write.mode("append").parquet(str(folder))


def test_restart_and_out_of_order_rows(spark, tmp_path):
    own, rows = stream.with_ordered_state(spark), log(1)
    random.Random(2).shuffle(rows)
    source, out = tmp_path / "log", str(tmp_path / "out")
    land(spark, rows[:150], source)
    changes = stream.state_changes(own.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(source)))
    assert states(stream.last_rows(stream.read_all(changes, out))) == batch(spark, rows[:150])
    n = spark.read.parquet(out + "/rows").count()
    stream.read_all(changes, out)  # nothing new: nothing again
    assert spark.read.parquet(out + "/rows").count() == n
    land(spark, rows[150:], source)
    land(spark, rows[:40], source)  # and a replay
    again = stream.state_changes(own.readStream.schema(LOG).parquet(str(source)))  # as after a stop
    assert states(stream.last_rows(stream.read_all(again, out))) == batch(spark, rows)


def test_a_stream_starts_from_what_is_known(spark, tmp_path):
    own, rows = stream.with_ordered_state(spark), log(3)
    known = [r for r in rows if r[2] is not None and r[2] < 250]
    land(spark, rows, tmp_path / "log")
    source = own.readStream.schema(LOG).parquet(str(tmp_path / "log"))
    before = stream.last_rows(own.createDataFrame(known, LOG))
    changes = stream.read_all(stream.state_changes(source, own.createDataFrame(known, LOG)), str(tmp_path / "out"))
    assert states(stream.last_rows(before.unionByName(changes))) == batch(spark, rows)
    was = {(r.profile, r.item): r.kind for r in before.collect()}
    assert all(was.get((r.profile, r.item)) != r.kind for r in changes.collect())  # what was known isn't told again


def test_states_expire(spark, tmp_path):
    own = stream.with_ordered_state(spark)
    source, out = tmp_path / "log", str(tmp_path / "out")
    one = lambda o: [("a", "x", o, "star", 1)]
    changes = lambda: stream.state_changes(own.readStream.schema(LOG).parquet(str(source)), keep=timedelta(seconds=20))
    land(spark, one(1), source)
    stream.read_all(changes(), out)
    land(spark, one(2), source)
    assert stream.read_all(changes(), out).count() == 1  # the same state
    time.sleep(21)
    land(spark, one(3), source)
    assert stream.read_all(changes(), out).count() == 2


def test_no_rows(spark, tmp_path):
    own = stream.with_ordered_state(spark)
    land(spark, [(None, None, None, None, None)], tmp_path / "log")
    got = stream.read_all(stream.state_changes(own.readStream.schema(LOG).parquet(str(tmp_path / "log"))), str(tmp_path / "out"))
    assert got.count() == 0 and got.columns == ["profile", "item", "ord", "kind"]


def test_hours_and_late_rows(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    days = [[(at(0, 5), "view", 1.0), (at(0, 50), "view", 2.0), (at(1, 1), "buy", 4.0)], [(at(0, 55), "view", 8.0), (at(3), "view", 16.0)], [(at(1, 30), "buy", 32.0), (at(5), "view", 64.0)]]
    source, out = tmp_path / "e", str(tmp_path / "out")
    for rows in days:  # each a file and a batch, in this order
        spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").coalesce(1).write.mode("append").parquet(str(source))
        got = stream.read_all(stream.hourly(spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(str(source))), out)
    found = sorted((r.window.start.hour, r.event_type, r.n, r.value) for r in got.collect())
    assert found == [(0, "view", 3, 11.0), (1, "buy", 1, 4.0), (3, "view", 1, 16.0)]  # 1:30 came after 3:00; the hour of 5:00 is open


def test_each_message_once(spark, tmp_path):
    at = datetime(2024, 1, 1, 12)
    source, out = tmp_path / "m", str(tmp_path / "out")
    schema = "sid string, ts timestamp, body string"
    for rows in ([("s1", at, "a"), ("s1", at, "a"), ("s2", at, "b")], [("s1", at + timedelta(hours=1), "a"), ("s3", at, "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        got = stream.read_all(stream.once(spark.readStream.schema(schema).parquet(str(source)), "sid", "ts"), out)
    assert sorted(r.sid for r in got.collect()) == ["s1", "s2", "s3"]
    assert got.where(F.col("sid") == "s1").count() == 1


def test_a_person_has_few_states_however_many_items(spark, tmp_path):
    own = stream.with_ordered_state(spark)
    rows = [("a", f"item {k}", k, r, 1) for k, r in enumerate(["star"] * 300)] + [("b", "x", 300, "hide", 1)]
    land(spark, rows, tmp_path / "log")
    changes = stream.read_all(stream.state_changes(own.readStream.schema(LOG).parquet(str(tmp_path / "log")), own.createDataFrame(rows[:100], LOG)), str(tmp_path / "out"))
    assert changes.count() == 201
    kept = own.read.format("statestore").option("stateVarName", "items").load(str(tmp_path / "out/checkpoint"))
    assert kept.count() == stream.SLOTS + 1  # a call or more to the store for each
