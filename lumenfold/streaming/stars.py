"""Reactions as a stream: an extension of the batch operators, with the same results once a log has been read.

Log rows carry their place (``ord``); a person's state on an item is that of the row with the largest place, so rows
may arrive in any order and more than once. Rows without a person, an item, a place or a star kind say nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.operators.reactions import STAR_KINDS

#: States of a person's items, as JSON: item to place, kind and the time of the last change (0 where nothing expires).
STATE = "items string"
#: A person's items are dealt over so many states: few, as each state costs calls to its store; several, as a state is read and written as a whole.
SLOTS = 4
CHANGES = "profile string, item string, ord long, kind string"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastState(StatefulProcessor):
    """The last star, unstar or hide of a person on each item of a slot, as values that may expire one by one."""

    def __init__(self, keep: timedelta | None = None):
        self.keep = None if keep is None else int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("items", STATE, self.keep)

    def _time(self, timerValues: Any) -> int:
        return 0 if self.keep is None else timerValues.getCurrentProcessingTimeInMs()

    def _write(self, items: dict[str, list]) -> None:
        self.last.update((json.dumps(items, separators=(",", ":")),))

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        at = self._time(timerValues)
        self._write({x["item"]: [x["ord"], x["kind"], at] for x in json.loads(initialState.items_known)})

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at, found = self._time(timerValues), self.last.get()
        items = json.loads(found[0]) if found else {}
        if self.keep is not None:
            items = {k: x for k, x in items.items() if x[2] + self.keep > at}
        before: dict[str, str | None] = {}
        for r in rows:
            had = items.get(r.item)
            if had is None or r.ord > had[0]:
                before.setdefault(r.item, had and had[1])
                items[r.item] = [r.ord, r.kind, at]
        if before:
            self._write(items)
        for item, was in before.items():
            if items[item][1] != was:
                yield Row(profile=key[0], item=item, ord=items[item][0], kind=items[item][1])

    def close(self) -> None:
        pass


def _told(reactions: DataFrame) -> DataFrame:
    told = reactions.withColumn("kind", F.lower("kind")).where(F.col("kind").isin(*STAR_KINDS)).where("coalesce(item, '') <> '' and coalesce(profile, '') <> '' and ord is not null")
    return told.select("profile", "item", "ord", "kind")


def with_ordered_state(spark: SparkSession) -> SparkSession:
    """A session of its own, with the same tables and context, whose streams keep their state in RocksDB, as ``state_changes`` needs it."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if spark.conf.get(key, None) is not None:
            own.conf.set(key, spark.conf.get(key))
    own.conf.set(_STORE, _ROCKS)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a state that may expire asks for one batch after another without end
    return own


def state_changes(reactions: DataFrame, known: DataFrame | None = None, keep: timedelta | None = None) -> DataFrame:
    """A stream of (profile, item, ord, kind): each change of a person's star state on an item.

    ``known`` (profile, item, ord, kind) are rows of the log read before, from which a new stream starts; a stream that goes on from
    its checkpoint has them already. ``keep`` forgets a state that hasn't changed for so long; what comes then is a change again.
    """
    slot = F.pmod(F.xxhash64("item"), F.lit(SLOTS))
    groups = _told(reactions).withColumn("slot", slot).groupBy("profile", "slot")
    start = None
    if known is not None:
        items = F.to_json(F.collect_list(F.struct("item", "ord", "kind"))).alias("items_known")
        start = last_rows(known).withColumn("slot", slot).groupBy("profile", "slot").agg(items).groupBy("profile", "slot")
    return groups.transformWithState(LastState(keep), CHANGES, "Append", "None" if keep is None else "ProcessingTime", start)


def last_rows(log: DataFrame) -> DataFrame:
    """(profile, item, ord, kind) the row of a log, or of changes, that tells each state."""
    return _told(log).groupBy("profile", "item").agg(F.max("ord").alias("ord"), F.max_by("kind", "ord").alias("kind"))


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(window, event_type, n, value) by hour of a stream of events; rows later than ``late`` don't count."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def once(messages: DataFrame, key: str, time: str, within: str = "1 day") -> DataFrame:
    """Each message once, however often it is delivered within the time given."""
    return messages.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def read_all(stream: DataFrame, path: str) -> DataFrame:
    """What a stream has given by now: all that has come is read, added to the table in ``path`` and its checkpoint moved on.

    A second call goes on where the first ended, and one after a stop repeats nothing: the table's own log has each batch once.
    """
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
