"""Shared pieces of the corpus operators: vectorised word and shingle hashing, written tables and components.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z; all of them are found
and hashed with numpy over whole Arrow batches, never character by character in Python.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import cache, wraps
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch of texts, as workers hold a batch several times.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Links that one task of a round of components handles.
TASK_LINKS = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="corpus-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or one of our own where that is unset and Spark runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:  # a local session without one: a folder for the process, as the setting can't be changed once a session runs
        base = _own_folder()
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lumenfold_path = path
    return back


def discarded(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._lumenfold_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession):
    """Within it, Arrow batches have ``BATCH_ROWS`` rows at most; it holds for what is run there."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, which at its end gives free memory back to the system, as its worker goes on to other tasks."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser over uint64, with a seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS = mix(np.arange(1 << 12, dtype=np.uint64), 7) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = mix(np.arange(2 * n, dtype=np.uint64), 7) | np.uint64(1)
    return _POWERS


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole texts of about ``limit`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, buf[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, and by text the number of the first word; then starts and ends of words."""
    low = _LOWER[buf]
    word = _WORD[low]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(buf), dtype=bool)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(buf), dtype=bool)
    after[-1:] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts, starts, ends
    lens = ends - starts
    inside = np.flatnonzero(word)
    shift = np.cumsum(lens) - lens
    place = np.arange(len(inside)) - np.repeat(shift, lens)
    with np.errstate(over="ignore"):
        parts = (low[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(lens.max()))[place]
        return mix(np.add.reduceat(parts, shift) + lens.astype(np.uint64)), firsts, starts, ends


_SHINGLE = mix(np.arange(64, dtype=np.uint64), 11) | np.uint64(1)


def shingle_arrays(texts: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """For each text in turn its distinct shingle hashes, ascending; a text of fewer words is one shingle."""
    for first, last, buf, offsets in text_chunks(texts):
        h, firsts, _, _ = word_hashes(buf, offsets)
        with np.errstate(over="ignore"):
            many = max(0, len(h) - words + 1)
            s = np.zeros(many, np.uint64)
            for k in range(words):
                s += h[k : k + many] * _SHINGLE[k]
            s = mix(s, 3)
            for i in range(last - first):
                a, b = int(firsts[i]), int(firsts[i + 1])
                if b - a >= words:
                    yield np.unique(s[a : b - words + 1])
                elif b > a:
                    yield mix((h[a:b] * _SHINGLE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a), 5)
                else:
                    yield np.zeros(0, np.uint64)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Alternating large-star and small-star steps, each written to the shared folder; links never reach the driver.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct()
            )
        mark = seen
        parts = 1 + seen[0] // TASK_LINKS  # few links need few tasks, however many partitions shuffles have
        before, now = now, now.coalesce(parts)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts)
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.coalesce(parts).union(least.select("u", "m")).coalesce(parts).distinct().coalesce(parts))
        discarded(before)
