"""Operator 7, substring dedup: hashing of lines.

A text's units are its lines, cut at the ends of sentences as passages also stand within lines; units of ``LEAST_WORDS``
words or more count. They are normalised (A-Z lower-cased, white space collapsed) and digested to 128 bits; equal digests are
grouped over all documents, the occurrence with the smallest document and start stays, and the others repeat it. Repeats
that follow each other, units that don't count aside, form a run, and runs of ``LEAST_RUN`` words or more are removed:
an odd sentence that many texts share is no passage. The spans that go are kept with their offsets in the original
text, code points with the end exclusive, the unit's break included.

The query works with ``whole``: units below ``LEAST_WORDS`` words are digested too; where they repeat they extend a run and go
with it, else they neither count nor break it. Lines, paragraphs (up to a blank line) and texts of ``LEAST_RUN`` words or more are
units of their own beside the sentences and go where their words as a whole were there before, wherever the breaks are.

Cases: a null text is empty; a null id ranks last, of equal ids the smaller hash of the text; rows that are equal in id and text are
one document and keep the same; texts of any length are cut whole; an empty table gives an empty result; extra columns stay in
``deduplicated``, but for one named ``removed``, and are ignored elsewhere.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import discarded, written

LEAST_WORDS = 5
LEAST_RUN = 25
_BREAK = re.compile(r"\n|[.!?][ \t]+")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def _mark(words: list[str]) -> tuple[int, int]:
    """The digest of 128 bits as two numbers."""
    return struct.unpack("<qq", blake2b(" ".join(words).translate(_FOLD).encode(), digest_size=16).digest())


def units(text: str, least: int = LEAST_WORDS) -> Iterator[tuple[int, int, int, tuple[int, int]]]:
    """(start, end, words, digest) of the units that count."""
    start = 0
    for end in [*(m.end() for m in _BREAK.finditer(text)), len(text)]:
        words = _WORDS.findall(text, start, end)
        if len(words) >= least:
            yield start, end, len(words), _mark(words)
        start = end


def numbered(text: str, least: int) -> Iterator[tuple[int, int, int, int, tuple[int, int]]]:
    """(seq, start, end, words, digest) of the units that count; seq: how many of them are before."""
    for seq, u in enumerate(units(text, least)):
        yield seq, *u


def nested(text: str, least: int, run: int) -> Iterator[tuple[int, int, int, int, tuple[int, int]]]:
    """As ``numbered``, with short units, and with seq -1 lines, paragraphs and the text, if of ``run`` words or more and more than their largest part."""
    seq = start = line = paragraph = 0
    of_line, of_paragraph, of_text = [], [], []
    sentence = longest = block = 0  # words of the largest part of each
    for end in [*(m.end() for m in _BREAK.finditer(text)), len(text)]:
        words = _WORDS.findall(text, start, end)
        if words:
            yield seq, start, end, len(words), _mark(words)
            seq += len(words) >= least
            sentence = max(sentence, len(words))
            of_line += words
        if end == len(text) or text[end - 1] == "\n":
            if len(of_line) >= run and len(of_line) > sentence:
                yield -1, line, end, len(of_line), _mark(of_line)
            longest = max(longest, len(of_line))
            of_paragraph += of_line
            if not of_line or end == len(text):
                if len(of_paragraph) >= run and len(of_paragraph) > longest:
                    yield -1, paragraph, end if of_line else line, len(of_paragraph), _mark(of_paragraph)
                block = max(block, len(of_paragraph))
                of_text += of_paragraph
                paragraph, of_paragraph, longest = end, [], 0
            line, of_line, sentence = end, [], 0
        start = end
    if len(of_text) >= run and len(of_text) > block:
        yield -1, 0, len(text), len(of_text), _mark(of_text)


def _cutter(least: int, least_run: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, rid, *u[:4], *u[4]) for doc, rid, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rid", "text")), strict=True) for u in (nested(text or "", least, least_run) if whole else numbered(text or "", least))]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "rid", "seq", "start", "end", "words", "m1", "m2"])

    return run


def repeats(docs: DataFrame, least: int = LEAST_WORDS, run: int = LEAST_RUN, whole: bool = False) -> DataFrame:
    """(rid, seq, start, end, words, keeper) of every unit that an earlier one has: all but the first by rank.

    Half a digest tells at little cost which units may repeat; only these are compared and ranked by the whole digest.
    """
    found = written(docs.select("doc_id", "rid", "text").mapInArrow(_cutter(least, run, whole), "doc_id long, rid long, seq int, start int, end int, words int, m1 long, m2 long"))
    again = found.groupBy("m1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("m1")
    some = written(found.join(again, "m1", "left_semi"))
    discarded(found)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "start")
    first = some.groupBy("m1", "m2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = some.join(first, ["m1", "m2"]).where("not (rid = first.rid and start = first.start)")
    return later.select("rid", "seq", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "words", F.col("first.doc_id").alias("keeper")).distinct()


def removed_spans(docs: DataFrame, least: int = LEAST_WORDS, run: int = LEAST_RUN, whole: bool = False) -> DataFrame:
    """(rid, spans) of documents that lose units; spans: array of (start, end, keeper), by start."""
    gone = repeats(docs, least, run, whole)
    before = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counting = F.when((F.col("seq") >= 0) & (F.col("words") >= least), 1).otherwise(0)
    island = gone.withColumn("run", F.when(F.col("seq") >= 0, F.col("seq") - F.coalesce(F.sum(counting).over(before), F.lit(0))))
    long = island.withColumn("total", F.sum("words").over(Window.partitionBy("rid", "run"))).where((F.col("seq") < 0) | (F.col("total") >= run))
    if whole:  # parts of what goes as a whole are not told again
        outer = Window.partitionBy("rid").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
        long = long.withColumn("past", F.max("end").over(outer)).where("past is null or past < end")
    return long.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "keeper"))).alias("spans"))


def deduplicated(docs: DataFrame, least: int = LEAST_WORDS, run: int = LEAST_RUN, whole: bool = False) -> DataFrame:
    """``docs`` with its ``text`` less repeated passages, and ``removed``, the spans that went (empty: none), in place of a column of that name."""
    columns = [c for c in docs.columns if c != "removed"]
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    spans = removed_spans(keyed.select("doc_id", "text", F.col("_row").alias("rid")), least, run, whole).select(F.col("rid").alias("_gone"), F.col("spans").alias("_spans"))
    out = keyed.join(spans, F.col("_row") == F.col("_gone"), "left")
    state = "struct(array(cast('' as string)) as kept, cast(0 as bigint) as at)"
    part = "concat(a.kept, array(substr(text, cast(a.at + 1 as int), cast(s.start - a.at as int))))"
    cut = f"aggregate(_spans, {state}, (a, s) -> struct({part} as kept, s.end as at), a -> concat(array_join(a.kept, ''), substr(text, cast(a.at + 1 as int))))"
    none = F.array().cast("array<struct<start: bigint, end: bigint, keeper: bigint>>")
    text = F.when(F.size("_spans") > 0, F.expr(cut)).otherwise(F.col("text"))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in columns], F.coalesce("_spans", none).alias("removed"))


def digest(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, n_removed, removed_chars, removed, kept_sha256) of each row."""
    out = deduplicated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), whole=whole)
    lengths = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), lengths.alias("removed_chars"), spans.alias("removed"), F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH parts AS (SELECT doc_id, place, piece, (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY place) - length(piece))::BIGINT AS start
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?s).*?(?:\n|[.!?][ \t]+|\z)')) AS piece,
    generate_subscripts(regexp_extract_all(coalesce(text, ''), '(?s).*?(?:\n|[.!?][ \t]+|\z)'), 1) AS place FROM documents)),
told AS (SELECT *, start + length(piece) AS stop, len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+')) AS words, ends_with(piece, chr(10)) AS ends,
    translate(trim(regexp_replace(piece, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS unit FROM parts),
sentences AS (SELECT *, coalesce(sum(words >= 5) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seq,
    coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM told),
lines AS (SELECT doc_id, line, min(start) AS start, max(stop) AS stop, sum(words) AS words, max(words) AS largest, string_agg(unit, ' ' ORDER BY place) FILTER (words > 0) AS unit FROM sentences GROUP BY ALL),
blocked AS (SELECT *, coalesce(sum((words = 0)::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM lines),
paragraphs AS (SELECT doc_id, block, min(start) AS start, coalesce(min(start) FILTER (words = 0), max(stop)) AS stop, sum(words) AS words, max(words) AS largest, string_agg(unit, ' ' ORDER BY line) FILTER (words > 0) AS unit FROM blocked GROUP BY ALL),
texts AS (SELECT doc_id, 0 AS start, max(stop) AS stop, sum(words) AS words, max(words) AS largest, string_agg(unit, ' ' ORDER BY block) FILTER (words > 0) AS unit FROM paragraphs GROUP BY doc_id),
units AS (SELECT doc_id, seq, start, stop, words, unit FROM sentences WHERE words > 0
  UNION ALL SELECT doc_id, -1, start, stop, words, unit FROM lines WHERE words >= 25 AND words > largest
  UNION ALL SELECT doc_id, -1, start, stop, words, unit FROM paragraphs WHERE words >= 25 AND words > largest
  UNION ALL SELECT doc_id, -1, start, stop, words, unit FROM texts WHERE words >= 25 AND words > largest),
again AS (SELECT * FROM units QUALIFY row_number() OVER (PARTITION BY unit ORDER BY doc_id, start) > 1),
runs AS (SELECT *, CASE WHEN seq >= 0 THEN seq - coalesce(sum((seq >= 0 AND words >= 5)::INT) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS run FROM again),
long AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS total FROM runs QUALIFY seq < 0 OR total >= 25),
gone AS (SELECT doc_id, start, stop, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM long QUALIFY past IS NULL OR past < stop),
cuts AS (SELECT doc_id, count(*) AS n, sum(stop - start)::BIGINT AS chars, string_agg(start || ':' || stop, ',' ORDER BY start) AS spans FROM gone GROUP BY doc_id),
kept AS (SELECT p.doc_id, string_agg(piece, '' ORDER BY place) FILTER (g.doc_id IS NULL) AS text FROM parts p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.start >= g.start AND p.start + length(piece) <= g.stop AND length(piece) > 0 GROUP BY p.doc_id)
SELECT k.doc_id, coalesce(n, 0) AS n_removed, coalesce(chars, 0)::BIGINT AS removed_chars, coalesce(spans, '') AS removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM kept k LEFT JOIN cuts c ON k.doc_id = c.doc_id
"""
