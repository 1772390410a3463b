"""Operator 10, packing: cutting-stock column generation over the histogram of piece lengths.

A document's tokens (its ids, then the end id) are cut into whole sequences and a remainder. Remainders are counted
by length, rounded up to ``GRAIN``; a linear program chooses patterns, multisets of lengths that fit a sequence, so
that every length is covered by as few sequences as possible. Its columns are priced by a knapsack dynamic program over
the capacity and enter a revised simplex until the sequences used are within ``GAP`` of the bound from the dual values. The patterns, rounded
down, take most pieces; first-fit on the histogram packs what is left. All of this happens on at most
``capacity / GRAIN`` counts. Then pieces are ranked within their length, by parts of bounded size, and the k-th piece of a
length takes the k-th slot for it. Offsets are running sums of true lengths, so sequences have no gaps.

Token ids come from the byte-level BPE of a ``tokenizers`` file. Its pre-tokens are found by regular expression and
looked up in a bounded cache; unknown ones are merged by the same vocabulary's ranks. Texts with characters outside
what the plain expression covers go to the tokenizer whole, so ids are always the tokenizer's.

Cases: a null text is empty and has the end id alone; repeated rows are documents of their own; extra columns are
ignored; an empty table gives an empty result; a text of any length is cut into as many pieces as it needs.
"""

from __future__ import annotations

import json
import math
import re
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import returning, small_batches, written

CAPACITY = 1024
GRAIN = 4
GAP = 0.002
SMOOTH = 0.5
PART_PIECES = 1 << 16
CACHE = 300_000

#: Where a text has only these characters, the plain expression splits it as the tokenizer does.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xffŒœ‘-”–—…]*")
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies, by the published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Little-endian unsigned 32-bit ids of texts."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.whole = Tokenizer.from_str(text)
        self.whole.encode_special_tokens = True
        letters = _byte_letters()
        told = json.loads(text)
        ranks, added = {}, {t["id"] for t in told["added_tokens"]}
        for piece, i in told["model"]["vocab"].items():
            if i not in added:
                ranks[bytes(letters[c] for c in piece)] = i
        self.core = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = np.array(self.core.encode_single_piece(piece.encode()), "<u4").tobytes()
        if len(self.known) < CACHE:
            self.known[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            get, make = self.known.get, self._piece
            return b"".join([get(p) or make(p) for p in _PIECE.findall(text)])
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


#: Of this worker process, which serves many tasks.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _cutter(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, total, crcs = batch.column("doc_id"), [], []
            for text in batch.column("text").to_pylist():
                data = encoder.ids(text or "") + last
                view = memoryview(data)
                total.append(len(data) // 4)
                crcs.append([zlib.crc32(view[a : a + 4 * capacity]) for a in range(0, len(data), 4 * capacity)])
            yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])

    return run


def _priced(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of lengths 1.. of greatest value that fits ``capacity``: an unbounded knapsack by dynamic programming."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    useful = np.flatnonzero(values > 1e-12)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fit = useful[useful < c]
        if len(fit):
            got = best[c - 1 - fit] + values[fit]
            k = int(got.argmax())
            if got[k] > best[c] + 1e-12:
                best[c], choice[c] = got[k], fit[k] + 1
    pattern, c = np.zeros(len(values), int), capacity
    while c > 0:
        if choice[c]:
            pattern[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return best[capacity], pattern


def cutting_stock(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that cover ``demand`` (counts of lengths 1..capacity) exactly, with few patterns' uses."""
    lengths = np.flatnonzero(demand) + 1
    need = demand[lengths - 1].astype(float)
    if not len(lengths):
        return []
    # The basis to start from: greedy patterns, longest first, each used until a length runs out. That length isn't in
    # later patterns, so the columns are independent; lengths that run out together get a column of their own, unused.
    left, basic, amount = need.copy(), [], []
    while left.any():
        column, room = np.zeros(len(lengths), int), capacity
        for i in np.flatnonzero(left)[::-1]:
            column[i], room = min(room // lengths[i], math.ceil(left[i])), room - min(room // lengths[i], math.ceil(left[i])) * lengths[i]
        on = column > 0
        times = (left[on] / column[on]).min()
        gone = on & (left - times * column <= 1e-9 * need)
        left = np.where(gone, 0, left - times * column)
        first = np.flatnonzero(gone)
        basic += [column] + [np.eye(len(lengths), dtype=int)[i] for i in first[1:]]
        amount += [times] + [0.0] * (len(first) - 1)
    amount = np.array(amount)
    inverse = np.linalg.inv(np.array(basic, float).T)
    centre, bound = lengths / capacity, float((need * lengths).sum() / capacity)
    for _ in range(20 * len(lengths) + 200):
        prices = inverse.sum(0)
        if amount.sum() <= bound * (1 + GAP):
            break
        # Priced between the centre, the dual values of the best bound yet, and the current ones: these alone swing widely.
        smooth = SMOOTH * centre + (1 - SMOOTH) * prices
        values = np.zeros(capacity)
        values[lengths - 1] = smooth
        worth, pattern = _priced(values, capacity)
        if need @ smooth / max(worth, 1) > bound:
            centre, bound = smooth / max(worth, 1), float(need @ smooth / max(worth, 1))
        if prices @ pattern[lengths - 1] <= 1 + 1e-9:
            values[lengths - 1] = prices
            worth, pattern = _priced(values, capacity)
            bound = max(bound, float(need @ prices / max(worth, 1)))
            if worth <= 1 + 1e-9:
                break
        column = pattern[lengths - 1]
        step = inverse @ column
        ok = step > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, np.maximum(amount, 0) / np.where(ok, step, 1), np.inf)
        out = int(ratio.argmin())
        amount = amount - ratio[out] * step
        amount[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        basic[out] = column
    else:
        warnings.warn(f"column generation stopped {amount.sum() / bound - 1:.2%} over its bound; the plan is whole, but not the least", stacklevel=2)
    left = demand[lengths - 1].astype(np.int64)
    plan: list[tuple[np.ndarray, int]] = []

    def use(column: np.ndarray, times: int) -> None:
        nonlocal left
        if times > 0 and column.any():
            full = np.zeros(capacity, int)
            full[lengths - 1] = column
            left = left - times * column
            plan.append((full, times))

    for k in np.argsort(-amount, kind="stable"):
        column, on = basic[k], basic[k] > 0
        use(column, min(int(amount[k] + 1e-9), int((left[on] // column[on]).min())) if on.any() else 0)
    while left.any():  # first fit, longest first, as often as the pieces left allow
        column, room = np.zeros(len(lengths), int), capacity
        for i in range(len(lengths) - 1, -1, -1):
            k = min(room // lengths[i], left[i])
            column[i], room = k, room - k * lengths[i]
        on = column > 0
        use(column, int((left[on] // column[on]).min()))
    return plan


def _slots(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, slots a sequence, first sequence, place of the length in it) by length and pattern."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        for place, i in enumerate(np.flatnonzero(pattern)):
            a = int(pattern[i])
            rows.append((int(i) + 1, used.get(i, 0), a, sequence, place))
            used[i] = used.get(i, 0) + a * times
        sequence += times
    return rows


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece."""
    spark = docs.sparkSession
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(returning(_cutter(tokenizer, capacity, end_id)), "doc_id long, doc_tokens long, crcs array<long>")
    cut = cut.withColumn("salt", F.xxhash64("doc_id", "doc_tokens", "crcs"))
    piece = cut.select("doc_id", "doc_tokens", "salt", F.posexplode("crcs").alias("k", "ids_crc32"))
    piece = piece.withColumn("start", F.col("k").cast("long") * capacity)
    piece = piece.withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - F.col("start")))
    with small_batches(spark):
        piece = written(piece.withColumn("class", F.ceil(F.col("length") / GRAIN).cast("int")))
    parts = 64 + piece.count() // PART_PIECES
    piece = piece.withColumn("part", F.pmod(F.xxhash64("salt", "k"), F.lit(parts)))

    counts = piece.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    units = capacity // GRAIN
    demand = np.zeros(units, np.int64)
    for c, n in counts.groupBy("class").agg(F.sum("n")).collect():  # capacity / GRAIN rows at most
        demand[c - 1] = n
    slots = _slots(cutting_stock(demand, units))
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    firsts = counts.select("class", "part", (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    ranges: dict[int, list] = {}
    for c, first, a, sequence, place in slots:
        ranges.setdefault(c, []).append((first, a, sequence, place))
    where = spark.createDataFrame([(c, r) for c, r in ranges.items()] or [(0, [])], "class int, slots array<struct<first: long, a: long, sequence: long, place: long>>")

    ranked = piece.withColumn("turn", F.row_number().over(Window.partitionBy("class", "part").orderBy("salt", "doc_id", "start")) - 1)
    ranked = ranked.join(firsts, ["class", "part"]).withColumn("rank", F.col("turn") + F.col("before"))
    ranked = ranked.join(F.broadcast(where), "class")
    ranked = ranked.withColumn("slot", F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("rank")), -1))
    sequence = F.col("slot.sequence") + F.floor((F.col("rank") - F.col("slot.first")) / F.col("slot.a"))
    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.cast("long").alias("sequence_id"), F.col("slot.place").alias("place"), F.col("rank"))
    order = Window.partitionBy("sequence_id").orderBy("place", "rank").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.sum("length").over(order) - F.col("length")).alias("offset"))
