"""Operator 12, vector codes: vectors are cut into parts, and each part is told by the nearest entry of its position's integer codebook.

Components become whole numbers once and are written; codebooks, ``PARTS`` times ``ENTRIES`` vectors whatever the data, are broadcast. Arrow
batches get all distances of their parts to a codebook as |x|² - 2 x·e + |e|² by products of int64 matrices, which are exact; the first least one is
the code. A round sums parts by entry within a task, merges the sums of all tasks by a grouped shuffle and takes floors of the means, of which the
driver sees as many as codebooks hold.

Cases: vectors that are null or have null, NaN or infinite components are dropped, and so are those that can't be coded: empty ones and those of
another length than that of the smallest kept id (equal ids by components, null ids last). Where a length isn't a multiple of ``PARTS``, part k starts at
floor(k * length / PARTS). Components so large that sums of squares might not fit 64 bits (beyond 2^27 after scaling, for 64 components) count as not
finite. Fewer vectors than entries make smaller codebooks, equal entries are entries each (the first gets the parts), an empty table or one without
such vectors gives an empty result. Null and repeated ids and equal rows are rows each. Null labels are one label. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: A label with more than one row of so many has its sum broadcast; there are fewer such labels than this.
HEAVY = 1024

#: By part the entries, a row each.
Codebooks = list[np.ndarray]


def _cuts(length: int) -> list[int]:
    return [k * length // PARTS for k in range(PARTS + 1)]


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x): vectors of finite components as whole numbers, floor(SCALE * component), in a written table."""
    bound = 2.0**40  # so that the cast is exact; what sums of squares allow is less, and depends on the length
    fit = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < bound)) & (F.size("embedding") > 0)
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return written(vectors.where(F.col("embedding").isNotNull() & fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")))


def of_one_length(rows: DataFrame) -> tuple[DataFrame, Codebooks]:
    """The rows that can be coded, and codebooks of the first of them by id."""
    order = [F.col("vec_id").asc_nulls_last(), "x"]
    first = rows.orderBy(*order).select("x").first()
    length = len(first[0]) if first else PARTS
    most = isqrt(2**62 // (4 * length))
    rows = rows.where((F.size("x") == length) & F.forall("x", lambda c: F.abs(c) <= most))
    start = np.array([r[0] for r in rows.orderBy(*order).select("x").limit(ENTRIES).collect()], np.int64).reshape(-1, length)
    at = _cuts(length)
    return rows, [start[:, a:b].copy() for a, b in zip(at[:-1], at[1:], strict=True)]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy().astype(np.int64, copy=False).reshape(len(column), -1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row of ``x`` the first nearest entry and the squared distance to it."""
    far = (entries * entries).sum(1)[None, :] - 2 * (x @ entries.T)
    best = far.argmin(1)
    return best, far[np.arange(len(x)), best] + (x * x).sum(1)


def _sums(books):
    """Sums and counts of the parts by entry, over all batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks: Codebooks = books.value
        sums, counts = [np.zeros_like(e) for e in codebooks], [np.zeros(len(e), np.int64) for e in codebooks]
        at = np.cumsum([0, *(e.shape[1] for e in codebooks)])
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch)
            for k, entries in enumerate(codebooks):
                part = np.ascontiguousarray(x[:, at[k] : at[k + 1]])
                best, _ = nearest(part, entries)
                np.add.at(sums[k], best, part)
                counts[k] += np.bincount(best, minlength=len(entries))
        for k, (total, n) in enumerate(zip(sums, counts, strict=True)):
            entry, place = np.indices(total.shape)
            used = n[entry] > 0
            many = int(used.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(many, k)), pa.array(entry[used]), pa.array(place[used]), pa.array(total[used]), pa.array(n[entry][used])], ["part", "entry", "place", "total", "n"])

    return run


def refined(rows: DataFrame, codebooks: Codebooks) -> Codebooks:
    """Codebooks of the floors of the means of the parts that each entry is nearest to; unused entries stay."""
    books = rows.sparkSession.sparkContext.broadcast(codebooks)  # PARTS * ENTRIES entries
    found = rows.select("x").mapInArrow(_sums(books), "part long, entry long, place long, total long, n long")
    out = [e.copy() for e in codebooks]
    for part, entry, place, total, n in found.groupBy("part", "entry", "place").agg(F.sum("total"), F.sum("n")).collect():  # a row a number of the codebooks
        out[part][entry, place] = total // n
    return out


def _coder(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks: Codebooks = books.value
        at = np.cumsum([0, *(e.shape[1] for e in codebooks)])
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch)
            codes, errors = np.zeros((len(x), len(codebooks)), np.uint8), np.zeros(len(x), np.int64)
            for k, entries in enumerate(codebooks):
                best, far = nearest(np.ascontiguousarray(x[:, at[k] : at[k + 1]]), entries)
                codes[:, k] = best
                errors += far
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)], ["vec_id", "label", "codes", "error"])

    return run


def trained(vectors: DataFrame) -> tuple[DataFrame, Codebooks]:
    """The rows that can be coded, and codebooks after ``ROUNDS`` rounds."""
    rows, codebooks = of_one_length(whole(vectors))
    for _ in range(ROUNDS):
        codebooks = refined(rows, codebooks)
    return rows, codebooks


def coded(rows: DataFrame, codebooks: Codebooks) -> DataFrame:
    """(vec_id, label, codes, error) of rows of whole numbers: a byte a part, and the squared distances to the entries, summed over parts."""
    books = rows.sparkSession.sparkContext.broadcast(codebooks)
    return rows.select("vec_id", "label", "x").mapInArrow(_coder(books), "vec_id long, label long, codes binary, error long")


def decoded(codes: bytes, codebooks: Codebooks) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([entries[c] for c, entries in zip(codes, codebooks, strict=True)]) / SCALE


def digest_of(codebooks: Codebooks) -> str:
    """The sha256 of all numbers by part, entry and place, in decimal."""
    return hashlib.sha256(",".join(str(int(v)) for entries in codebooks for v in entries.ravel()).encode()).hexdigest()


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` (a written table) with ``label_error``, the sum of ``error`` over rows of the label.

    Labels of a large share of the rows, fewer than ``HEAVY``, have their sums broadcast; rows of others are joined with them by label.
    """
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")).withColumnRenamed("label", "of")
    sums = written(sums)
    total = sums.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") > total / HEAVY
    out = rows.join(F.broadcast(sums.where(large).select("of", F.col("label_error").alias("heavy"))), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    light = out.where("heavy is null").join(sums.where(~large).select("of", "label_error"), F.col("label").eqNullSafe(F.col("of")))
    return out.where("heavy is not null").select(*rows.columns, F.col("heavy").alias("label_error")).union(light.select(*rows.columns, "label_error"))


def compressed(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each vector that can be coded."""
    rows, codebooks = trained(vectors)
    out = with_label_errors(written(coded(rows, codebooks)))
    return out.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest_of(codebooks)).alias("codebooks_sha256"))


def _sql_round(k: int) -> str:
    """A codebook's assignment, and the codebook that comes of it."""
    nearest = f"""near{k} AS (SELECT p.rid, p.part, arg_min(b.entry, (list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry)) AS entry,
  min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS error FROM parts p JOIN book{k} b USING (part) GROUP BY p.rid, p.part)"""
    if k == ROUNDS:
        return nearest
    return f"""{nearest}, means{k} AS (SELECT part, entry, list(mean ORDER BY place) AS x FROM (SELECT part, entry, place, (CASE WHEN s < 0 AND s % n <> 0 THEN s // n - 1 ELSE s // n END)::BIGINT AS mean
  FROM (SELECT part, entry, place, sum(v)::HUGEINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM near{k} JOIN parts USING (rid, part)) GROUP BY ALL)) GROUP BY ALL),
book{k + 1} AS (SELECT part, entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m USING (part, entry))"""


SQL = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT rid, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] AS x FROM (SELECT rid, x, unnest(range({PARTS})) AS part FROM kept)),
book0 AS (SELECT part, rid - 1 AS entry, x FROM parts WHERE rid <= {ENTRIES}), {", ".join(_sql_round(k) for k in range(ROUNDS + 1))},
told AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM near{ROUNDS} GROUP BY rid),
hashed AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM told JOIN kept USING (rid), hashed"""
