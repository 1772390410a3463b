"""Operator 9, embedding near-dedup: a subspace pigeonhole join.

Unit vectors of cosine c or more lie within squared distance 2 - 2c. They are rotated (random signs and a Walsh-Hadamard
transform, whose fixed order of additions gives the same bits in every task) and split into blocks of ``BLOCK``
dimensions; by pigeonhole a near pair is within the proportional share of that budget in at least one block. Each block
is range-joined: a grid over its first two coordinates, as wide as the block's radius, brings together what can be within
it. There vectors are split at the median of their widest coordinate into leaves of ``LEAF``, and only leaves whose boxes are
within the radius over all of the block's coordinates are compared, by the whole block's distance. The union of the blocks'
candidates is verified with the cosine in double precision, each pair in the first block that selects it.

Equal vectors are joined beforehand and counted. A task yields for each vector the number it links with and links
to a local root, so its output is linear however many pairs a hot group has. Grid cells are split into units of
``UNIT`` vectors; other vectors of a cell stream past them by batches.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept;
vectors of different lengths don't link; a null id takes part, but never names a component; repeated rows are vectors
that link; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import connected_components, mix, written

BLOCK = 8
UNIT = 8192
SLACK = 1e-9
LEAF = 256
#: More than what distances of a block's coordinates, at most 1 each, can be off by in single precision.
ROUGH = 1e-5
_FORWARD = ((0, 1), (1, -1), (1, 0), (1, 1))


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors (rows), rotated; padded with zeros to a power of two of dimensions."""
    wide = max(BLOCK, 1 << max(0, vectors.shape[1] - 1).bit_length())
    x = np.zeros((len(vectors), wide))
    x[:, : vectors.shape[1]] = vectors
    x /= np.abs(x).max(1, keepdims=True)
    s = x * x
    while s.shape[1] > 1:
        s = s[:, : s.shape[1] // 2] + s[:, s.shape[1] // 2 :]
    x /= np.sqrt(s)
    for turn in range(2):
        x *= 1.0 - 2.0 * (mix(np.arange(wide, dtype=np.uint64), 40 + turn) & np.uint64(1)).astype(float)
        step = 1
        while step < wide:
            y = x.reshape(len(x), -1, 2, step)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), wide)
            step *= 2
        x *= 1 / math.sqrt(wide)
    return x


def _budget(cosine: float, wide: int) -> float:
    return (2 - 2 * cosine) * BLOCK / wide + SLACK


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    """Vectors out of their bytes, in double precision whatever they came in."""
    return np.stack([np.frombuffer(v, "<f8" if len(v) == 8 * size else "<f4") for v in column.to_pylist()]).reshape(-1, size).astype("<f8")


def leaves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows of ``x``, where the leaves start in it (and the last ends), and their boxes' least and most."""
    order, cuts, todo = np.arange(len(x)), [], [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= LEAF:
            cuts.append(lo)
            continue
        part = x[order[lo:hi]]
        mid = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, np.argmax(part.max(0) - part.min(0))], mid)]
        todo += [(lo, lo + mid), (lo + mid, hi)]
    cuts = np.array(sorted(cuts))
    return order, np.append(cuts, len(x)), np.minimum.reduceat(x[order], cuts), np.maximum.reduceat(x[order], cuts)


def _cells(cosine: float, kind: str):
    """For each vector and block its home cell: (size, block, x, y, rid, many, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("embedding").to_pylist()], int)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                raw = np.array(part.column("embedding").to_pylist(), float).reshape(-1, size)
                x = rotated(raw)
                blobs = [v.tobytes() for v in raw.astype(kind)]
                side = math.sqrt(_budget(cosine, x.shape[1]))
                for b in range(x.shape[1] // BLOCK):
                    c = np.floor(x[:, b * BLOCK : b * BLOCK + 2] / side).astype(np.int32)
                    many = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array([int(size)] * many, pa.int32()), pa.array([b] * many, pa.int32()), pa.array(c[:, 0]), pa.array(c[:, 1]), part.column("rid"), part.column("many"), pa.array(blobs, pa.binary())], ["size", "block", "x", "y", "rid", "many", "vector"])

    return run


class _Unit:
    """The home vectors of a unit; gathers links."""

    def __init__(self, size: int, block: int, cosine: float):
        self.size, self.block, self.cosine = size, block, cosine
        self.raw, self.rid, self.many = np.zeros((0, size)), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.x = self.tree = None
        self.links: dict[int, int] = {}
        self.edges: set[tuple[int, int]] = set()

    def add(self, raw: np.ndarray, rid: np.ndarray, many: np.ndarray) -> None:
        self.raw, self.rid, self.many = np.concatenate([self.raw, raw]), np.concatenate([self.rid, rid]), np.concatenate([self.many, many])
        self.x = self.tree = None

    def meet(self, raw: np.ndarray, rid: np.ndarray, many: np.ndarray, itself: bool = False) -> None:
        if not len(self.rid) or not len(rid):
            return
        if self.x is None:
            self.x = rotated(self.raw)
            self.norm = np.sqrt((self.raw * self.raw).sum(1))
        x, norm = (self.x, self.norm) if itself else (rotated(raw), np.sqrt((raw * raw).sum(1)))
        budget = _budget(self.cosine, x.shape[1])
        at = slice(self.block * BLOCK, (self.block + 1) * BLOCK)
        if self.tree is None:
            self.tree = leaves(self.x[:, at])
        order, cuts, least, most = self.tree
        other, ends, low, high = self.tree if itself else leaves(x[:, at])
        a, b = self.x[order, at], x[other, at]
        # |a - b|^2 <= budget where a.b - |b|^2 / 2 >= (|a|^2 - budget) / 2; the second term is a column more.
        enough = (((a * a).sum(1) - budget - ROUGH) / 2).astype("<f4")
        b = np.concatenate([b, -(b * b).sum(1, keepdims=True) / 2], 1).astype("<f4")
        a = np.concatenate([a, np.ones((len(a), 1))], 1).astype("<f4")
        for leaf, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            gap = np.maximum(0, np.maximum(least[leaf] - high, low - most[leaf]))
            close = np.flatnonzero((gap * gap).sum(1) <= budget + ROUGH)
            if itself:
                close = close[close >= leaf]
            if not len(close):
                continue
            to = np.concatenate([np.arange(ends[c], ends[c + 1]) for c in close])
            i, k = np.nonzero(a[lo:hi] @ b[to].T >= enough[lo:hi, None])
            i, k = i + lo, to[k]
            if itself:
                keep = i < k
                i, k = i[keep], k[keep]
            i, k = order[i], other[k]
            for cut in range(0, len(i), 50_000):
                self._verify(i[cut : cut + 50_000], k[cut : cut + 50_000], raw, x, norm, rid, many, budget)

    def _verify(self, i, k, raw, x, norm, rid, many, budget) -> None:
        ok = (self.raw[i] * raw[k]).sum(1) / (self.norm[i] * norm[k]) >= self.cosine
        i, k = i[ok], k[ok]
        if not len(i):
            return
        apart = (self.x[i] - x[k]) ** 2
        apart = apart.reshape(len(i), -1, BLOCK).sum(2) <= budget
        ok = apart[:, self.block] & ~apart[:, : self.block].any(1)
        a, b = self.rid[i[ok]], rid[k[ok]]
        for own, other in ((a, many[k[ok]]), (b, self.many[i[ok]])):
            keys, place = np.unique(own, return_inverse=True)
            for key, n in zip(keys.tolist(), np.bincount(place, other).astype(np.int64).tolist(), strict=True):
                self.links[key] = self.links.get(key, 0) + n
        self._join(a, b)

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Replace links by as many as connect the same vectors: each to the least that it is linked with, and those."""
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        while len(lo):
            order = np.lexsort((lo, hi))
            lo, hi = lo[order], hi[order]
            first = np.concatenate([[True], hi[1:] != hi[:-1]])
            least = lo[first][np.cumsum(first) - 1]
            self.edges.update(zip(hi[first].tolist(), lo[first].tolist(), strict=True))
            rest = least != lo
            lo, hi = np.minimum(least[rest], lo[rest]), np.maximum(least[rest], lo[rest])
            if len(lo):
                pairs = np.unique(np.stack([lo, hi]), axis=1)
                lo, hi = pairs[0], pairs[1]


def _joiner(cosine: float):
    """Rows sorted by unit, homes (role 0) first: yields (rid, links, other)."""

    def out(unit: _Unit) -> pa.RecordBatch:
        rows = [(k, n, None) for k, n in unit.links.items()] + [(a, 0, b) for a, b in unit.edges]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["rid", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit, closed = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "block", "x", "y", "unit")], 1)
            roles = batch.column("role").to_numpy(zero_copy_only=False)
            marks = np.concatenate([ids, roles[:, None]], 1)
            cuts = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1, [len(marks)]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if tuple(ids[lo]) != key:
                    if unit is not None:
                        if not closed:
                            unit.meet(unit.raw, unit.rid, unit.many, True)
                        yield out(unit)
                    key, unit, closed = tuple(ids[lo]), _Unit(int(ids[lo][0]), int(ids[lo][1]), cosine), False
                part = batch.slice(lo, hi - lo)
                got = _vectors(part.column("vector"), unit.size), part.column("rid").to_numpy(), part.column("many").to_numpy()
                if roles[lo] == 0:
                    unit.add(*got)
                    continue
                if not closed:
                    unit.meet(unit.raw, unit.rid, unit.many, True)
                    closed = True
                unit.meet(*got)
        if unit is not None:
            if not closed:
                unit.meet(unit.raw, unit.rid, unit.many, True)
            yield out(unit)

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors`` (vec_id, embedding)."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.withColumn("good", F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    reps = v.where("good").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("many"))
    hashed = F.xxhash64("embedding")
    same = F.count(F.lit(1)).over(Window.partitionBy("least", F.when(F.col("least").isNull(), hashed)))
    reps = written(reps.withColumn("rid", F.when(F.col("least").isNotNull() & (same == 1), F.col("least")).otherwise(hashed)))
    homes = reps.select("rid", "many", "embedding").mapInArrow(_cells(cosine, kind), "size int, block int, x int, y int, rid long, many long, vector binary")
    # Cells of a block: the square of twice the inverse radius at most, so written they are small, and joined by broadcast if so.
    counts = written(homes.groupBy("size", "block", "x", "y").agg(F.ceil(F.count(F.lit(1)) / UNIT).alias("units")))
    cell = ["size", "block", "x", "y"]
    homes = homes.withColumn("hash", F.xxhash64("rid"))
    own = homes.join(counts, cell).withColumn("mine", F.pmod("hash", "units"))
    own = own.withColumn("unit", F.explode(F.sequence("mine", F.col("units") - 1))).withColumn("role", (F.col("unit") > F.col("mine")).cast("int"))
    away = homes.withColumn("to", F.explode(F.array(*[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y")) for dx, dy in _FORWARD])))
    away = away.withColumns({"x": F.col("to.x"), "y": F.col("to.y")}).join(counts, cell).withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1))).withColumn("role", F.lit(1))
    names = [*cell, "unit", "role", "rid", "many", "vector"]
    rows = own.select(*names).unionByName(away.select(*names)).repartition(*cell, "unit").sortWithinPartitions(*cell, "unit", "role")
    found = written(rows.mapInArrow(_joiner(cosine), "rid long, links long, other long"))
    links = found.where("other is null").groupBy("rid").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("other is not null").select(F.col("rid").alias("a"), F.col("other").alias("b")))
    reps = reps.join(links, "rid", "left").join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    smallest = reps.groupBy("component").agg(F.min("least").alias("component_id"))
    reps = reps.join(smallest, "component").select(F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    out = v.where("good").join(reps, F.col("embedding") == F.col("e")).select("vec_id", "n_links", "component_id")
    alone = v.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE good AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS hop FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.hop = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN (SELECT node, min(hop) AS component_id FROM reach GROUP BY node) r ON e.vec_id = r.node
"""
