"""Operator 1, n-gram Jaccard join: a token-group matrix over shingle sets.

Similar documents are put into groups (a min-hash brings them together, an exact check against the group's
leader admits them); a set whose min-hash no other row has is a group of its own, and stays in the task that reads it. A token matters only where sets of different components have it; a set with too few such
tokens links with nothing outside its component and is put aside, first by groups, then by the components that sure
links make of them. What remains is the matrix: tokens that the same sets have are one column with a weight, and each group has the
union of its members' tokens. A set is a query on the groups that share one of its rarest columns where what
both still have after that column allows a link; the number of its tokens in a group's union bounds its overlap
with any member, and only groups whose bound reaches the threshold are opened and compared member by member, exactly.

No link is lost: with threshold t = percent/100 two sets share at least t times the larger one's size, so each has at
least so many tokens of other components; under one order of columns their first common one is among the first
c - t n + 1 tokens of each, c being the number of a set's tokens that count; and all they share stands at or after it in both.

Only components are computed: links are searched between components that aren't joined yet, so there is no count or list of
all links, or of pairs of different sets, within one.

Cases: a null text is empty; a document without words has an empty set, links with nothing and is its own
component. Equal sets are linked. Repeated rows give repeated result rows. A null id is allowed and takes part
in links; ids of components are the smallest that isn't null. Very long texts are sets like others. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import connected_components, discarded, mix, returning, shingle_arrays, small_batches, written

GROUP_MEMBERS = 256
QUERIES_A_TASK = 256
#: Tokens that a task gathers before it deals them out, and tokens of one range that meet in a task.
PART_TOKENS = 1 << 20
RANGE_TOKENS = 1 << 22
#: Bits that tokens have beyond those that tell all of them apart by number.
SPARE_BITS = 24
#: Bits that tell which rows may share their min-hash with others; a bit set by chance only moves a text.
MET_BITS = 1 << 25
_COMPONENT = "coalesce(component, gid)"


def _frame(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema, strict=True)], schema=schema)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("mh", pa.int64())])
_SKETCH_DDL = "doc_id long, rid long, n long, s1 long, s2 long, mh long"


def _sums_of(tokens: np.ndarray) -> tuple[int, int]:
    """Two sums that tell sets apart."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(tokens, seed).sum(dtype=np.uint64).view(np.int64)) for seed in (21, 22))


def _sketch_of(tokens: np.ndarray) -> tuple[int, int, int]:
    if not len(tokens):
        return 0, 0, 0
    with np.errstate(over="ignore"):
        key = mix(np.array([mix(tokens, 23).min() * np.uint64(3) + mix(tokens, 24).min()], np.uint64))[0]
    return *_sums_of(tokens), int(key.view(np.int64))


def _met_bits(sketch: DataFrame) -> np.ndarray:
    """Bits, by ``rid``, of all rows that share their min-hash with others: ``MET_BITS`` at most, however many rows there are."""
    several = sketch.where("n > 0").groupBy("mh").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("mh")
    place = F.pmod("rid", F.lit(MET_BITS)) + 1
    blocks = sketch.where("n > 0").join(several, "mh").groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(MET_BITS // 8, np.uint8)
    for block, found in blocks.collect():  # MET_BITS / 32,768 rows at most
        bits[(block - 1) * len(found) : block * len(found)] = np.frombuffer(found, np.uint8)
    return bits


def _met(batch: pa.RecordBatch, bits: np.ndarray) -> np.ndarray:
    place = batch.column("rid").to_numpy() & (MET_BITS - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _sketcher(words: int, met: np.ndarray | None = None):
    """Rows of _SKETCH; with ``met`` of the rows in these bits only, with the text, and one document for each set of a batch."""
    with_text = met is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if with_text:
                batch = batch.filter(pa.array(_met(batch, met)))
            rows, seen = [], set()
            for i, t in enumerate(shingle_arrays(batch.column("text"), words)):
                s = _sketch_of(t)
                if with_text and (not len(t) or s[:2] in seen):
                    continue
                seen.add(s[:2])
                rows.append((i, len(t), *s))
            cols = np.array(rows, np.int64).reshape(-1, 5)
            at = pa.array(cols[:, 0])
            out = [batch.column("doc_id").take(at), batch.column("rid").take(at), *(pa.array(cols[:, k]) for k in range(1, 5))]
            schema = _SKETCH
            if with_text:
                out, schema = [*out, batch.column("text").take(at).cast(pa.string())], _SKETCH.append(pa.field("text", pa.string()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _packed(values: np.ndarray) -> bytes:
    """Integers as zstd over byte planes, which suits ascending or small ones."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(raw).tobytes(), asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob, n * 8, asbytes=True), np.uint8).reshape(8, n).T
    return np.ascontiguousarray(raw).view("<u8").reshape(-1)


def _ascending(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(blob, n), dtype=np.uint64)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


#: kind 0: the members of a part (n of them; rid, gid, s1, s2 and size); kind 1: tokens to be compared with other
#: parts', each with the owner's number from 1, or 0 where owners are told already; kind 2: tokens of several groups, with owners.
_PIECE = pa.schema([("range", pa.int32()), ("part", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("tokens", pa.binary()), ("owners", pa.binary())])
_PIECE_DDL = "range int, part long, kind int, n long, tokens binary, owners binary"


def _pieces(part: int, members: list[tuple], tokens: list[np.ndarray], bits: int, ranges: int) -> pa.RecordBatch:
    facts = np.array(members, np.int64).reshape(-1, 5)
    t = np.concatenate(tokens)
    owner = np.repeat(np.arange(len(members)), facts[:, 4])
    order = np.argsort(t, kind="stable")
    t, owner = t[order], owner[order]
    at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    group = facts[:, 1][owner]
    several = np.minimum.reduceat(group, at) != np.maximum.reduceat(group, at)
    known = np.repeat(several, np.diff(np.append(at, len(t))))
    rows = [(part % ranges, 0, len(members), facts.T.tobytes(), None)]
    if known.any():
        rows.append((part % ranges, 2, int(known.sum()), _packed(np.diff(t[known], prepend=np.uint64(0))), _packed(owner[known])))
    sent, whose = np.concatenate([t[~known], t[at][several]]), np.concatenate([owner[~known] + 1, np.zeros(int(several.sum()), np.int64)])
    order = np.argsort(sent, kind="stable")
    sent, whose = sent[order], whose[order]
    cuts = np.searchsorted(sent, np.array([((1 << bits) * k) // ranges for k in range(ranges + 1)], np.uint64))
    cuts[-1] = len(sent)
    for r, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if hi > lo:
            rows.append((r, 1, int(hi - lo), _packed(np.diff(sent[lo:hi], prepend=np.uint64(0))), _packed(whose[lo:hi])))
    return _frame(_PIECE, [[r[0] for r in rows], [part] * len(rows), *([r[k] for r in rows] for k in range(1, 5))])


def _grouper(words: int, percent: int, bits: int, ranges: int):
    """Groups of a task's sets (rows sorted by min-hash) as rows of _PIECE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, members, tokens, many = TaskContext.get().partitionId() << 24, [], [], 0
        key, leaders, seen = None, [], set()
        for batch in batches:
            ids = [batch.column(c).to_pylist() for c in ("rid", "s1", "s2", "mh")]
            for rid, s1, s2, mh, t in zip(*ids, shingle_arrays(batch.column("text"), words), strict=True):
                if mh != key:
                    key, leaders, seen = mh, [], set()
                if (s1, s2) in seen:
                    continue
                if len(seen) < 1 << 16:
                    seen.add((s1, s2))
                for leader in leaders:
                    if leader[2] < GROUP_MEMBERS and _linked(leader[1], t, percent):
                        leader[2] += 1
                        gid = leader[0]
                        break
                else:
                    gid = rid
                    leaders = [[rid, t, 1], *leaders[:7]]
                members.append((rid, gid, s1, s2, len(t)))
                tokens.append(t >> np.uint64(64 - bits))
                many += len(t)
                if many >= PART_TOKENS:
                    yield _pieces(part, members, tokens, bits, ranges)
                    part, members, tokens, many = part + 1, [], [], 0
        if members:
            yield _pieces(part, members, tokens, bits, ranges)

    return run


def _loner(words: int, bits: int, ranges: int, met: np.ndarray):
    """Sets of rows that aren't in the bits ``met``, each a group of its own, as rows of _PIECE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, members, tokens, many = TaskContext.get().partitionId() << 24 | 1 << 23, [], [], 0
        for batch in batches:
            batch = batch.filter(pa.array(~_met(batch, met)))
            for rid, t in zip(batch.column("rid").to_pylist(), shingle_arrays(batch.column("text"), words), strict=True):
                if not len(t):
                    continue
                members.append((rid, rid, *_sums_of(t), len(t)))
                tokens.append(t >> np.uint64(64 - bits))
                many += len(t)
                if many >= PART_TOKENS:
                    yield _pieces(part, members, tokens, bits, ranges)
                    part, members, tokens, many = part + 1, [], [], 0
        if members:
            yield _pieces(part, members, tokens, bits, ranges)

    return run


def _shared(rows: list[tuple]) -> Iterator[tuple]:
    """Of a range's pieces (part, n, tokens, owners) those of tokens that several parts or groups have, as pieces of kind 2."""
    t = np.concatenate([_ascending(r[2], r[1]) for r in rows])
    owner = np.concatenate([_unpacked(r[3], r[1]).astype(np.int32) for r in rows])
    part = np.repeat(np.arange(len(rows), dtype=np.int32), [r[1] for r in rows])
    order = np.argsort(t, kind="stable")
    t = t[order]
    same = np.concatenate([[False], t[1:] == t[:-1], [False]])
    again = same[1:] | same[:-1]  # most tokens are there once, and go before anything is made of them
    order, t = order[again], t[again]
    owner, part = owner[order], part[order]
    if not len(t):
        return
    at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    shared = (np.minimum.reduceat(part, at) != np.maximum.reduceat(part, at)) | (np.minimum.reduceat(owner, at) == 0)
    keep = np.repeat(shared, np.diff(np.append(at, len(t)))) & (owner > 0)
    t, owner, part = t[keep], owner[keep], part[keep]
    order = np.argsort(part, kind="stable")
    t, owner, part = t[order], owner[order], part[order]
    cuts = np.searchsorted(part, np.arange(len(rows) + 1))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if hi > lo:
            yield rows[k][0], int(hi - lo), _packed(np.diff(t[lo:hi], prepend=np.uint64(0))), _packed(owner[lo:hi] - 1)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _PIECE sorted by range; those of kind 0 and 2 pass, those of kind 1 become kind 2."""

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = list(_shared(rows))
        if found:
            yield _frame(_PIECE, [[0] * len(found), [r[0] for r in found], [2] * len(found), *([r[k] for r in found] for k in range(1, 4))])

    now, rows = None, []
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        passing = np.flatnonzero(kinds != 1)
        if len(passing):
            yield batch.take(pa.array(passing))
        part = batch.take(pa.array(np.flatnonzero(kinds == 1)))
        for r, *piece in zip(*(part.column(c).to_pylist() for c in ("range", "part", "n", "tokens", "owners")), strict=True):
            if r != now and rows:
                yield from out(rows)
                rows = []
            now = r
            rows.append(tuple(piece))
    if rows:
        yield from out(rows)


_MEMBER = pa.schema([*((c, pa.int64()) for c in ("rid", "gid", "s1", "s2", "n")), ("tokens", pa.list_(pa.int64()))])
_MEMBER_DDL = "rid long, gid long, s1 long, s2 long, n long, tokens array<long>"


def _members(percent: int):
    """Rows of _PIECE sorted by part and kind: each set, with its tokens that other groups have too if these are enough for a link."""

    def out(facts: np.ndarray, pieces: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        many = len(facts)
        t = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in pieces)])
        owner = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in pieces)])
        enough = 100 * np.bincount(owner, minlength=many) >= percent * facts[:, 4]
        keep = enough[owner]
        t, owner = t[keep], owner[keep]
        order = np.lexsort((t, owner))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=many))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(t[order].astype(np.int64)))
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(facts[:, k])) for k in range(5)), lists], schema=_MEMBER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, pieces = None, []
        for batch in batches:
            for kind, n, tokens, owners in zip(*(batch.column(c).to_pylist() for c in ("kind", "n", "tokens", "owners")), strict=True):
                if kind == 0:
                    if facts is not None:
                        yield out(facts, pieces)
                    facts, pieces = np.frombuffer(tokens, np.int64).reshape(5, n).T, []
                else:
                    pieces.append((_ascending(tokens, n), _unpacked(owners, n).astype(np.int64)))
        if facts is not None:
            yield out(facts, pieces)

    return run


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _opener(percent: int):
    """Rows sorted by group part, members (role 0) first: yields (a, b), the groups of a query and a member that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("target", "part", "role", "own", "n")]
            lists = batch.column("tokens")
            found = set()
            for i, (target, part, role, own, n) in enumerate(zip(*cols, strict=True)):
                t = lists[i].values.to_numpy()
                if (target, part) != key:
                    key, members = (target, part), []
                if role == 0:
                    members.append((own, n, t))
                    continue
                for other, size, m in members:
                    least = -(-percent * (n + size) // (100 + percent))
                    if (own, other) not in found and min(len(t), len(m)) >= least and len(np.intersect1d(t, m, assume_unique=True)) >= least:
                        found.add((own, other))
            yield _frame(_LINK, [[a for a, _ in found], [b for _, b in found]])

    return run


def _needed(a: str, b: str, percent: int) -> str:
    """The least overlap, times 100 + percent, of linked sets of these sizes."""
    return f"{percent} * ({a} + {b})"


def _sure(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of groups, found without pairing sets: each set with the one of the fewest other tokens that shares a token."""
    first = sets.select("rid", (F.col("n") - F.size("tokens")).alias("own"), F.explode("tokens").alias("token"))
    first = first.groupBy("token").agg(F.min(F.struct("own", "rid")).alias("m")).select("token", F.col("m.rid").alias("first"))
    met = sets.select("rid", F.explode("tokens").alias("token")).join(first, "token").where("rid <> first").groupBy("rid", "first").agg(F.count(F.lit(1)).alias("met"))
    facts = sets.select("rid", "gid", "n")
    met = met.join(facts, "rid").join(facts.select(*[F.col(c).alias(f"first_{c}") for c in facts.columns]), F.col("first") == F.col("first_rid"))
    met = met.where(f"gid <> first_gid and met * {100 + percent} >= {_needed('n', 'first_n', percent)}")
    return met.select(F.col("gid").alias("a"), F.col("first_gid").alias("b")).distinct()


def _between(sets: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """``sets`` with their component, without tokens that one component alone has and without sets that have too few others."""
    sets = sets.drop("component").join(joined.select(F.col("node").alias("gid"), "component"), "gid", "left").withColumn("component", F.expr(_COMPONENT))
    several = sets.select("component", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    left = sets.select("rid", F.explode("tokens").alias("token")).join(several.where("low <> high").select("token"), "token").groupBy("rid").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    facts = sets.select("rid", "gid", "component", "n")
    return written(left.join(facts, "rid").where(f"100 * size(tokens) >= {percent} * n").select("rid", "gid", "component", "n", "tokens"))


def _asked(sets: DataFrame, percent: int) -> DataFrame:
    """(target, rid, own): the groups that each set has to be compared with, told by the matrix of columns and groups."""
    e = sets.select("rid", "gid", "component", "n", F.size("tokens").alias("c"), F.explode("tokens").alias("token"))
    have = [F.count(F.lit(1)).alias("freq"), F.expr("bit_xor(xxhash64(rid))").alias("x1"), F.expr("bit_xor(xxhash64(rid, 1))").alias("x2")]
    columns = e.groupBy("token").agg(*have).groupBy("freq", "x1", "x2").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("weight")).select("token", "freq", "weight")
    cells = e.join(columns, "token")
    order = Window.partitionBy("rid").orderBy("freq", "token").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("rest", F.col("c") - F.sum("weight").over(order) + F.col("weight"))
    ranked = written(ranked.where(f"rest >= (n * {percent} + 99) div 100").select("token", "rid", "gid", "component", "n", "rest"))
    index = ranked.groupBy("token", F.col("gid").alias("target"), F.col("component").alias("other")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("most_rest"))
    fits = f"least <= n and most * 100 >= n * {percent} and least(rest, most_rest) * {100 + percent} >= {_needed('n', f'greatest(least, (n * {percent} + 99) div 100)', percent)}"
    met = ranked.join(index, "token").where(f"component <> other and {fits}").groupBy("target", "rid", "gid").agg(F.max("n").alias("n"), F.min("least").alias("least"))
    met = written(met)
    unions = sets.groupBy(F.col("gid").alias("target")).agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"))  # of GROUP_MEMBERS sets at most
    bound = met.join(sets.select("rid", "tokens"), "rid").join(unions, "target").withColumn("bound", F.size(F.array_intersect("tokens", "union")))
    asked = bound.where(f"bound * {100 + percent} >= {_needed('n', f'greatest(least, (n * {percent} + 99) div 100)', percent)}")
    asked = written(asked.select("target", "rid", F.col("gid").alias("own")))
    discarded(ranked, met)
    return asked


def _opened(asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between groups: each query against the members of its targets, in parts of ``QUERIES_A_TASK`` queries."""
    parts = asked.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / QUERIES_A_TASK).alias("parts"))
    facts = sets.select("rid", "n", "tokens")
    queries = asked.join(parts, "target").select("target", F.pmod(F.xxhash64("rid"), "parts").alias("part"), F.lit(1).alias("role"), "own", "rid").join(facts, "rid").drop("rid")
    members = sets.select(F.col("gid").alias("target"), F.col("gid").alias("own"), "n", "tokens").join(parts, "target")
    members = members.select("target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "own", "n", "tokens")
    rows = queries.unionByName(members)
    return rows.repartition("target", "part").sortWithinPartitions("target", "part", "role").mapInArrow(returning(_opener(percent)), "a long, b long")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The key of a row by id and text; rows that are equal in both share it."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def shingle_components(docs: DataFrame, percent: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``; the component is its smallest id."""
    return shingle_classes(docs, percent, words, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def shingle_classes(docs: DataFrame, percent: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``shingle_components``, with ``rid``, the row's key, and ``component``, which isn't null but for rows without words.

    All work on texts is done when this returns, in Arrow batches of few rows, as workers hold a batch several times.
    """
    with small_batches(docs.sparkSession):
        return _components(docs, percent, words, id_col, text_col)


def _grouped(docs: DataFrame, met: np.ndarray, total: int, percent: int, words: int) -> DataFrame:
    """Each set with its group, and with the tokens that other groups have too if these are enough for a link.

    Only texts of rows in the bits ``met`` are shuffled.
    """
    bits = min(64, total.bit_length() + SPARE_BITS)
    ranges = 8 + total // RANGE_TOKENS
    texts = docs.mapInArrow(returning(_sketcher(words, met)), _SKETCH_DDL + ", text string").select("rid", "s1", "s2", "mh", "text")
    pieces = texts.hint("rebalance", "mh").sortWithinPartitions("mh", "s1", "s2", "rid").mapInArrow(returning(_grouper(words, percent, bits, ranges)), _PIECE_DDL)
    pieces = pieces.union(docs.mapInArrow(returning(_loner(words, bits, ranges, met)), _PIECE_DDL))
    shared = pieces.repartition("range").sortWithinPartitions("range", "part").mapInArrow(returning(_meet), _PIECE_DDL)
    return written(shared.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(returning(_members(percent)), _MEMBER_DDL))


def _components(docs: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("rid", row_key())
    sketch = written(docs.mapInArrow(returning(_sketcher(words)), _SKETCH_DDL))
    total = sketch.agg(F.sum("n")).first()[0] or 0
    members = _grouped(docs, _met_bits(sketch), total, percent, words)
    groups = members.groupBy("s1", "s2").agg(F.min("gid").alias("gid"), F.max("gid").alias("top"))
    links = members.select("s1", "s2", "gid").join(groups.where("gid <> top").select("s1", "s2", F.col("gid").alias("b")), ["s1", "s2"]).select(F.col("gid").alias("a"), "b")
    one = members.where("size(tokens) > 0").groupBy("s1", "s2").agg(F.min(F.struct("rid", "gid", "n", "tokens")).alias("m")).select("m.*")
    sets = written(one)
    links = written(links.union(_sure(sets, percent)))
    joined = written(connected_components(links))
    before, sets = sets, _between(sets, joined, percent)
    discarded(before)
    links = links.union(_opened(_asked(sets, percent), sets, percent))
    joined = written(connected_components(links))

    comp = joined.select(F.col("node").alias("gid"), "component")
    of_set = groups.join(comp, "gid", "left").select("s1", "s2", F.expr(_COMPONENT).alias("component"))
    of_set = written(of_set.join(sketch.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least")), ["s1", "s2"]))
    discarded(members, sets, joined)
    smallest = of_set.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = of_set.join(smallest, "component").select("s1", "s2", "component", "component_id")
    out = sketch.join(of_set, ["s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "rid", F.when(F.col("n") > 0, F.col("component")).alias("component"))
