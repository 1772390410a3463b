import hashlib
import random

import numpy as np

from lumenfold.llm import fingerprints as f
from lumenfold.llm import quotations, toxicity

from .brute import shingles

DDL = "doc_id long, text string, sketch string, next int"


def test_fingerprints(spark):
    r = random.Random(3)
    texts = [None, "", "a b", "é 😀 x", "A b", " ".join(f"w{r.randrange(900)}" for _ in range(3000))] + [" ".join(f"v{r.randrange(60)}" for _ in range(r.randrange(1, 200))) for _ in range(40)]
    rows = [(i * 37 % 1009, t) for i, t in enumerate(texts)] + [(5000, texts[7]), (10**15, texts[7])]
    got = {x.doc_id: x for x in f.digest(spark.createDataFrame([(*x, "s", 0) for x in rows], DDL)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True, key=lambda x: x[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (shingles(x) for x in (t, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for have, want, union in ((got[i].near_edited, like(a, b), a | b), (got[i].near_next, like(a, c), a | c)):
            assert abs(have - want) < (1e-9 if len(union) <= f.K else 0.2)
        assert abs(got[i].n_shingles - len(a)) <= 0.4 * len(a)
    assert got[5000].fingerprint == got[10**15].fingerprint == got[7 * 37 % 1009].fingerprint


def test_fingerprint_tables(spark):
    assert f.digest(spark.createDataFrame([], DDL)).collect() == []
    one = f.digest(spark.createDataFrame([(None, "a b c", "", 0)], DDL)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    same = f.digest(spark.createDataFrame([(3, "a b c", "", 0)] * 4 + [(None, "x", "", 0)] * 3, DDL)).collect()
    assert len(same) == 7


def test_common_ids_are_split(spark, monkeypatch):
    monkeypatch.setattr(f, "RANGE_ROWS", 8)
    ids = [None] * 3000 + [77] * 1500 + [2**63 - 1] * 600 + [i * 5 for i in range(3000)] + [-4, -4]
    rows = [(i, f"text {k}" if k % 9 else "again", "s", 0) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, DDL)
    sizes = [r["count"] for r in f._by_range(docs.select("doc_id", "text")).groupBy("range").count().collect()]
    assert len(sizes) > 500 and max(sizes) < 450  # the texts "again" of null stay together
    hashed = [tuple(r) for r in docs.select("doc_id", "text", f.F.xxhash64("text")).collect()]
    order = sorted(hashed, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    want = sorted((str(a[0]), a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert sorted((str(r.doc_id), r.text, r.next.text) for r in f.with_next(docs).collect()) == want
    only = docs.where("doc_id is null")
    assert sorted(r.next.text for r in f.with_next(only).collect()) == sorted(r[1] for r in hashed if r[0] is None)


def test_sketches_merge(spark):
    r = random.Random(1)
    a, b = (" ".join(f"w{r.randrange(300)}" for _ in range(900)) for _ in range(2))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(f.sketch(f.F.col("a")).alias("a"), f.sketch(f.F.col("b")).alias("b"))
    m = row.select(f.merged(f.F.col("a"), f.F.col("b")).alias("m"), f.containment(f.F.col("a"), f.F.col("a")).alias("c"), "a", "b").first()
    assert m.m == sorted(set(m.a) | set(m.b))[: f.K] and m.c == 1.0


def test_quotations(spark):
    ddl = "conv_id long, turn long, role string, text string, before int"
    rows = [
        (1, 0, "user", "Hello  there\nsecond line", 0), (1, 1, "assistant", "> hello THERE\nreply", 0), (1, 2, "user", ">> hello there\n> reply\nlast", 0), (1, 3, "user", "> nobody said\nx", 0), (1, 4, "user", "> second line\n > reply\n> last", 0),
        (2, 0, "user", None, 0), (2, 7, "user", "> hello there", 0), (None, 1, "user", "a", 0), (3, None, "user", "> a", 0), (2, 300, "user", "", 0), (1, 1, "assistant", "> hello THERE\nreply", 0),
    ]
    got = sorted(map(str, (tuple(r)[:8] for r in quotations.linked(spark.createDataFrame(rows, ddl)).collect())))
    want = sorted(map(str, [
        (1, 0, "user", "Hello  there\nsecond line", 0, 0, 0, None), (1, 1, "assistant", "reply", 1, 1, 1, 0), (1, 1, "assistant", "reply", 1, 1, 1, 0), (1, 2, "user", "last", 2, 2, 2, 1), (1, 3, "user", "x", 1, 1, 0, 2),
        (1, 4, "user", "", 1, 3, 3, 2), (2, 0, "user", "", 0, 0, 0, None), (2, 7, "user", "", 1, 1, 0, 0), (None, 1, "user", "a", 0, 0, 0, None), (3, None, "user", "", 1, 1, 0, None), (2, 300, "user", "", 0, 0, 0, 7),
    ]))
    assert [g.replace(", 1)", ", 1)") for g in got] == want


def test_toxicity_learns_and_ignores_the_fold(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    rows, labels = [], []
    for i in range(900):
        w = [word() for _ in range(r.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(["grumblethorp", "zorkwise", "quaxxle"]) + r.choice(["", "s", "ish", "ed"])
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(bad)))
    rows += [(2000, None, None, None), (2001, "", None, None), (2002, "x " * 40_000, None, None), (None, "grumblethorps", None, None), (0, rows[0][1], None, None)]
    labels += [(2000, 1, None), (None, 1, 1)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, known).collect()
    assert len(got) == len(rows) and got == toxicity.scored(docs, known).collect()
    held = [(x.predicted, int(x.doc_id % 4 == 0)) for x in got if x.held_out and x.doc_id < 900]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.9
    assert next(x.predicted for x in got if x.doc_id is None) == 1
    assert all(0 <= x.score <= 1 for x in got)
    none = toxicity.scored(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {x.predicted for x in none} == {0} and toxicity.scored(docs.limit(0), known).collect() == []
