import math
import random

import numpy as np

from lumenfold.llm import embedding_dedup as e

from .brute import components

DDL = "vec_id long, embedding array<float>, rid int, size string"


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def linked(a, b):
    if not (good(a) and good(b) and len(a) == len(b)):
        return False
    x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    return x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.9


def check(spark, rows):
    got = {r.vec_id: r for r in e.near_vectors(spark.createDataFrame([(i, v, 0, "") for i, v in rows], DDL)).collect()}
    want = components(rows, linked)
    assert len(got) == len(rows)
    for (i, v), c in zip(rows, want, strict=True):
        n = sum(linked(v, w) for j, w in rows if j != i)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n, c, i == c), i


def test_against_all_pairs(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 64))
    rows = []
    for i in range(500):
        c = centres[int(r.integers(40))] if r.random() < 0.6 else r.normal(size=64)
        rows.append((i * 3, [float(x) for x in c + r.normal(size=64) * r.choice([0.05, 0.2, 0.3, 0.4])]))
    rows += [(5000 + i, [float(x) for x in centres[0]]) for i in range(30)] + [(6000 + i, [float(x) for x in centres[0] * 2 + r.normal(size=64) * 0.1]) for i in range(60)]
    check(spark, rows)


def test_special_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.1]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [0.0, 0.0]), (13, [1e30, 1e20]), (14, [1e-30, 0.0])]
    check(spark, rows)


def test_empty_and_null_ids(spark):
    assert e.near_vectors(spark.createDataFrame([], DDL)).collect() == []
    got = e.near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 0, ""), (4, [1.0, 0.0], 0, ""), (4, [1.0, 0.01], 0, "")], DDL)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 2, 4), (4, 2, 4), (4, 2, 4)]


def test_units_split(spark, monkeypatch):
    monkeypatch.setattr(e, "UNIT", 16)
    r = random.Random(2)
    check(spark, [(i, [r.gauss(0, 1) + (3 if i % 2 else 0) for _ in range(8)]) for i in range(200)])
