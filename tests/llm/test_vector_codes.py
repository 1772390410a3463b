"""Operator 12 against plain Python, and its SQL on the smallest table."""

import hashlib
import math
import random

import numpy as np
import pytest

from lumenfold.llm import vector_codes as v

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def plain(rows):
    """The contract, number by number."""
    good = [r for r in rows if r[1] is not None and len(r[1]) and all(x is not None and math.isfinite(x) for x in r[1])]
    good = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    if not good:
        return []
    n = len(good[0][1])
    whole = [[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in good]
    at = [k * n // 16 for k in range(17)]
    books = [[x[at[k] : at[k + 1]] for x in whole[:64]] for k in range(16)]

    def assigned():
        out = []
        for x in whole:
            far = [[sum((p - q) ** 2 for p, q in zip(x[at[k] : at[k + 1]], e, strict=True)) for e in books[k]] for k in range(16)]
            out.append([(min(f), f.index(min(f))) for f in far])
        return out

    for _ in range(2):
        near = assigned()
        for k in range(16):
            for e in range(len(books[k])):
                own = [x[at[k] : at[k + 1]] for x, a in zip(whole, near, strict=True) if a[k][1] == e]
                if own:
                    books[k][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    near = assigned()
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(f for f, _ in a) for a in near]
    return [(r[0], "".join(f"{e:02x}" for _, e in a), error, sum(e for e, o in zip(errors, good, strict=True) if o[2] == r[2]), sha) for r, a, error in zip(good, near, errors, strict=True)]


def vectors(n, length, seed):
    r = random.Random(seed)
    out = [(None if r.random() < 0.03 else r.randrange(3 * n), [round(r.gauss(0, 1), 2) for _ in range(length)], r.choice([None, 1, 2, 3]), "x") for _ in range(n)]
    bad = [(1, None, 1, "x"), (2, [], 1, "x"), (3, [1.0] * (length - 1) + [None], 2, "x"), (0, [float("nan")] * length, 2, "x"), (5, [float("inf")] * length, 2, "x"), (9 * n, [0.5] * (length + 1), 2, "x")]
    return out + bad + [out[0]] * 20 + [(10 * n, [0.0] * length, 7, "x"), (10 * n + 1, [-20000.0] * length, 7, "x")]


@pytest.mark.parametrize("n,length,heavy", [(150, 64, 1024), (90, 37, 2), (20, 16, 3), (40, 5, 1)])
def test_equals_plain_python(spark, monkeypatch, n, length, heavy):
    monkeypatch.setattr(v, "HEAVY", heavy)
    rows = vectors(n, length, n)
    got = v.compressed(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "x"), (2, [None], 1, "x")]])
def test_nothing_to_code(spark, rows):
    assert v.compressed(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_codes_stand_for_near_vectors(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 32)).round(3)
    rows, books = v.trained(spark.createDataFrame([(i, row.tolist(), 0) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int"))
    for row in v.coded(rows, books).collect():
        whole = np.floor(256 * x[row.vec_id].astype(np.float32).astype(float))
        assert ((whole - 256 * v.decoded(row.codes, books)) ** 2).sum() == row.error
