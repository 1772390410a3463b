"""Everyone's cells of every row, against a plain loop."""

import random

from lumenfold.operators import matching

DDL = "person string, key string, turn int, score int, rating int, reasons array<string>, title string, day string"


def loop(pools, members):
    ids = list(dict.fromkeys(m for m, _ in sorted(members, key=lambda m: m[1])))
    own = {m: {} for m in ids}
    for r in sorted(pools, key=lambda r: r[2]):
        if r[0] in own:
            own[r[0]][r[1]] = r
    out = {}
    for k in {k for rows in own.values() for k in rows}:
        cells = [(m, own[m].get(k)) for m in ids]
        scores = [r[3] or 0 for _, r in cells if r]
        shown = next(r for _, r in cells if r)
        people = [(m, r and (r[3] or 0, r[4] or 0, (r[5] or [])[:3], (r[3] or 0) < 0)) for m, r in cells]
        out[k] = (shown[6], shown[7], people, round(sum(scores) / len(scores), 2), min(scores), max(scores), sum(s > 0 for s in scores), sum(s < 0 for s in scores))
    return out


def test_equals_a_loop(spark):
    rnd = random.Random(1)
    members = [("lou", 2), ("ann", 1), ("bo", 3), ("none", 4), ("ann", 9)]
    pools = [
        (rnd.choice(["ann", "bo", "lou", "stranger"]), f"k{rnd.randint(0, 25)}", i, rnd.choice([None, -4, 0, 3, 8]), rnd.choice([None, 1, 5]), rnd.choice([None, [], ["a"], ["d", "c", "b", "a"]]), rnd.choice([None, f"t{i}"]), "2026-06-01")
        for i in range(90)
    ]
    got = matching.dense_matrix(spark.createDataFrame(pools, DDL), spark.createDataFrame(members, "person string, turn int"))
    plain = lambda c: c and (c.score, c.rating, c.reasons, c.veto)
    have = {r.key: (r.title, r.day, [(p.person, plain(p.cell)) for p in r.people], r.mean, r.least, r.most, r.n_into, r.n_veto) for r in got.collect()}
    assert have == loop(pools, members) and any(c is None for r in have.values() for _, c in r[2])


def test_order_and_empty(spark):
    members = spark.createDataFrame([("ann", 1)], "person string, turn int")
    pools = [("ann", "a", 1, 2, 1, None, "x", None), ("ann", "b", 2, 2, 1, None, "y", "2026-06-02"), ("ann", "c", 3, 5, 1, None, "z", "2026-06-03"), (None, "d", 4, 9, 1, None, "n", None)]
    df = spark.createDataFrame(pools, DDL)
    assert [r.key for r in matching.matrix_order(matching.dense_matrix(df, members)).collect()] == ["c", "b", "a"]
    assert matching.dense_matrix(df, members.limit(0)).count() == 0 and matching.dense_matrix(df.limit(0), members).count() == 0
