import collections

import duckdb
import pandas as pd

from lumenfold.llm import mixing

from .brute import WORD

DDL = "doc_id long, text string, source string, n_chars long, key string, shards string"


def rows_of(n=400):
    rows = []
    for i in range(n):
        source = ["hot", "b", "é", None, "tiny"][0 if i % 3 else (i // 3) % 5]
        if source == "tiny" and i > 60:
            source = "hot"
        rows.append((i, " ".join(f"w{j}" for j in range(i * 7 % 90)), source, 1, "k", "s"))
    return [*rows, (5, "x y z", "b", 1, "", ""), (5, "x y z", "b", 1, "", ""), (None, None, None, None, None, None), (7, "", "", 0, "", "")]


def check(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    got = mixing.mixed(df).toPandas()
    documents = pd.DataFrame(rows, columns=[c.split()[0] for c in DDL.split(", ")]).astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(mixing.SQL).df()
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    text = lambda d: sorted(map(str, d[cols].astype({"doc_id": "Int64"}).itertuples(index=False, name=None)))
    assert text(got) == text(want)
    return got


def test_against_sql_and_contract(spark):
    rows = rows_of()
    got = check(spark, rows)
    sizes = collections.Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    target, free, left = {}, set(names), sum(sizes.values())
    while True:
        weight = {s: i % 3 + 1 for i, s in enumerate(names)}
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    taken = collections.Counter()
    by_size = {}
    for r in got.itertuples():
        assert 0 <= r.taken <= 3 * r.size
        by_size.setdefault(r.source_size, r.target)
        taken[r.target] += r.taken
        assert len(r.shards) == -(-r.taken // r.size) if r.size else not len(r.shards)
    for s in names:
        assert abs(by_size[sizes[s]] - target[s]) < 1e-6 * max(1, target[s])
        assert abs(taken[by_size[sizes[s]]] - target[s]) <= 1


def test_mixture_rows(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, DDL)
    out = mixing.mixture(df).collect()
    assert out[0].asDict().keys() == df.limit(1).collect()[0].asDict().keys()
    words = collections.Counter()
    for r in out:
        words[r.doc_id] += len(WORD.findall(r.text))
    want = mixing.mixed(df).groupBy("doc_id").sum("taken").collect()
    assert {r[0]: r[1] for r in want if r[1]} == dict(words)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixture(df).collect()))


def test_empty(spark):
    df = spark.createDataFrame([], DDL)
    assert mixing.mixed(df).collect() == [] and mixing.mixture(df).collect() == []


def test_shards_split_evenly(spark):
    df = spark.createDataFrame(rows_of(), DDL)
    rows = mixing.sized(df)
    plan = mixing.block_plan(rows, mixing.source_targets(rows))
    units = [r.shard for r in mixing.shard_plan(plan, 3).collect()]
    n = collections.Counter(units)
    assert sum(n.values()) == plan.selectExpr("sum(passes + if(rest > 0, 1, 0))").first()[0]
    assert max(n.values()) - min(n.values()) <= 3
