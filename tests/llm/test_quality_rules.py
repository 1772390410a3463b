"""Operator 13: statistics and scores against plain Python, the lasso's optimum, held-out accuracy, cases."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from lumenfold.llm import quality_rules as q

DIR = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = ["The cat sat. On the mat!", "", None, "  \n ", "A a a B### 12 34?\nx", "déjà Vu — naïve", "one " * 300 + "two\n" * 40, "((---))"]


def statistics(text):
    """STATISTICS of one text, byte by byte."""
    raw = (text or "").encode()
    kind = lambda b: "blank" if b in b"\t\n\x0b\x0c\r " else "lower" if 97 <= b <= 122 else "upper" if 65 <= b <= 90 else "digit" if 48 <= b <= 57 else "stop" if b in b".,;:" else "exclaim" if b in b"!?" else "quote" if b in b"'\"-()" else "wide" if b >= 192 else "rest" if b >= 128 else "symbol"
    n = {k: sum(kind(b) == k for b in raw) for k in ("blank", "lower", "upper", "digit", "stop", "exclaim", "quote", "symbol", "wide")}
    solid = sum(n.values()) - n["blank"]
    words = [w for w in WORD.findall(raw)]
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    share = lambda a, b: a / b if b else 0.0
    many = len(words)
    near = {(i // q.STRETCH, w) for i, w in enumerate(low)}
    return [
        share(n["lower"] + n["upper"] + n["wide"], solid), share(n["upper"], n["lower"] + n["upper"]), share(n["digit"], solid), share(n["symbol"], solid), share(n["exclaim"], solid), share(n["stop"], solid), share(n["wide"], solid),
        len(text or ""), many, share(sum(map(len, words)), many), many / (raw.count(b"\n") + 1), share(sum(not any(kind(b) in ("lower", "upper", "wide") for b in w) for w in words), many),
        share(sum(kind(w[-1]) == "symbol" for w in words), many), share(sum(a == b for a, b in zip(low, low[1:], strict=False)), many), share(len(set(low)), many), share(len(near), many),
        share(max((low.count(w) for w in set(low)), default=0), many), many / (sum(raw.count(b) for b in (b".", b"!", b"?")) + 1),
    ]


def test_statistics():
    got = np.concatenate(list(q.text_statistics(pa.array(TEXTS))))
    assert got.shape == (len(TEXTS), len(q.STATISTICS))
    for row, text in zip(got, TEXTS, strict=True):
        assert row.tolist() == pytest.approx(statistics(text))


def test_paths_of_trees_are_the_rules():
    r = np.random.default_rng(1)
    x = r.random((400, len(q.STATISTICS)))
    y = ((x[:, 3] > 0.4) & (x[:, 7] <= 0.7)).astype(int)
    model = q.fit(x, y, (1, 1))
    assert {k for _, rule in model.rules for k, _, _ in rule} & {3, 7} == {3, 7}
    assert all(1 <= len(rule) <= q.DEPTH for _, rule in model.rules)
    z = model.bias + sum(w * q.holds(rule, x) for w, rule in model.rules)
    assert ((z > 0) == y).mean() > 0.97


def test_lasso_optimum():
    """The penalised loss at the result isn't above what steps along any column give, and a large penalty leaves nothing."""
    r = np.random.default_rng(2)
    h = (r.random((300, 12)) < 0.4).astype(float)
    y, weight = (r.random(300) < 1 / (1 + np.exp(-(2 * h[:, 0] - 2 * h[:, 1])))).astype(int), np.ones(300)
    bias, b = q.lasso(h, y, weight)
    spread = h.std(0)
    most = np.abs(((h - h.mean(0)) / spread).T @ ((y - y.mean()) / 300)).max()

    def loss(bias, b):
        z = bias + h @ b
        return np.log1p(np.exp(-z * (2 * y - 1))).mean() + q.PENALTY * most * np.abs(b * spread).sum()

    best = loss(bias, b)
    for k in range(12):
        for d in (-1e-3, 1e-3):
            moved = b.copy()
            moved[k] += d
            assert loss(bias - d * h[:, k].mean(), moved) >= best - 1e-9


def test_score_is_the_sum_of_rules(spark):
    model = q.Model(-0.5, ((1.25, ((3, True, 0.05),)), (-2.0, ((8, False, 3.0), (0, True, 0.5))), (0.75, ((14, False, 0.9),))))
    rows = list(enumerate(TEXTS))
    got = q.with_statistics(spark.createDataFrame(rows, "doc_id long, text string"), ("doc_id",)).select("doc_id", q.score_of(model).alias("score")).collect()
    for row in got:
        x = statistics(TEXTS[row.doc_id])
        z = model.bias + sum(w for w, rule in model.rules if all((x[k] > c) == above for k, above, c in rule))
        assert row.score == pytest.approx(1 / (1 + math.exp(-z)))
    assert len(q.described(model)) == 3


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in q.scored(docs, labels).collect()}
    assert len(got) == docs.count()
    told = [(got[r.doc_id].predicted, r.quality) for r in labels.where("quality is not null").collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert len(told) > 80 and np.mean([a == b for a, b in told]) > 0.95
    from zlib import crc32

    assert all(r.held_out == (crc32(str(k).encode()) % 3 == 1) for k, r in got.items())


def test_held_out_labels_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality")
    a, b = (sorted(map(tuple, q.scored(docs, x).select("doc_id", "score").collect())) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("labels,score", [([], 0.0), ([(1, 1), (4, None)], 1.0), ([(1, 0)], 0.0)])
def test_cases(spark, labels, score):
    rows = [(1, "some text", "a"), (1, "some text", "b"), (None, None, "c"), (7, "", "d"), (8, "long " * 200_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = q.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == 5 and all(abs(r.score - score) < 1e-9 and r.predicted == score for r in got)
    assert q.scored(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).collect() == []
    kept = q.filtered(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert kept.columns == docs.columns and kept.count() == 5
