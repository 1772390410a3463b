import random
from collections import Counter

from lumenfold.llm.ngram_jaccard import shingle_components

from .brute import components, shingles

DDL = "doc_id long, text string, gid int, target string"


def linked(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 75 * (len(a) + len(b) - both)


def expected(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    return Counter((k, len(s), c) for (k, s), c in zip(sets, components(sets, linked), strict=True))


def check(spark, rows):
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], DDL)
    got = shingle_components(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == expected(rows)


def test_special_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \n"), (8, "a b"), (9, "A  B"), (10, "a b c"), (3, long), (2, long + " tail"), (None, long), (2, long + " tail"), (None, None), (11, "é É"), (12, "é é")]
    check(spark, rows)


def test_empty_table(spark):
    assert shingle_components(spark.createDataFrame([], DDL)).collect() == []


def test_against_all_pairs(spark):
    r = random.Random(4)
    base = [[f"t{r.randrange(4000)}" for _ in range(r.choice([6, 20, 60, 150]))] for _ in range(30)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(420):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = f"e{r.randrange(50)}"
        if r.random() < 0.3:
            w = passage + w[: r.choice([4, 8, 14, 40])]
        rows.append((i * 7, " ".join(w)))
    check(spark, rows)


def test_chain_of_copies(spark):
    """Each text links with its neighbours only, so components are long paths."""
    words = [f"c{i}" for i in range(400)]
    rows = [(100 + k, " ".join(words[6 * k : 6 * k + 100])) for k in range(50)]
    check(spark, rows)


def test_many_queries_settle_by_components(spark, monkeypatch):
    """Small groups, parts, ranges of tokens and lots of queries change nothing."""
    from lumenfold.llm import ngram_jaccard

    for name, value in (("GROUP_MEMBERS", 2), ("PART_TOKENS", 700), ("RANGE_TOKENS", 500), ("QUERIES_A_TASK", 3)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    r = random.Random(9)
    base = [[f"t{r.randrange(900)}" for _ in range(80)] for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice([1, 2, 3, 4, 5])):
            w[r.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_texts_without_copies_are_not_shuffled(spark):
    """A set whose min-hash no other row has is worked on where it is read."""
    r = random.Random(3)
    rows = [(i, " ".join(f"{r.getrandbits(1200):x}" for _ in range(120))) for i in range(200)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1])]
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(4)
    before = shuffled()
    got = {x[0]: x[2] for x in shingle_components(docs).collect()}
    assert shuffled() - before < sum(len(t) for _, t in rows) / 4
    assert got == {i: 0 if i > 999 else i for i, _ in rows}
