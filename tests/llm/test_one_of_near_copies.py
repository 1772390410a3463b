from lumenfold.llm import stages

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(name, last="end"):
    return " ".join([*(f"{name}{i}" for i in range(40)), last])


def kept(spark, pairs):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], SCHEMA)
    return sorted(((r.doc_id, r.text) for r in stages.keep_one_of_near_copies(spark, df, SF).collect()), key=str)


def test_one_row_of_each_class_stays(spark):
    pairs = [(1, text("a")), (None, text("a", "x")), (None, text("b"))]  # a near copy without an id; a unique text without one
    pairs += [(2, text("c")), (3, text("c", "y")), (3, text("d"))]  # a near copy whose id repeats with another text
    pairs += [(None, text("e")), (None, text("e")), (None, text("e", "z"))]  # a class of null ids only
    pairs += [(4, text("f")), (4, text("f")), (5, text("f"))]  # rows that repeat the least id
    pairs += [(6, None), (6, ""), (None, "  ")]  # no words: in no class
    got = kept(spark, pairs)
    of_e = [p for p in got if p in [(None, text("e")), (None, text("e", "z"))]]
    assert len(of_e) == 1
    want = [(1, text("a")), (None, text("b")), (2, text("c")), (3, text("d")), (4, text("f")), (6, None), (6, ""), (None, "  ")]
    assert sorted([p for p in got if p not in of_e], key=str) == sorted(want, key=str)


def test_no_documents(spark):
    assert kept(spark, []) == []
