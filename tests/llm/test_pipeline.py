import corpus_pipeline
from lumenfold.llm import secret_scan, stages

from .brute import WORD, components, shingles

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    kept = [tuple(r) for r in stages.drop_toxic(spark, docs, SF).collect()]
    assert set(kept) <= set(rows) and 0.7 * len(rows) < len(kept) < len(rows)
    one = [tuple(r) for r in stages.keep_one_of_near_copies(spark, docs, SF).collect()]
    sets = [(r[0], shingles(r[1])) for r in rows]
    near = components(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b))
    assert sorted(one) == sorted(r for r, c in zip(rows, near, strict=True) if r[0] == c)
    clean = {r.doc_id: r for r in stages.redact_secrets(spark, docs, SF).collect()}
    found = {r.doc_id: r.spans for r in secret_scan.digest(docs).collect()}
    for r in rows:
        assert (clean[r[0]].text == r[1]) == (not found[r[0]]) and clean[r[0]].n_chars == len(clean[r[0]].text)
    mixed = stages.mix_sources(spark, docs, SF).collect()
    assert mixed[0].asDict().keys() == docs.first().asDict().keys()
    total = sum(len(WORD.findall(r[1])) for r in rows)
    assert abs(sum(len(WORD.findall(r.text)) for r in mixed) - total) <= 20


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and len(corpus_pipeline.STAGES) == 5
    assert all(0 < r.length <= 1024 and r.offset + r.length <= 1024 for r in out)
