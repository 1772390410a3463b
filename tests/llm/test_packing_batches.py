from lumenfold.llm import packing
from lumenfold.llm.tokenizers_path import default_path

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_texts_are_cut_in_small_batches(spark, monkeypatch):
    """Texts come to workers in batches of 1,000 rows at most; afterwards the session is as it was."""
    seen, before, write = [], spark.conf.get(BATCH), packing.written
    monkeypatch.setattr(packing, "written", lambda df: (seen.append(int(spark.conf.get(BATCH))), write(df))[1])
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)] + [(30, None)], "doc_id long, text string")
    assert packing.packed(docs, default_path("byte_bpe_50k.json")).count() == 21
    assert seen and max(seen) <= 1000 and spark.conf.get(BATCH) == before
