import public_tokenizers as P
import sentencepiece

from lumenfold.llm import queries, token_counts

from .test_counts_and_lines import TEXTS, random_texts

PATH = str(P.path("piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"


def by_hand(text, ranks):
    """The number of pieces after all merges, best score first, leftmost of equal ones; unknown characters are bytes."""
    parts = list("▁" + text.replace(" ", "▁")) if text else []
    while True:
        found = [(ranks[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return sum(1 if p in ranks else len(p.encode()) for p in parts)
        i = -max(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_counts_equal_sentencepiece_and_the_merges(spark):
    exact, ranks = sentencepiece.SentencePieceProcessor(model_file=PATH), dict(token_counts.vocabulary(PATH))
    rows = [(i, t) for i, t in enumerate([*TEXTS, *random_texts(150)])] + [(3, "a"), (None, "q  q")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_tokens int")
    got = sorted(map(str, token_counts.merged(df, PATH).collect()))
    want = [(i, len(t or ""), len(exact.encode(t or ""))) for i, t in rows]
    assert got == sorted(f"Row(doc_id={i}, n_chars={c}, n_tokens={n})" for i, c, n in want)
    for (_, t), (_, _, n) in zip(rows, want, strict=True):
        if len(t or "") < 400:
            assert by_hand(t or "", ranks) == n, t


def test_query_counts_by_the_file(spark):
    exact = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op6_token_counts(spark, SF).collect():
        assert r.n_tokens == len(exact.encode(docs[r.doc_id] or "")), r.doc_id
