"""Cases that the operators' docstrings state: very long texts, empty tables, repeated rows, null ids, clashing columns."""

import hashlib

from lumenfold.llm import fingerprints, line_dedup, mixing, secret_scan, token_counts
from lumenfold.llm.tokenizers_path import default_path

from .brute import WORD, shingles

DDL = "doc_id long, text string, source string, spans string, removed string, n_tokens string, key string, rid string"
LONG = " ".join(f"w{i % 70_000}" for i in range(150_000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", "x", "x", "x", "x") for i, t in rows], DDL)


def test_fingerprints_of_long_texts(spark):
    half = " ".join(LONG.split(" ")[:75_000])
    rows = {r.doc_id: r for r in fingerprints.digest(table(spark, [(2, LONG), (1, half), (None, None)])).collect()}
    assert rows[2].n_chars == len(LONG) and abs(rows[2].n_shingles / len(shingles(LONG)) - 1) < 0.4
    a, b = shingles(LONG), shingles(half)
    assert abs(rows[2].near_next - len(a & b) / len(a | b)) < 0.2 and rows[None].n_chars == 0
    s = table(spark, [(2, LONG), (1, half)]).select("doc_id", fingerprints.sketch(fingerprints.F.col("text")).alias("s"))
    both = s.where("doc_id = 1").selectExpr("s as a").crossJoin(s.where("doc_id = 2").selectExpr("s as b"))
    got = both.select(fingerprints.containment(fingerprints.F.col("a"), fingerprints.F.col("b")).alias("x"), fingerprints.containment(fingerprints.F.col("b"), fingerprints.F.col("a")).alias("y")).first()
    assert abs(got.x - len(a & b) / len(b)) < 0.2 and abs(got.y - len(a & b) / len(a)) < 0.2


def test_mix_of_long_texts(spark):
    got = {r.doc_id: r for r in mixing.digest(table(spark, [(1, LONG), (2, "a b"), (None, None)])).collect()}
    assert got[1].size == 150_000 and sum(r.taken for r in got.values()) == 150_002 and len(WORD.findall(LONG)) == 150_000


def test_token_counts_of_odd_tables(spark):
    path = default_path("piece_bpe_32k.model")
    assert token_counts.merged(table(spark, []), path).collect() == []
    got = sorted(((r.doc_id or 0, r.n_chars, r.n_tokens) for r in token_counts.merged(table(spark, [(None, "some words"), (7, "some words"), (7, "some words"), (8, None), (9, "")]), path).collect()))
    n = got[0][2]
    assert got == [(0, 10, n), (7, 10, n), (7, 10, n), (8, 0, 0), (9, 0, 0)] and n > 0


def test_lines_of_repeated_rows_and_long_texts(spark):
    line = " ".join(f"u{i}" for i in range(30))
    rows = [(1, line), (1, line), (2, "own words first here\n" + line), (3, LONG), (4, LONG), (None, line)]
    out = line_dedup.deduplicated(table(spark, rows), whole=True)
    assert out.columns == DDL.replace(" string", "").replace(" long", "").split(", ")[:4] + ["n_tokens", "key", "rid", "removed"]
    got = sorted(((r.doc_id or 99, r.text, len(r.removed)) for r in out.collect()))
    assert got == [(1, line, 0), (1, line, 0), (2, "own words first here\n", 1), (3, LONG, 0), (4, "", 1), (99, "", 1)]
    digest = {r.doc_id: r for r in line_dedup.digest(table(spark, rows), whole=True).collect()}
    assert digest[4].removed == f"0:{len(LONG)}" and digest[4].kept_sha256 == hashlib.sha256(b"").hexdigest()
    plain = line_dedup.deduplicated(table(spark, [(1, "a line of five words\nx"), (2, "y\na line of five words\n")]), run=0)
    assert sorted((r.doc_id, r.text) for r in plain.collect()) == [(1, "a line of five words\nx"), (2, "y\n")]


def test_every_later_unit_is_told(spark):
    rows = [(1, "a line of five words\nx"), (2, "y\na line of five words\nalone among all the texts")]
    told = line_dedup.repeats(table(spark, rows).drop("rid").withColumn("rid", line_dedup.F.col("doc_id"))).collect()
    assert [(r.rid, r.start, r.end, r.keeper) for r in told] == [(2, 2, 23, 1)]


def test_secrets_of_odd_tables(spark):
    assert secret_scan.digest(table(spark, [])).collect() == []
    rows = [(1, LONG + " password=hunter22"), (None, None)]
    got = {r.doc_id: r for r in secret_scan.digest(table(spark, rows)).collect()}
    assert got[1].spans.startswith(f"assign:{len(LONG) + 1}:") and got[None].spans == ""
    assert secret_scan.secret_spans(table(spark, rows)).columns.count("spans") == 1
    clean = secret_scan.redacted(table(spark, rows))
    assert clean.columns == table(spark, rows).columns and {r.doc_id: r.text for r in clean.collect()} == {1: LONG + " [assign]", None: None}
