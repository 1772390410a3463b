import hashlib
import random

import public_tokenizers as P
import pytest

from lumenfold.llm import line_dedup, packing, token_counts

PATH = P.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "The quick  brown fox.\nJumps\tover é ñ 日本語 😀😀 ", "x" * 300, "▁odd ▁ marks", " lead", "trail ", "Ciónmente ñaqueado " * 50, "\x00\x01 <0x41> <s> </s>", "word " * 30_000, "ｆｕｌｌ ﬁ ² ½ ٣"]


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.vocabulary(str(PATH))
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    return t


def random_texts(n=300):
    r = random.Random(8)
    parts = ["the", "ciónmente", "ß", "日", "😀", "  ", "\n", "ing", "Q", "7", "—", "é", "token", "ization", "▁"]
    return ["".join(r.choice(parts) + r.choice(["", " ", ""]) for _ in range(r.randrange(1, 40))) for _ in range(n)]


def test_counts_equal_the_tokenizer(spark, exact):
    rows = [(i, t) for i, t in enumerate([*TEXTS, *random_texts()])]
    got = {r.doc_id: r for r in token_counts.counted(spark.createDataFrame(rows, "doc_id long, text string"), str(PATH)).collect()}
    for i, t in rows:
        assert got[i].n_tokens == len(exact.encode(t or "", add_special_tokens=False).ids), (i, t)
        assert got[i].n_chars == len(t or "")


def test_ties_and_unknown_runs():
    from tokenizers import Tokenizer, models

    for vocab in ([("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0)], [("<unk>", 0.0), ("ab", -1.0), ("b", -3.0)]):
        mine, t = token_counts.Counter(vocab), Tokenizer(models.Unigram(vocab, unk_id=0))
        r = random.Random(1)
        for _ in range(300):
            s = "".join(r.choice("abz") for _ in range(r.randrange(1, 12)))
            assert mine.unit(s) == len(t.encode(s).ids), s


def lines_brute(rows, least, run):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        text, pieces, at = text or "", [], 0
        while at < len(text):
            end = at
            while end < len(text):
                end += 1
                if text[end - 1] == "\n":
                    break
                if text[end - 1] in ".!?" and end < len(text) and text[end] in " \t":
                    while end < len(text) and text[end] in " \t":
                        end += 1
                    break
            pieces.append((at, end))
            at = end
        runs, now = [], []
        for a, b in pieces:
            words = text[a:b].translate({c: c + 32 for c in range(65, 91)}).split()
            if len(words) < least:
                continue
            if tuple(words) in seen:
                now.append((a, b, len(words)))
            else:
                seen.add(tuple(words))
                runs, now = [*runs, now], []
        gone = [(a, b) for r in [*runs, now] if sum(n for *_, n in r) >= run for a, b, _ in r]
        out[doc] = (gone, "".join(text[a:b] for a, b in pieces if (a, b) not in gone))
    return out


def test_lines(spark):
    r = random.Random(5)
    lines = [" ".join(r.choice("abcdefgh") * r.randrange(1, 3) for _ in range(r.randrange(0, 12))) for _ in range(40)]
    rows = [(i, "".join(r.choice([str.upper, str])(r.choice(lines)) + r.choice(["\n", ". ", "!\t", ".", " \n", "?"]) for _ in range(r.randrange(0, 14)))) for i in range(80)]
    rows += [(100, None), (101, ""), (None, lines[3] + "\n" + lines[4]), (102, "é 😀 b c d\n" * 6 + "z")]
    df = spark.createDataFrame([(*x, "t") for x in rows], "doc_id long, text string, removed string")
    want = lines_brute(rows, 5, 25)
    got = {x.doc_id: x for x in line_dedup.digest(df).collect()}
    assert len(got) == len(want) and any(g for g, _ in want.values())
    for doc, (gone, kept) in want.items():
        assert got[doc].removed == ",".join(f"{a}:{b}" for a, b in gone), doc
        assert got[doc].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert line_dedup.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packing_round_trip(spark):
    import numpy as np
    import zlib
    from tokenizers import Tokenizer

    path = str(P.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = [(i, x) for i, x in enumerate([*TEXTS, *random_texts(120), "it's we'll I'M _a_b__c ... a b  x", "a <|endoftext|> b", "  \n\n  x  "])] + [(3, "a"), (3, "a"), (None, "q")]
    got = packing.packed(spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, start int"), path).collect()
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for _, x in rows]
    want = sorted(str((d, k, min(1024, len(a) - k), zlib.crc32(a[k : k + 1024].tobytes()), len(a))) for (d, _), a in zip(rows, ids, strict=True) for k in range(0, len(a), 1024))
    assert sorted(str((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(len, ids))
    assert len(by) <= -(-total // 1024) * 1.03 + 2
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), path).collect() == []


def test_cutting_stock_covers_demand():
    import numpy as np

    r = np.random.default_rng(1)
    for capacity, demand in ((16, r.integers(0, 50, 16)), (64, r.integers(0, 3, 64)), (8, np.zeros(8, int))):
        plan = packing.cutting_stock(demand, capacity)
        made = sum((p * n for p, n in plan), np.zeros(capacity, int))
        assert (made == demand).all() and all((p * np.arange(1, capacity + 1)).sum() <= capacity for p, _ in plan)
        used = sum(n for _, n in plan)
        assert used <= -(-(demand * np.arange(1, capacity + 1)).sum() // capacity) * 1.1 + 3
