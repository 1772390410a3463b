import hashlib
import random

from lumenfold.llm import line_dedup

SCHEMA = "doc_id long, text string"


def spans(spark, rows, whole=True):
    return {r.doc_id: r for r in line_dedup.digest(spark.createDataFrame(rows, SCHEMA), whole).collect()}


def test_passages_of_short_sentences_go(spark):
    short = " ".join(f"ERW{i}HED.!! EDH{i}!" for i in range(20))
    wrapped = " ".join(f"w{i}" for i in range(60))
    broken = wrapped.replace("w20 ", "w20\n").replace("w43 ", "w43\n")
    rows = [(1, short), (2, "An opening line of its own words\n" + short + "\nand a last one that nobody has"), (3, wrapped), (4, "Before it a line\n\n" + broken + "\n\nand after it"), (5, broken)]
    rows += [(6, "yes. no. " + " ".join(f"v{i}" for i in range(9))), (7, "yes. no. " + " ".join(f"u{i}" for i in range(9)))]
    got = spans(spark, rows)
    at = rows[1][1].index(short)
    assert got[1].removed == got[3].removed == got[6].removed == got[7].removed == ""
    assert got[2].removed_chars == len(short) + 1 and got[2].removed.startswith(f"{at}:")
    assert got[4].removed == f"{rows[3][1].index('w0')}:{rows[3][1].index('w59') + 4}"
    assert got[5].removed == f"0:{len(broken)}"


def test_nothing_that_went_before_stays(spark):
    r = random.Random(9)
    lines = [" ".join(r.choice("abcdefgh") * r.randrange(1, 3) for _ in range(r.randrange(0, 12))) for _ in range(40)]
    rows = [(i, "".join(r.choice(lines) + r.choice(["\n", ". ", "!\t", ".", " \n", "?", "\n\n"]) for _ in range(r.randrange(0, 14)))) for i in range(80)] + [(None, lines[3]), (200, None)]
    text, old, new = dict(rows), spans(spark, rows, False), spans(spark, rows)
    def cover(removed):
        return [tuple(map(int, s.split(":"))) for s in removed.split(",") if s]
    for doc, x in new.items():
        now = cover(x.removed)
        assert all(a[1] <= b[0] for a, b in zip(now, now[1:]))
        assert all(any(a <= c and d <= b for a, b in now) for c, d in cover(old[doc].removed))
        kept, at = "", 0
        for a, b in now:
            kept, at = kept + (text[doc] or "")[at:a], b
        assert x.kept_sha256 == hashlib.sha256((kept + (text[doc] or "")[at:]).encode()).hexdigest()
    seen = set()
    for doc in range(80):  # each line of 25 words or more that an earlier text has is gone
        at = 0
        for line in text[doc].split("\n"):
            words = tuple(line.split())
            if len(words) >= 25 and words in seen:
                assert any(a <= at and at + len(line) <= b for a, b in cover(new[doc].removed)), (doc, line)
            seen.add(words)
            at += len(line) + 1
