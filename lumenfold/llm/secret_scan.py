"""Operator 3, secret scans: a trigram inverted index in front of the rules' regular expressions.

Each rule names its regular expression; ``trigram_query`` derives from the parsed expression a Boolean query over
trigrams (any of several sets of mandatory ones, letters of both cases folded) that every match implies. Texts are
indexed by block of an Arrow batch: one vectorised pass finds the positions of the trigrams that some rule asks
for and turns them into postings, sorted lists of texts. A rule's postings are intersected and united as its query
says, and only those candidates are verified with the expression. A rule without mandatory trigrams scans every text.

Matches are leftmost and do not overlap within a rule; a match that is too short is dropped after it was made.
Spans are in code points, the end exclusive, over whole texts.

Cases: a null text is empty and has no spans; repeated rows are scanned alike; a text longer than a block is a block of its own;
an empty table gives an empty result; extra columns are ignored, but that one named ``spans`` gives way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import _LOWER, text_chunks


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of a group (0: the match) for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])

# The expressions and least lengths of the base kinds.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Added kinds: well-known token shapes, which ordinary prose doesn't have.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE

Query = frozenset  # of frozensets of trigrams: any of them, all of whose trigrams occur; an empty inner set: no condition


def _strings(parsed, cap: int = 64) -> tuple[list[str] | None, list[frozenset]]:
    """For a sequence: its exact strings where they are few, and else the trigram sets that its parts ask for."""
    exact: list[str] | None = [""]
    asked: list[list[frozenset]] = []

    def close(strings: list[str] | None) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            asked.append([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])

    whole = True
    for op, arg in parsed:
        options: list[str] | None = None
        inner: list[frozenset] = []
        if op is C.LITERAL:
            options = [chr(arg).lower()] if arg < 128 else None
        elif op is C.IN and arg[0][0] is not C.NEGATE:
            chars = {chr(v).lower() for o, v in arg if o is C.LITERAL and v < 128}
            options = sorted(chars) if len(chars) == 1 and all(o is C.LITERAL for o, _ in arg) else None
        elif op is C.SUBPATTERN:
            options, inner = _strings(arg[3])
        elif op is C.BRANCH:
            got = [_strings(b) for b in arg[1]]
            if all(x is not None for x, _ in got):
                options = sorted({s for x, _ in got for s in x})
            else:
                inner = [t for x, sets in got for t in (sets or ([frozenset()] if x is None or min(map(len, x)) < 3 else [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in x]))]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, sub = arg
            if (low, high) == (0, 1):
                once, _ = _strings(sub)
                options = None if once is None else ["", *once]
            elif low >= 1:
                _, inner = _strings(sub)
        if options is not None and exact is not None and len(exact) * len(options) <= cap:
            exact = [a + b for a in exact for b in options]
            continue
        close(exact)
        whole = False
        if inner and all(inner):
            asked.append(inner)
        exact = options if options is not None else [""]
    if whole:
        return exact, []
    close(exact)
    return None, min(asked, key=lambda sets: (-min(map(len, sets)), len(sets)), default=[])


def trigram_query(pattern: str) -> Query | None:
    """The trigrams that any match of ``pattern`` has, lower-cased: any of the sets, all of a set; None if there are none."""
    exact, sets = _strings(_parser.parse(pattern))
    if exact is not None:
        sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact]
    return frozenset(sets) if sets and all(sets) else None


def _code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


class Index:
    """Postings of a block of texts, for the trigrams that ``queries`` ask for."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
        low = _LOWER[buf].astype(np.int32)
        codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:] if len(low) > 2 else np.zeros(0, np.int32)
        first = np.zeros(256, bool)
        first[wanted >> 16] = True
        at = np.flatnonzero(first[low[: len(codes)]])
        at = at[np.isin(codes[at], wanted)]
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[text + 1]
        self.size = len(offsets) - 1
        pairs = np.unique(codes[at[inside]].astype(np.int64) << 32 | text[inside])
        keys = pairs >> 32
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(0, int)
        self.postings = {int(keys[a]): pairs[a:b] & 0xFFFFFFFF for a, b in zip(cuts[:-1], cuts[1:], strict=True)}

    def candidates(self, query: Query | None) -> np.ndarray:
        if query is None:
            return np.arange(self.size)
        none = np.zeros(0, np.int64)
        found = [none]
        for trigrams in query:
            lists = sorted((self.postings.get(_code(t), none) for t in trigrams), key=len)
            both = lists[0]
            for other in lists[1:]:
                both = np.intersect1d(both, other, assume_unique=True)
            found.append(both)
        return np.unique(np.concatenate(found))


def _found(text: str, rule: Rule, expression: re.Pattern) -> list[tuple[int, int]]:
    return [m.span() for m in expression.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _without(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...], mark: str) -> str:
    """``text`` with each union of overlapping spans replaced by a mark that names the first one's kind."""
    parts, at = [], 0
    for start, place, end in spans:
        if start >= at:
            parts += [text[at:start], mark.replace("{}", rules[place].kind)]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _scanner(rules: tuple[Rule, ...], keep: tuple[str, ...], mark: str | None = None):
    """Batches with ``spans`` after the columns ``keep``; with a ``mark`` instead with ``text`` rewritten by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        expressions = [re.compile(r.pattern) for r in rules]
        # A rule that asks for one run of a class and a least length of the match can ask for the length at once.
        expressions = [re.compile(r.pattern[:-1] + f"{{{r.least},}}") if q is None and r.least and not r.group and re.fullmatch(r"\[[^\]]*\]\+", r.pattern) else e for r, q, e in zip(rules, queries, expressions, strict=True)]
        wanted = np.array(sorted({_code(t) for q in queries if q for s in q for t in s}), np.int32)
        for batch in batches:
            column = batch.column("text").fill_null("")
            spans: list[list] = [[] for _ in range(len(column))]
            for first, last, buf, offsets in text_chunks(column):
                index = Index(buf, offsets, wanted)
                texts: dict[int, str] = {}
                for place, (rule, query, expression) in enumerate(zip(rules, queries, expressions, strict=True)):
                    for i in index.candidates(query).tolist():
                        if i not in texts:
                            texts[i] = buf[offsets[i] : offsets[i + 1]].tobytes().decode()
                        spans[first + i] += [(a, place, b) for a, b in _found(texts[i], rule, expression)]
            for s in spans:
                s.sort()
            if mark is not None:
                done = {i: _without(column[i].as_py(), s, rules, mark) for i, s in enumerate(spans) if s}
                text = pa.array([done.get(i, t) for i, t in enumerate(batch.column("text").to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in keep], list(keep))
                continue
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
            made = pa.array([[{"start": a, "kind": rules[k].kind, "end": b} for a, k, b in s] for s in spans], kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], [*keep, "spans"])

    return run


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``spans``: array of (start, kind, end) of its ``text``, by start, then in the order of the rules; in place of a
    column of that name."""
    docs = docs.drop("spans")
    keep = tuple(docs.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scanner(rules, keep), f"{schema}, spans array<struct<start: bigint, kind: string, end: bigint>>")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[{}]") -> DataFrame:
    """``docs`` with each union of overlapping spans in ``text`` replaced by a mark that names the first one's kind."""
    keep = tuple(docs.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scanner(rules, keep, mark), schema)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) as the query returns them."""
    found = secret_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    names = [r.kind for r in BASE]
    base = F.filter("spans", lambda s: s.kind.isin(names))
    count = lambda name: F.size(F.filter("spans", lambda s: s.kind == name)).cast("long")
    counts = [count(n).alias(f"n_{n}") for n in names]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
