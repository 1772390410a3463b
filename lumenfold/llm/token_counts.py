"""Operator 6, token counts, by the kind of model that a file holds.

``merged`` counts the pieces of a sentencepiece BPE file by its own merges; the query uses it, as the only sentencepiece
file at hand is BPE: its scores are ranks of merges, no log-probabilities. ``counted`` is for unigram files: count-only Viterbi.

The unigram tokenizer is a model behind a metaspace pre-tokenizer: each space starts a new unit with the letter U+2581,
and so does the text. An Aho-Corasick automaton enumerates the vocabulary's matches in a unit by end; the dynamic
program keeps for each position the best score and the number of pieces on its path, no path itself. Of equal scores
the path whose last piece starts first stays, as in the tokenizer's forward pass with a strict comparison. A character that no
piece of its own covers can be unknown, at the least score of the vocabulary less 10; unknown characters count as
their UTF-8 bytes where the vocabulary has byte pieces, else a run of them as one. Units repeat, so their counts
are kept in a bounded cache.

Cases: a null text is empty and has no tokens; repeated rows and null ids are counted alike; texts of any length are counted
whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 500_000


#: Of this worker process, which serves many tasks.
_MODELS: dict = {}


def model_of(path: str):
    """The sentencepiece model of a file."""
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id of a sentencepiece file."""
    model = model_of(path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Piece counts of units and texts."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.single = {p for p in names if len(p) == 1}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.known: dict[str, int] = {}

    def unit(self, text: str) -> int:
        size = len(text)
        best: list[float | None] = [0.0] + [None] * size
        many, dark = [0] * (size + 1), [False] * (size + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for end, match in self.automaton.iter(text):
            matches[end + 1].append(match)
        for end in range(1, size + 1):
            top, start = None, -1
            for length, score in matches[end]:
                got = score + best[end - length]
                if top is None or got > top or (got == top and end - length < start):
                    top, start = got, end - length
            c = text[end - 1]
            if c not in self.single and (top is None or self.unknown + best[end - 1] > top):
                best[end], dark[end] = self.unknown + best[end - 1], True
                many[end] = many[end - 1] + (len(c.encode()) if self.bytes else not dark[end - 1])
            else:
                best[end], many[end] = top, many[start] + 1
        return many[size]

    def _new(self, word: str) -> int:
        n = self.unit(SPACE + word)
        if len(self.known) < CACHE:
            self.known[word] = n
        return n

    def text(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            del words[0]
        get, new = self.known.get, self._new
        return sum([get(w) or new(w) for w in words])


#: Of this worker process, which serves many tasks.
_COUNTERS: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(vocabulary(path))
    return _COUNTERS[path]


def _counts(docs: DataFrame, counter: Callable[[], Callable[[str], int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(map(count, texts), pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_chars long, n_tokens long")


def counted(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_chars, n_tokens), a row for each row of ``docs``, by a unigram file."""
    return _counts(docs, lambda: counter_of(path).text)


def merged(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_chars, n_tokens), a row for each row of ``docs``, by the merges of a BPE file."""

    def counter() -> Callable[[str], int]:
        encode = model_of(path).encode
        return lambda text: len(encode(text))

    return _counts(docs, counter)
