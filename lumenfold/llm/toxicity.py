"""Operator 8, toxicity: averaged embeddings of character n-grams under a linear softmax, trained jointly in numpy.

A text's features are the hashed n-grams of its lower-cased words, word edges included, so misspelt or inflected
words share most of their vectors with the words seen in training. The text's vector is the mean of the n-gram
vectors; a softmax over two classes gives the score. The model is fitted on a bounded sample of labelled rows
(``SAMPLE`` for each class, by hash of the id); n-grams are counted on the executors, so the driver holds at most
``BUCKETS`` counts for each sampled text. For scoring, vectors and softmax collapse to one weight a bucket.

Cases: a null text is empty; an empty text gets the score of the bias alone. Rows without a label, or with a null
one, are only scored. With several labels for an id the largest counts. Without rows of both classes to learn from, every score
is the share of toxic rows (0 with no rows). Repeated rows get equal scores. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import _LOWER, _WORD, text_chunks

BUCKETS = 1 << 16
LENGTHS = (3, 4, 5, 6)
DIM = 8
EPOCHS = 12
SAMPLE = 1200
BATCH = 32
RATE = 0.5


def ngram_buckets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, buckets, owner) by run of texts: each n-gram's bucket and its text's number in the run."""
    for first, last, buf, offsets in text_chunks(texts, 1 << 20):
        lens = np.diff(offsets)
        spaced = np.full(len(buf) + len(lens) + 1, 32, np.uint8)
        owner = np.repeat(np.arange(len(lens)), lens)
        spaced[np.arange(len(buf)) + owner + 1] = _LOWER[buf]
        text_of = np.repeat(np.arange(len(lens)), lens + 1)
        word = _WORD[spaced]
        spaced[~word] = 32
        run = np.zeros(len(spaced) + 1, np.int32)
        np.cumsum(~word, out=run[1:])
        h = spaced.astype(np.uint32)
        found, owners = [], []
        for n in range(2, max(LENGTHS) + 1):
            if len(spaced) < n:
                break
            h = h[: len(spaced) - n + 1] * np.uint32(0x01000193) + spaced[n - 1 :]
            if n in LENGTHS:
                at = np.flatnonzero(run[n - 1 : len(spaced)] == run[1 : len(spaced) - n + 2])
                mixed = (h[at] ^ (h[at] >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
                found.append((mixed >> np.uint32(16)).astype(np.uint16))
                owners.append(text_of[at])
        empty = np.zeros(0, np.int64)
        yield first, last, np.concatenate(found or [empty.astype(np.uint16)]), np.concatenate(owners or [empty])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for first, last, buckets, owner in ngram_buckets(batch.column("text")):
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(last - first + 1))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                keys, n = np.unique(buckets[order[lo:hi]], return_counts=True)
                rows.append((keys.tobytes(), n.astype(np.uint32).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([k for k, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.binary())], ["doc_id", "toxic", "keys", "counts"])


def gradients(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray, some: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean cross entropy of texts (buckets, counts, label), and its gradients by softmax, bias and used vectors: (loss, out, bias, used, by used)."""
    keys = np.concatenate([x for x, _, _ in some])
    parts = np.concatenate([n / n.sum() for _, n, _ in some]).astype(vectors.dtype)
    sizes = np.array([len(x) for x, _, _ in some])
    y = np.array([y for _, _, y in some])
    mean = np.add.reduceat(vectors[keys] * parts[:, None], np.cumsum(sizes) - sizes, axis=0)
    z = mean @ out.T + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-30)).mean())
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    g_mean = p @ out
    owner = np.repeat(np.arange(len(sizes)), sizes)
    used, place = np.unique(keys, return_inverse=True)
    g = np.stack([np.bincount(place, parts * g_mean[owner, d], len(used)) for d in range(vectors.shape[1])], 1).astype(vectors.dtype)
    return loss, p.T @ mean, p.sum(0), used, g


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights of buckets and bias of the log-odds, from (buckets, counts, label) of each text, by Adagrad."""
    labels = np.array([y for _, _, y in rows])
    share = labels.mean() if len(labels) else 0.0
    if not 0 < share < 1:
        return np.zeros(BUCKETS, np.float32), 50.0 if share else -50.0
    r = np.random.default_rng(seed)
    vectors = ((r.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    out[1], out[0] = 0.1, -0.1
    seen_v, seen_o, seen_b = np.full(BUCKETS, 1e-6, np.float32), np.full((2, DIM), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = r.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            some = [rows[i] for i in order[k : k + BATCH] if len(rows[i][0])]
            if not some:
                continue
            _, g_out, g_bias, used, g = gradients(vectors, out, bias, some)
            seen_o += g_out**2
            seen_b += g_bias**2
            out -= RATE * g_out / np.sqrt(seen_o)
            bias -= RATE * g_bias / np.sqrt(seen_b)
            seen_v[used] += (g**2).mean(1)
            vectors[used] -= RATE * g / np.sqrt(seen_v[used])[:, None]
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def _slices(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The numbers in each value of a binary column, as views of its buffer: nothing is copied on the driver."""
    values = column.combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) and values.num_chunks else values
    if not len(values):
        return []
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    return [data[a:b].view(kind) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def trained(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model from labelled rows outside the held-out fold (crc32 of the id's text mod 5 is 0)."""
    known = labels.where("toxic is not null and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picks = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    sample = F.broadcast(picks[0].union(picks[1]))  # 2 * SAMPLE rows at most
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id")
    texts = texts.groupBy("doc_id", F.col("toxic").cast("long").alias("toxic")).agg(F.min("text").alias("text"))
    counted = texts.mapInArrow(_count, "doc_id long, toxic long, keys binary, counts binary").toArrow().sort_by("doc_id")
    model = fit(list(zip(_slices(counted["keys"], np.uint16), _slices(counted["counts"], np.uint32), counted["toxic"].to_pylist(), strict=True)))
    del counted
    pa.default_memory_pool().release_unused()
    return model


def _scorer(model, keep: tuple[str, ...], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            z = []
            for first, last, buckets, owner in ngram_buckets(batch.column("text")):
                many = np.bincount(owner, minlength=last - first)
                z.append(bias + np.bincount(owner, weights[buckets], last - first) / np.maximum(many, 1))
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(z or [np.zeros(0)]), -50, 50)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], [*keep, name])

    return run


def with_scores(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...], name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and, as ``name``, the score of its ``text``, by a model trained on ``labels``."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))  # BUCKETS weights
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_scorer(model, keep, name), f"{schema}, {name} double")


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns, one named ``score`` too."""
    return with_scores(docs, labels, tuple(docs.columns), "_toxicity").where("_toxicity < 0.5").drop("_toxicity")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = with_scores(docs, labels, ("doc_id",))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
