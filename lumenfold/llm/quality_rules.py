"""Operator 13, quality: a sparse ensemble of rules over statistics of whole texts, compiled into column expressions.

Boosted trees of depth ``DEPTH`` are grown on the statistics of labelled texts; every path from a root to a node is a rule, a conjunction of
bounds. A lasso-penalised logistic regression weighs the rules, and most get no weight. What is left is one Spark expression over the columns of
statistics: ``score_of`` sums the weights of the rules that hold. Statistics are shares and means over all bytes and words of a text, so
they are as wide as a few numbers a text however long it is. The model is fitted on the driver, from the statistics alone of a bounded sample
of labelled rows (``SAMPLE`` for each class, by hash of the id); rows weigh what their class has of all labelled rows.

Cases: a null text is empty; a text without words has statistics of 0. Rows without a label, or with a null one, are only scored. With several
labels for an id the largest counts, and of several texts for it the least is learned from. Without rows of both classes to learn from, every score
is the share of rows labelled 1 (0 with no rows). Equal texts get equal scores; an empty table of documents gives an empty result. Texts of
any length are read whole, in runs of about a megabyte. Extra columns are ignored, and kept by ``filtered``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import mix, text_chunks, word_hashes

SAMPLE = 2000
TREES = 40
DEPTH = 3
#: Bounds tried for a statistic, at quantiles of the sample.
BOUNDS = 48
#: Rows that a leaf has at least.
LEAST = 8
#: Words of a stretch, within which a share of distinct words doesn't fall with a text's length.
STRETCH = 128
RATE = 0.3
#: The lasso's penalty, as a share of the least one that leaves no rule.
PENALTY = 0.005
STEPS = 800

#: Shares of the characters that aren't blank, but for capitals (of ASCII letters); then means, counts and shares of words.
STATISTICS = ("letters", "capitals", "digits", "symbols", "exclaims", "stops", "wide", "chars", "words", "word_bytes", "words_a_line", "unlettered", "ends_in_symbol", "repeats_last", "distinct", "distinct_nearby", "commonest", "sentence_words")

_KIND = np.full(256, 7, np.uint8)  # other printable and control bytes: symbols
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[list(b".,;:")], _KIND[list(b"!?")], _KIND[list(b"'\"-()")] = 4, 5, 6
_KIND[0xC0:], _KIND[0x80:0xC0] = 8, 9
_KINDS = 10


def text_statistics(texts: pa.Array) -> Iterator[np.ndarray]:
    """Matrices of ``STATISTICS``, a row a text, for runs of texts in turn."""
    for first, last, buf, offsets in text_chunks(texts):
        n = last - first
        kind = _KIND[buf]
        owner = np.repeat(np.arange(n), np.diff(offsets))
        by_kind = np.bincount(owner * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(np.float64)
        h, firsts, starts, ends = word_hashes(buf, offsets)
        words = np.diff(firsts).astype(np.float64)

        def by_text(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
            total = np.zeros(len(values) + 1, np.int64)
            np.cumsum(values, out=total[1:])
            return (total[cuts[1:]] - total[cuts[:-1]]).astype(np.float64)

        share = lambda x, of: np.divide(x, of, out=np.zeros(n), where=of > 0)
        blank, lower, upper, digit, stop, exclaim, quote, symbol, wide, rest = by_kind.T
        solid = lower + upper + digit + stop + exclaim + quote + symbol + wide
        lettered = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((kind == 1) | (kind == 2) | (kind == 8), out=lettered[1:])
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        again[firsts[:-1][firsts[:-1] < len(h)]] = False
        distinct, nearby, commonest = np.zeros(n), np.zeros(n), np.zeros(n)
        for i in np.flatnonzero(words):
            own = h[firsts[i] : firsts[i + 1]]
            many = np.unique(own, return_counts=True)[1]
            distinct[i], commonest[i] = len(many), many.max()
            nearby[i] = len(many) if len(own) <= STRETCH else len(np.unique(mix(own + (np.arange(len(own)) // STRETCH).astype(np.uint64), 17)))
        lines = by_text(buf == 10, offsets) + 1
        dots = by_text((buf == 46) | (buf == 33) | (buf == 63), offsets)
        yield np.stack([
            share(lower + upper + wide, solid), share(upper, lower + upper), share(digit, solid), share(symbol, solid), share(exclaim, solid), share(stop, solid), share(wide, solid), solid + blank, words,
            share(by_text(ends - starts, firsts), words), words / lines, share(by_text(lettered[ends] == lettered[starts], firsts), words), share(by_text(kind[ends - 1] == 7, firsts), words),
            share(by_text(again, firsts), words), share(distinct, words), share(nearby, words), share(commonest, words), words / (dots + 1),
        ], 1)


def with_statistics(docs: DataFrame, keep: tuple[str, ...], prefix: str = "") -> DataFrame:
    """The columns ``keep`` of ``docs``, and the statistics of its ``text``, their names after ``prefix``."""
    names = [f"{prefix}{s}" for s in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([*text_statistics(batch.column("text")), np.zeros((0, len(names)))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(np.ascontiguousarray(x)) for x in found.T)], [*keep, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([schema, *(f"`{x}` double" for x in names)]))


#: Bounds of a rule: (statistic, above, bound), held by values above the bound, or else up to it.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[float, Rule], ...]  # with their weights


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    """Which rows of statistics ``rule`` holds for."""
    out = np.ones(len(x), bool)
    for k, above, bound in rule:
        out &= (x[:, k] > bound) == above
    return out


def _tree(x: np.ndarray, bounds: list[np.ndarray], slope: np.ndarray, weight: np.ndarray, rows: np.ndarray, path: Rule = ()) -> list[tuple[Rule, np.ndarray, bool]]:
    """Nodes under ``path``: (path, rows, whether a leaf), split where the weighted squared error of ``slope`` falls most."""
    node = [(path, rows, True)] if path else []
    if len(path) >= DEPTH or len(rows) < 2 * LEAST:
        return node
    s, w = slope[rows] * weight[rows], weight[rows]
    best, chosen = s.sum() ** 2 / w.sum() + 1e-9, None
    for k, tried in enumerate(bounds):
        if not len(tried):
            continue
        place = np.searchsorted(tried, x[rows, k], "left")  # bounds below the value: it is up to the ones from there on
        upto_s, upto_w, upto_n = (np.cumsum(np.bincount(place, v, len(tried) + 1))[:-1] for v in (s, w, np.ones(len(rows))))
        fit = (upto_n >= LEAST) & (len(rows) - upto_n >= LEAST)
        gain = np.where(fit, upto_s**2 / np.maximum(upto_w, 1e-12) + (s.sum() - upto_s) ** 2 / np.maximum(w.sum() - upto_w, 1e-12), -1)
        at = int(gain.argmax())
        if gain[at] > best:
            best, chosen = gain[at], (k, float(tried[at]))
    if chosen is None:
        return node
    above = x[rows, chosen[0]] > chosen[1]
    under = [*_tree(x, bounds, slope, weight, rows[~above], (*path, (chosen[0], False, chosen[1]))), *_tree(x, bounds, slope, weight, rows[above], (*path, (chosen[0], True, chosen[1])))]
    return [*([(path, rows, False)] if path else []), *under]


def shortened(path: Rule) -> Rule:
    """``path`` with the tightest bound alone of those on the same side of a statistic, in their order."""
    tight: dict[tuple[int, bool], float] = {}
    for k, above, bound in path:
        old = tight.get((k, above), bound)
        tight[k, above] = max(old, bound) if above else min(old, bound)
    return tuple((k, above, bound) for (k, above), bound in sorted(tight.items()))


def grown(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 3) -> list[Rule]:
    """The paths of boosted trees, each grown on half of the rows; of paths that hold for the same rows, or for all others, the first."""
    r = np.random.default_rng(seed)
    bounds = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        mid = (values[1:] + values[:-1]) / 2
        bounds.append(np.unique(mid[np.linspace(0, len(mid) - 1, min(BOUNDS, len(mid))).round().astype(int)]) if len(mid) else mid)
        if len(mid) > BOUNDS:  # by rows, too, so that bounds lie where rows do
            at = np.quantile(x[:, k], np.linspace(0, 1, BOUNDS)[1:-1])
            bounds[-1] = np.unique(np.concatenate([bounds[-1], mid[np.clip(np.searchsorted(mid, at), 0, len(mid) - 1)]]))
    share = (weight * y).sum() / weight.sum()
    z = np.full(len(y), np.log(share / (1 - share)))
    found: dict[bytes, Rule] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        some = np.sort(r.permutation(len(y))[: max(2 * LEAST, len(y) // 2)])
        for path, rows, leaf in _tree(x, bounds, y - p, weight, some):
            rule = shortened(path)
            held = holds(rule, x)
            if leaf:
                w, q = weight[rows], p[rows]
                z[held] += RATE * np.clip((w * (y[rows] - q)).sum() / max((w * q * (1 - q)).sum(), 1e-6), -4, 4)
            if held.any() and not held.all():
                key = np.packbits(held if not held[0] else ~held).tobytes()
                found.setdefault(key, rule)
    return list(found.values())


def lasso(held: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Bias and weights of columns of 0 and 1, by accelerated proximal steps on the weighted logistic loss with an absolute penalty."""
    v = weight / weight.sum()
    share = float((v * y).sum())
    center = (v[:, None] * held).sum(0)
    spread = np.sqrt(np.maximum(center * (1 - center), 1e-6))  # so that rare rules are penalised like others
    h = (held - center) / spread
    most = np.abs(h.T @ (v * (y - share))).max(initial=0.0)
    step = 4 / (np.linalg.norm(np.sqrt(v)[:, None] * h, 2) ** 2 + 1)
    b, bias = np.zeros(h.shape[1]), np.log(share / (1 - share))
    ahead, ahead_bias, t = b.copy(), bias, 1.0
    for _ in range(STEPS):
        slope = v * (1 / (1 + np.exp(-np.clip(h @ ahead + ahead_bias, -60, 60))) - y)
        new = ahead - step * (h.T @ slope)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY * most, 0)
        new_bias = ahead_bias - step * slope.sum()
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, ahead_bias = new + (last - 1) / t * (new - b), new_bias + (last - 1) / t * (new_bias - bias)
        b, bias = new, new_bias
    return float(bias - (b * center / spread).sum()), b / spread


def fit(x: np.ndarray, y: np.ndarray, shares: tuple[float, float]) -> Model:
    """The model of statistics and labels; ``shares``: how many rows of all each class has."""
    if not (y == 0).any() or not (y == 1).any():
        score = float(len(y) > 0 and y[0] == 1)
        return Model(50.0 if score else -50.0, ())
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    weight = weight / weight.mean()
    rules = grown(x, y, weight)
    bias, weights = lasso(np.stack([holds(r, x) for r in rules], 1).astype(np.float64), y, weight) if rules else (float(np.log(shares[1] / shares[0])), [])
    return Model(bias, tuple((float(w), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-9))


def known(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labels to learn from, outside the held-out fold (crc32 of the id's text mod 3 is 1)."""
    some = labels.where("quality is not null and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    return some.groupBy("doc_id").agg(F.max("quality").alias("quality"))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    some = known(labels)
    picks = [some.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    sample = F.broadcast(picks[0].union(picks[1]))  # 2 * SAMPLE rows at most
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = with_statistics(texts, ("doc_id", "quality")).toPandas().sort_values("doc_id")
    many = {r[0]: r[1] for r in some.groupBy("quality").count().collect()}
    return fit(found[list(STATISTICS)].to_numpy(), found["quality"].to_numpy(np.int64), (many.get(0, 0), many.get(1, 0)))


def score_of(model: Model, prefix: str = "") -> Column:
    """The score as an expression over columns of statistics named after ``prefix``."""
    total = F.lit(model.bias)
    for weight, rule in model.rules:
        bounds = [F.col(prefix + STATISTICS[k]) > bound if above else F.col(prefix + STATISTICS[k]) <= bound for k, above, bound in rule]
        every = bounds[0]
        for more in bounds[1:]:
            every = every & more
        total = total + F.when(every, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), total))))


def described(model: Model) -> list[str]:
    """The rules in words, those of the largest weights first."""
    said = [(w, " and ".join(f"{STATISTICS[k]} {'>' if above else '<='} {bound:.4g}" for k, above, bound in rule)) for w, rule in model.rules]
    return [f"{w:+.3f} if {text}" for w, text in sorted(said, key=lambda x: -abs(x[0]))]


def with_scores(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...], name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and, as ``name``, the score of its ``text``, by a model trained on ``labels``."""
    model = trained(docs, labels)
    return with_statistics(docs, keep, "_stat_").select(*keep, score_of(model, "_stat_").alias(name))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns."""
    return with_scores(docs, labels, tuple(docs.columns), "_quality").where("_quality >= 0.5").drop("_quality")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    out = with_scores(docs, labels, ("doc_id",))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
