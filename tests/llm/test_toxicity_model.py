"""The toxicity model against plain Python: features, forward pass and gradients."""

import math

import numpy as np
import pyarrow as pa

from lumenfold.llm import toxicity as t

TEXTS = ["Ab c", "", "déjà vu Déjà", "a  bb\nccc!", "x" * 40, "z"]


def buckets(text):
    """The buckets of a text's n-grams: of each lower-cased word with a blank on both sides, by bytes."""
    out = []
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    for word in low.split():
        padded = b" " + word + b" "
        for n in t.LENGTHS:
            for i in range(len(padded) - n + 1):
                h = padded[i]
                for b in padded[i + 1 : i + n]:
                    h = (h * 0x01000193 + b) % 2**32
                out.append(((h ^ (h >> 15)) * ((0x2C1B3C6D + 2 * n) % 2**32)) % 2**32 >> 16)
    return out


def test_features():
    got = {i: [] for i in range(len(TEXTS))}
    for first, _, keys, owner in t.ngram_buckets(pa.array(TEXTS)):
        for k, o in zip(keys.tolist(), owner.tolist(), strict=True):
            got[first + o].append(k)
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(buckets(x)) for i, x in enumerate(TEXTS)}


def test_scores(spark):
    r = np.random.default_rng(1)
    weights, bias = r.normal(size=t.BUCKETS).astype(np.float32), 0.25

    class Model:
        value = weights, bias

    out = next(iter(t._scorer(Model, ("doc_id",), "score")(iter([pa.record_batch({"doc_id": pa.array(range(len(TEXTS))), "text": pa.array(TEXTS)})]))))
    for text, score in zip(TEXTS, out["score"].to_pylist(), strict=True):
        b = buckets(text)
        assert abs(score - 1 / (1 + math.exp(-bias - (sum(float(weights[k]) for k in b) / len(b) if b else 0)))) < 1e-9


def test_gradients():
    r = np.random.default_rng(2)
    vectors, out, bias = r.normal(size=(7, 3)), r.normal(size=(2, 3)), r.normal(size=2)
    some = [(np.array([0, 2, 5], np.uint16), np.array([1, 3, 2], np.uint32), 1), (np.array([2], np.uint16), np.array([4], np.uint32), 0), (np.array([1, 5], np.uint16), np.array([1, 1], np.uint32), 1)]

    def loss():
        """The mean cross entropy, number by number."""
        total = 0.0
        for keys, counts, label in some:
            mean = [sum(int(n) * vectors[k][d] for k, n in zip(keys, counts, strict=True)) / int(counts.sum()) for d in range(3)]
            z = [sum(out[c][d] * mean[d] for d in range(3)) + bias[c] for c in range(2)]
            total -= z[label] - math.log(math.exp(z[0]) + math.exp(z[1]))
        return total / len(some)

    told, g_out, g_bias, used, g = t.gradients(vectors, out, bias, some)
    assert abs(told - loss()) < 1e-9 and used.tolist() == [0, 1, 2, 5]
    whole = np.zeros_like(vectors)
    whole[used] = g
    for table, slope in ((vectors, whole), (out, g_out), (bias, g_bias)):
        for at in np.ndindex(table.shape):
            was = table[at]
            table[at] = was + 1e-6
            up = loss()
            table[at] = was - 1e-6
            down = loss()
            table[at] = was
            assert abs((up - down) / 2e-6 - slope[at]) < 1e-6


def test_training_lowers_the_loss():
    r = np.random.default_rng(3)
    rows = [(np.unique(np.append(r.integers(50, 400, 12), 7 if y else 9)).astype(np.uint16), None, y) for y in (0, 1) * 40]
    rows = [(k, np.ones(len(k), np.uint32), y) for k, _, y in rows]
    weights, bias = t.fit(rows)
    right = [(weights[k].mean() + bias > 0) == bool(y) for k, _, y in rows]
    assert np.mean(right) > 0.95
