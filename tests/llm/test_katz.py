"""Katz scores against a brute-force model, exact normalisation, and odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import katz


def brute_force(docs, held_out):
    split = lambda t: [*(t or "").encode().lower().split(), b" "]
    train = [split(t) for (_, t), out in zip(docs, held_out) if not out]
    words = Counter(w for t in train for w in t)
    total, distinct = sum(words.values()), len(words)
    p1 = lambda w: max(words[w], 1) / (total + 1)
    pairs = Counter(p for t in train for p in zip(["<s>", *t[:-1]], t))
    factor = katz.discounts(Counter(pairs.values()))
    d = lambda c: factor[c] if c < len(factor) else 1.0
    model = {}
    for h in {p[0] for p in pairs}:
        seen = {w: c for (g, w), c in pairs.items() if g == h}
        size, left = sum(seen.values()), sum(d(c) * c for c in seen.values())
        if size - left <= 1e-9 * size:
            size += 1
        model[h] = ({w: d(c) * c / size for w, c in seen.items()}, (1 - left / size) / (1 - sum(map(p1, seen))))
        seen, weight = model[h]
        assert sum(seen.values()) + weight * (sum(p1(w) for w in words if w not in seen) + 1 / (total + 1)) == pytest.approx(1)
    out = []
    for i, text in docs:
        t = split(text)
        base = sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in t)
        score = 0.0
        for h, w in zip(["<s>", *t[:-1]], t):
            seen, weight = model.get(h, ({}, 1.0))
            score += math.log10(seen[w] if w in seen else weight * p1(w))
        out.append((i, len(t), sum(words[w] > 0 for w in t), total, base, score))
    return out


@pytest.mark.parametrize("share", [1e-6, 0.004, 1.0])
def test_scores_are_those_of_brute_force(spark, share):
    """Whatever share of words and bigrams every worker knows: few, some, or none."""
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"W{int(k)}" for k in rng.zipf(1.4, int(rng.integers(1, 80))) if k < 500)) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \n\t"), (203, "w1 w2 " * 3000), (204, "ünknown Ünknown"), (204, "ünknown Ünknown")]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    frame = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, ids string, uid double")
    got = katz.score(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, share).collect()
    key = lambda r: (r[0], r[1])
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    want = sorted(brute_force(docs, held), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-9)


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in katz.score(frame, F.lit(True)).collect()}
    assert got[1]["n_tokens"] == 3 and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0 and got[1]["score"] == 0 and got[None]["n_tokens"] == 2
    assert katz.score(frame.limit(0), F.lit(True)).count() == 0
