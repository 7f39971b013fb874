"""Language and toxicity rebuilt in plain Python: kernels of sets, the ridge system, the gradient and the noisy-or."""

import math
import random

import numpy as np
import pytest

from attestra.llm import language, toxicity
from test_models import LANGUAGES, prose


def kernel(x, y, known):
    total = 0.0
    for order, held in zip(language.ORDERS, known, strict=True):
        a, b = ({tuple(z[i : i + order]) for i in range(len(z) - order + 1)} & held for z in (x, y))
        total += len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))
    return total / len(language.ORDERS)


def plain_language(rows, landmarks, texts):
    pieces, labels = [], []
    for text, lang in rows:
        cut = [list(map(int, s)) for s in language.segments(text)]
        for i in sorted({int(i) for i in np.linspace(0, len(cut) - 1, language.TRAIN_SEGMENTS)}):
            pieces.append(cut[i])
            labels.append(lang)
    names = sorted(set(labels))
    marks = [p for lang in names for p in [p for p, x in zip(pieces, labels) if x == lang][:landmarks]]
    known = [{tuple(m[i : i + order]) for m in marks for i in range(len(m) - order + 1)} for order in language.ORDERS]
    k, inner = (np.array([[kernel(x, m, known) for m in marks] for x in some]) for some in (pieces, marks))
    weight = np.array([len(labels) / (len(names) * labels.count(x)) for x in labels])[:, None]
    target = np.array([[1.0 if x == lang else -1.0 for lang in names] for x in labels])
    left = k.T @ (weight * k) + language.RIDGE * len(labels) * inner + 1e-9 * len(labels) * np.eye(len(marks))
    solved = np.linalg.solve(left, k.T @ (weight * target))
    out = []
    for text in texts:
        cut = [list(map(int, s)) for s in language.segments(text)]
        value = sum(len(s) * (np.array([kernel(s, m, known) for m in marks]) @ solved) for s in cut) / sum(map(len, cut))
        odds = [math.exp(language.SHARPNESS * (v - max(value))) for v in value]
        out.append((names[int(value.argmax())], 1 / sum(odds), max(value)))
    return out


def test_languages_are_those_of_plain_kernels(spark):
    rng = random.Random(8)
    rows = [(prose(rng, lang, rng.randint(20, 160)), lang) for lang in LANGUAGES for _ in range(9)]
    texts = [prose(rng, rng.choice(list(LANGUAGES)), rng.randint(3, 200)) for _ in range(30)] + [f"{prose(rng, 'aa', 60)} {prose(rng, 'bb', 60)}"]
    model = language.train(rows, landmarks=4)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predict(frame, model).collect()}
    for i, (lang, score, value) in enumerate(plain_language(rows, 4, texts)):
        assert got[i]["__lang"] == lang and got[i]["__score"] == pytest.approx(score, abs=2e-3) and got[i]["__value"] == pytest.approx(value, abs=2e-3)


def test_a_language_left_out_goes(spark):
    """Texts in a script that no label teaches go; those of the taught languages stay, and only the wanted ones if some are."""
    rng = random.Random(5)
    rows = [(i, prose(rng, lang := rng.choice(["aa", "bb"]), rng.randint(20, 200)), lang, i) for i in range(200)]
    rows += [(500 + i, " ".join(rng.choice(["язык", "слово", "которые", "также"]) for _ in range(80)), None, 0) for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, __VALUE long")
    kept = language.keep_known(frame)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == set(range(200))
    assert {r["lang"] for r in language.keep_known(frame, ["bb"]).collect()} == {"bb"}


def plain_toxicity(texts, labels, prevalence, rounds):
    bags = [[set(s.lower().split()) for s in t.split(".") if s.split()] for t in texts]
    counts = {}
    for bag in bags:
        for w in set().union(*bag):
            counts[w] = counts.get(w, 0) + 1
    weights = {w: 0.0 for w, n in counts.items() if n >= toxicity.LEAST_DOCUMENTS}
    bias = -math.log(2.0 * max(sum(map(len, bags)) / len(bags), 1))
    squares, square_b = {w: 1e-8 for w in weights}, 1e-8
    n_toxic = sum(labels)
    for _ in range(rounds):
        slope, slope_b = {w: 0.0 for w in weights}, 0.0
        for bag, y in zip(bags, labels):
            scores = [1 / (1 + math.exp(-bias - sum(weights.get(w, 0.0) for w in s))) for s in bag]
            none = math.prod(1 - p for p in scores)  # no sentence offends
            share = prevalence / n_toxic if y else (1 - prevalence) / (len(labels) - n_toxic)
            for s, p in zip(bag, scores):
                pull = (-none / max(1 - none, 1e-9) if y else 1.0) * share * p
                slope_b += pull
                for w in s:
                    if w in weights:
                        slope[w] += pull
        for w in weights:
            squares[w] += slope[w] ** 2
            rate = toxicity.STEP / math.sqrt(squares[w])
            moved = weights[w] - rate * slope[w]
            weights[w] = math.copysign(max(abs(moved) - rate * toxicity.L1, 0.0), moved)
        square_b += slope_b**2
        bias -= toxicity.STEP / math.sqrt(square_b) * slope_b
    return bias, weights, bags


def test_toxicity_is_that_of_the_plain_gradient(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    texts = [". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 6))) for _ in range(80)]
    labels = [int("w7" in t.split() or rng.random() < 0.1) for t in texts]
    bias, weights, bags = plain_toxicity(texts, labels, 0.2, 40)
    model = toxicity.train(texts, labels, 0.2, rounds=40)
    assert model.bias == pytest.approx(bias, rel=1e-6)
    assert {w.decode(): pytest.approx(x, rel=1e-6, abs=1e-9) for w, x in model.weights.items()} == {w: x for w, x in weights.items() if x}
    got = {r["doc_id"]: r["__score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, bag in enumerate(bags):
        assert got[i] == pytest.approx(1 - math.prod(1 - 1 / (1 + math.exp(-bias - sum(weights.get(w, 0.0) for w in s))) for s in bag), rel=1e-6)
