"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in the words it has; a document's is
the noisy-or of its sentences', one minus the product of their complements. Only documents are
labelled: the likelihood of their labels under the noisy-or trains the weights of the words, with an
L1 penalty that leaves most at zero, and the trained sentence scores then tell where a document offends.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import small_batches
from attestra.llm.decontaminate import WORD_BYTES
from attestra.llm.sampling import labelled_sample

SENTENCE = re.compile(r"[^.!?\n]+")
#: Labelled documents of each label that training reads at most (twice as many where hashes tie).
TRAIN_PER_LABEL = 3000
LEAST_DOCUMENTS = 4
ROUNDS, STEP, L1 = 300, 0.5, 2e-5


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[bytes, float]

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(begin, end, score) of each sentence of ``text``, in code points."""
        get, out = self.weights.get, []
        for m in SENTENCE.finditer(text or ""):
            words = set(m.group().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())
            if words:
                z = self.bias + sum(get(w, 0.0) for w in words)
                out.append((m.start(), m.end(), 1 / (1 + np.exp(-z)) if z > -700 else 0.0))
        return out


def noisy_or(scores: list[float]) -> float:
    """One minus the product of the complements; 0 without scores."""
    return float(-np.expm1(np.log1p(-np.minimum(np.array(scores), 1 - 1e-12)).sum())) if scores else 0.0


def _sentences(text: str | None) -> Iterator[set[bytes]]:
    for m in SENTENCE.finditer(text or ""):
        if words := set(m.group().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()):
            yield words


def train(texts: list[str | None], labels: list[int], prevalence: float, rounds: int = ROUNDS, step: float = STEP, l1: float = L1) -> ToxicityModel:
    """Fits word weights to document labels; without both labels every score is about 0 or all alike.

    ``prevalence``: the share of toxic documents among all labelled ones, which the sample's two labels
    are weighted to.
    """
    y = np.array(labels, bool)
    if not y.any() or y.all():
        return ToxicityModel(-40.0 if not y.any() else 40.0, {})
    seen: Counter = Counter()
    for t in texts:
        seen.update(set().union(*_sentences(t)))
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= LEAST_DOCUMENTS))}
    del seen
    words, at, owner = array("i"), array("i"), array("i")
    for d, t in enumerate(texts):
        for s in _sentences(t):
            ids = [vocabulary[w] for w in s if w in vocabulary]
            words.extend(ids)
            at.extend([len(owner)] * len(ids))
            owner.append(d)
    words, at, owner = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (words, at, owner))
    share = np.where(y, prevalence / y.sum(), (1 - prevalence) / (~y).sum())
    weights, bias = np.zeros(len(vocabulary)), -np.log(2.0 * max(len(owner) / len(y), 1))
    square, square_b = np.full(len(vocabulary), 1e-8), 1e-8
    for _ in range(rounds):
        z = bias + np.bincount(at, weights[words], len(owner))
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        none = np.exp(np.bincount(owner, -np.logaddexp(0, z), len(y)))
        pull = np.where(y, -none / np.maximum(1 - none, 1e-9), 1.0) * share
        g = pull[owner] * p
        slope, slope_b = np.bincount(words, g[at], len(weights)), g.sum()
        square += slope**2
        square_b += slope_b**2
        rate = step / np.sqrt(square)
        weights -= rate * slope
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * l1, 0)
        bias -= step / np.sqrt(square_b) * slope_b
    return ToxicityModel(float(bias), {w: float(weights[i]) for w, i in vocabulary.items() if weights[i]})


def fit(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> ToxicityModel:
    """Trains on at most about ``per_label`` documents of either label.

    ``labels``: doc_id and toxic (0 or 1; null rows are left out). An id with both labels counts as toxic.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = docs.sparkSession.createDataFrame(labelled_sample(known, "toxic", per_label, ("doc_id",)), known.schema)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id", "text")).collect()  # 4 * per_label ids at most
    counts = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], (counts["toxic"] or 0) / max(counts["n"], 1))


SENTENCES = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """``docs`` with __score (0 to 1) and __offending, the sentences whose own score is ``limit`` or more.

    A null or empty text, or one without words, scores 0. Rows are never dropped. Columns of ``docs`` of the
    added names give way to them.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("__score", "__offending")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema, T.StructField("__score", T.DoubleType()), T.StructField("__offending", SENTENCES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = [], []
            for text in batch["text"]:
                each = shared.value.sentences(text.as_py())
                scores.append(noisy_or([s for _, _, s in each]))
                found.append([{"begin": b, "end": e, "score": s} for b, e, s in each if s >= limit])
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(found, kind)], names=[*batch.schema.names, "__score", "__offending"])

    return docs.mapInArrow(run, schema)
