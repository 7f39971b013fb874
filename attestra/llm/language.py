"""Language identification by a string kernel.

A text is cut into segments of ``SEGMENT`` symbols (letters, bytes of other scripts, and one symbol
for everything between words). The blended-spectrum kernel of two segments is the mean over n = 1..3
of the number of n-grams both have, over the root of the product of the numbers each has. Landmarks
are sampled segments (Nystroem); kernel ridge regression on the kernel values against them is fitted
one language against the rest, over all segments of all labelled texts. A document's values are the means of its segments', from products of
0/1 matrices, segments by n-grams, with the landmarks' weights: any length of text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import set_aside, small_batches
from attestra.llm.sampling import labelled_sample

SEGMENT = 512
ORDERS = (1, 2, 3)
#: Segments of a text that give landmarks, landmarks of each language.
TRAIN_SEGMENTS, LANDMARKS = 3, 64
RIDGE = 1e-3
SHARPNESS = 4.0
UNKNOWN = "und"
#: What ``predict`` adds to the documents.
ADDED = ("__lang", "__score", "__value")
ROWS = 512

SYMBOLS = 160
#: Between words 0, A-Z and a-z 1 to 26, bytes of other characters from 27 on.
SYMBOL_OF = np.array([b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else 27 + b - 128 if b >= 128 else 0 for b in range(256)], np.int32)


def symbols(text: str) -> np.ndarray:
    """The text's symbols between two zeros, runs of zeros made one."""
    raw = SYMBOL_OF[np.frombuffer(f" {text} ".encode("utf-8", "replace"), np.uint8)]
    return raw[np.concatenate([[True], (raw[1:] != 0) | (raw[:-1] != 0)])]


def segments(text: str, size: int = SEGMENT) -> list[np.ndarray]:
    """Segments of ``size`` symbols; a last one under half of that joins the one before."""
    x = symbols(text)
    n = max(1, (len(x) + size // 2) // size)
    return [x[i * size : (i + 1) * size if i < n - 1 else len(x)] for i in range(n)]


def grams(x: np.ndarray, order: int) -> np.ndarray:
    code = x[: len(x) - order + 1].astype(np.int64)
    for k in range(1, order):
        code = code * SYMBOLS + x[k : len(x) - order + 1 + k]
    return code


def tables_of(known: list[np.ndarray]) -> list[np.ndarray]:
    """By order: the column of each possible n-gram, -1 where it is not known."""
    out = []
    for order, codes in zip(ORDERS, known, strict=True):
        table = np.full(SYMBOLS**order, -1, np.int32)
        table[codes] = np.arange(len(codes))
        out.append(table)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    codes: list[np.ndarray]  # by order: the n-grams known, in order
    weights: list[np.ndarray]  # by order: n-grams by languages

    @lru_cache(maxsize=1)  # noqa: B019  one model lives in a worker
    def tables(self) -> list[np.ndarray]:
        return tables_of(self.codes)

    __hash__ = object.__hash__

    def values(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Segments by languages."""
        out = np.zeros((len(pieces), len(self.languages)))
        for at in range(0, len(pieces), ROWS):
            some = pieces[at : at + ROWS]
            for order, table, weights in zip(ORDERS, self.tables(), self.weights, strict=True):
                held = presence(some, order, table, weights.shape[0])
                out[at : at + ROWS] += (held @ weights) / np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))
        return out


    def means(self, text: str) -> np.ndarray:
        """A text's value for each language: the mean of its segments', by their lengths."""
        cut = segments(text)
        return np.average(self.values(cut), axis=0, weights=[len(p) for p in cut])

    def best(self, text: str) -> float:
        return float(self.means(text).max())


def presence(pieces: list[np.ndarray], order: int, table: np.ndarray, columns: int) -> np.ndarray:
    """0/1 matrix, segments by n-grams."""
    held = np.zeros((len(pieces), columns), np.float32)
    for row, x in zip(held, pieces, strict=True):
        at = table[grams(x, order)] if len(x) >= order else table[:0]
        row[at[at >= 0]] = 1
    return held


@dataclass
class Basis:
    """Landmarks: by order, the n-grams that they hold and their scaled 0/1 rows."""

    codes: list[np.ndarray]
    marks: list[np.ndarray]

    @staticmethod
    def of(pieces: list[np.ndarray]) -> Basis:
        basis = Basis([np.unique(np.concatenate([grams(p, order) for p in pieces if len(p) >= order] or [np.zeros(0, np.int64)])) for order in ORDERS], [])
        basis.marks = [basis.scaled(pieces, k) / len(ORDERS) for k in range(len(ORDERS))]
        return basis

    @lru_cache(maxsize=1)  # noqa: B019  one basis lives in a worker
    def tables(self) -> list[np.ndarray]:
        return tables_of(self.codes)

    __hash__ = object.__hash__

    def scaled(self, pieces: list[np.ndarray], k: int) -> np.ndarray:
        held = presence(pieces, ORDERS[k], self.tables()[k], len(self.codes[k]))
        return held / np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))

    def kernels(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Segments by landmarks."""
        blocks = [pieces[at : at + ROWS] for at in range(0, len(pieces), ROWS)]
        return np.concatenate([sum((self.scaled(some, k) @ m.T).astype(np.float64) for k, m in enumerate(self.marks)) for some in blocks])

    def solved(self, languages: list[str], left: np.ndarray, right: np.ndarray, total: float, ridge: float) -> LanguageModel:
        """The regression's model from its sums over all segments: kernel by kernel, kernel by target, and their number."""
        inner = sum((m * len(ORDERS)).astype(np.float64) @ m.T for m in self.marks)
        weights = np.linalg.solve(left + ridge * total * inner + 1e-9 * total * np.eye(len(left)), right)
        return LanguageModel(languages, self.codes, [(m.T @ weights).astype(np.float32) for m in self.marks])


def labelled_segments(rows: Iterable[tuple[str | None, str]], per_text: int) -> tuple[list[np.ndarray], list[str]]:
    """``per_text`` segments of each text, spread over it, and their languages."""
    pieces, labels = [], []
    for text, language in rows:
        if text and has_letter(text):
            cut = segments(text)
            for i in np.unique(np.linspace(0, len(cut) - 1, per_text).astype(int)):
                pieces.append(cut[i])
                labels.append(language)
    return pieces, labels


def basis_of(pieces: list[np.ndarray], labels: list[str], landmarks: int) -> Basis:
    """The first ``landmarks`` segments of each language."""
    said = np.array(labels)
    return Basis.of([pieces[i] for x in sorted(set(labels)) for i in np.flatnonzero(said == x)[:landmarks]])


def targets(labels: np.ndarray, languages: int) -> np.ndarray:
    return np.where(labels[:, None] == np.arange(languages), 1.0, -1.0)


def train(rows: list[tuple[str | None, str]], landmarks: int = LANDMARKS, per_text: int = TRAIN_SEGMENTS, ridge: float = RIDGE) -> LanguageModel:
    """Kernel ridge regression on (text, language) rows in memory, with the first segments of each language as landmarks."""
    pieces, labels = labelled_segments(rows, per_text)
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], [], [])
    basis = basis_of(pieces, labels, landmarks)
    at = np.array([languages.index(x) for x in labels])
    weight = (len(at) / (len(languages) * np.bincount(at, minlength=len(languages))))[at][:, None]
    kernel = basis.kernels(pieces)
    return basis.solved(languages, kernel.T @ (weight * kernel), kernel.T @ (weight * targets(at, len(languages))), len(at), ridge)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(docs: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """The regression over all segments of all labelled texts (doc_id, text, lang).

    Its sums are made in Spark. Only the landmarks, ``landmarks`` segments of each language, are sampled. A text's
    segments weigh as much as one text, by their lengths, and all languages weigh the same.
    """
    docs = _labelled(docs)
    return _fitted(docs, {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}, landmarks, ridge)


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.where("lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")


def _fitted(docs: DataFrame, counts: dict[str, int], landmarks: int, ridge: float) -> LanguageModel:
    """counts: the labelled texts of each language, one entry for each."""
    pieces, labels = labelled_segments(((r["text"], r["lang"]) for r in labelled_sample(docs, "lang", landmarks)), TRAIN_SEGMENTS)
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], [], [])
    basis, n = basis_of(pieces, labels, landmarks), len(docs_of := [counts[x] for x in languages])
    place, balance, size = {x: k for k, x in enumerate(languages)}, [sum(docs_of) / (n * d) for d in docs_of], len(basis.marks[0])
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(basis)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = shared.value, np.zeros((size, size + n))
        cut: list[np.ndarray] = []
        said: list[int] = []
        weights: list[float] = []

        def add() -> None:
            if cut:
                kernel, weight = known.kernels(cut), np.array(weights)[:, None]
                total[:, :size] += kernel.T @ (weight * kernel)
                total[:, size:] += kernel.T @ (weight * targets(np.array(said), n))
                for some in (cut, said, weights):
                    some.clear()

        for batch in batches:
            for text, language in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                if language in place and has_letter(text):
                    own = segments(text)
                    cut.extend(own)
                    said.extend([place[language]] * len(own))
                    length = sum(map(len, own))
                    weights.extend(balance[place[language]] * len(x) / length for x in own)
                    if len(cut) >= 4 * ROWS:
                        add()
        add()
        part = TaskContext.get().partitionId()
        for i in range(0, size, ROWS):
            rows = total[i : i + ROWS]
            if rows.any():
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array(range(i, i + len(rows)), pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], names=["part", "i", "row"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": frame["i"].iloc[:1], "row": [np.sum(np.stack(frame.sort_values("part")["row"].to_list()), axis=0)]})

    parts = docs.select("text", "lang").mapInArrow(sums, "part int, i int, row array<double>")
    total = np.zeros((size, size + n))
    for r in parts.groupBy("i").applyInPandas(added, "i int, row array<double>").toLocalIterator():  # one row for each landmark
        total[r["i"]] = r["row"]
    return basis.solved(languages, total[:, :size], total[:, size:], sum(docs_of), ridge)


def fit_with_limit(docs: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[LanguageModel, float]:
    """A model, and half of the least value that a held-out text of a taught language reaches.

    Every labelled text does one or the other: a quarter, by a hash of id and text, gives the limit, and all others
    train. The first text of each language in hash order always trains.
    """
    mark = F.xxhash64("doc_id", "text")
    rows = _labelled(docs).withColumn("__mark", mark)
    quarter = F.pmod("__mark", F.lit(4)) == 0
    seen = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(quarter).alias("held"), F.min("__mark").alias("first")).collect()  # one row for each language
    always = [r["first"] for r in seen]
    held = quarter & ~F.col("__mark").isin(always)
    inner = {r["lang"]: r["n"] - r["held"] + (r["first"] % 4 == 0) for r in seen}
    model = _fitted(rows.where(~held).drop("__mark"), inner, landmarks, ridge)
    if not model.languages:
        return model, 0.0
    least = predict(rows.where(held).select("text"), model).where(F.col("__lang") != UNKNOWN).agg(F.min("__value")).first()[0]
    return model, max(0.0, (least or 0.0) / 2)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with __lang, __score (0 to 1) and __value, from the text alone.

    __value is the regression's own for that language: about 1 for its texts and 0 for what has nothing in
    common with any. A null text or one without a letter is ``und`` with score and value 0, as is every text
    if nothing was learned. Columns of ``docs`` of the added names give way to them.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*ADDED)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema, *[T.StructField(n, T.StringType() if n == "__lang" else T.DoubleType()) for n in ADDED]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            names, scores, best = [UNKNOWN] * len(batch), [0.0] * len(batch), [0.0] * len(batch)
            waiting: list[tuple[int, int]] = []
            pieces: list[np.ndarray] = []

            def flush() -> None:
                if not pieces:
                    return
                values, at = known.values(pieces), 0
                for row, n in waiting:
                    mean = np.average(values[at : at + n], axis=0, weights=[len(p) for p in pieces[at : at + n]])
                    odds = np.exp(SHARPNESS * (mean - mean.max()))
                    names[row], scores[row], best[row] = known.languages[int(mean.argmax())], float(1 / odds.sum()), float(mean.max())
                    at += n
                waiting.clear()
                pieces.clear()

            for row, text in enumerate(batch["text"]):
                text = text.as_py()
                if text and known.languages and has_letter(text):
                    cut = segments(text)
                    waiting.append((row, len(cut)))
                    pieces += cut
                    if len(pieces) >= 4 * ROWS:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(best, pa.float64())], names=[*batch.schema.names, *ADDED])

    return docs.mapInArrow(run, schema)


def keep_known(docs: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """``docs`` without the texts that are in no language the labels teach, or in none of ``wanted``.

    What has no letter goes, and what is less than half as typical of its language as the least typical of the
    labelled texts that were held out (see ``fit_with_limit``). Without any label nothing is known and all texts go.
    """
    kept, back = set_aside(docs, ADDED)
    model, limit = fit_with_limit(docs)
    found = predict(kept, model)
    fits = (F.col("__lang") != UNKNOWN) & (F.col("__value") > limit)
    if wanted is not None:
        fits = fits & F.col("__lang").isin(list(wanted))
    return found.where(fits).select(*[F.col(f"`{c}`") for c in kept.columns]).withColumnsRenamed(back)
