"""Katz backoff language model over words: counted, stored and evaluated in hash partitions.

Every word counts as itself. Counts of words and of bigrams, and denominator and backoff weight of every
history, are tables of (bucket, keys, values) rows. Good-Turing discounts leave mass in each history,
which its backoff weight gives to the words that did not follow it, in proportion to their unigram
probabilities c / (N + 1), of which a word never seen has 1 / (N + 1). So for every history the
probabilities of all words and of one unknown word sum to one.

Texts are encoded in chunks. A chunk tells each bucket of bigrams how often it has them in training texts,
once for each distinct bigram, so a frequent word or pair is no burden; the bucket sums them for its table
and answers the chunk where the sum is another than the chunk's own. Words without a rank are asked for in the
same way. A chunk then has the counts, denominators and weights of all that its texts hold, and each token is
evaluated there: a seen bigram by its discounted probability, otherwise by the history's weight and, in turn, the
unigram. Words with a share of ``RANKED_SHARE`` of the training tokens or more (at most 1 / RANKED_SHARE
words, whatever the corpus) are known to every worker; this saves asking, and no result depends on it.

Words are known by 62 bits of a hash and bigrams by 64, so that two of a thousand million words are taken for
one with a probability of about one in ten, and far fewer than one in a million bigrams.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import discard, materialize, small_batches

RANKED_SHARE = 1e-6
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Characters of text for each bucket, and the least number of buckets.
BUCKET_CHARS, LEAST_BUCKETS = 16_000_000, 12
CHUNK_TOKENS, CACHE_WORDS = 2_000_000, 400_000
#: Words without a rank have this bit.
HASHED = 1 << 62
END_WORD = b" "  # no word holds a space
#: What a row is: part of a table, an answer to a chunk, or bigrams whose word has no rank.
TABLE, ANSWER, RARE = range(3)


def word_key(word: bytes) -> int:
    return (xxhash.xxh64_intdigest(word) >> 2) | HASHED


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END_WORD]


def _stirred(x: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One key for each bigram."""
    return _stirred(_stirred(v) ^ (w.view(np.uint64) * np.uint64(0x94D049BB133111EB)))


def _bucket(stirred: np.ndarray, buckets: int) -> np.ndarray:
    return ((stirred >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _packed(x: np.ndarray) -> bytes:
    """Eight-byte values, compressed with their first bytes together, then their second and so on."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(column: Iterable[bytes], kind=np.int64) -> np.ndarray:
    """The values of all rows of a packed column."""
    raw = [zstandard.ZstdDecompressor().decompress(b) for b in column]
    parts = [np.frombuffer(r, np.uint8).reshape(8, -1).T.copy().view(kind).reshape(-1) for r in raw if r]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _dealt(bucket: np.ndarray, **columns: np.ndarray) -> dict[str, list]:
    """One row for each bucket that has values: the bucket and its part of each column, packed."""
    sizes = np.bincount(bucket)
    order = np.argsort(bucket.astype(np.uint16) if len(sizes) <= 1 << 16 else bucket, kind="stable")
    full, ends = np.flatnonzero(sizes), np.cumsum(sizes)
    sorted_columns = {name: x[order] for name, x in columns.items()}
    return {"bucket": full.astype(np.int32), **{name: [_packed(x[ends[b] - sizes[b] : ends[b]]) for b in full] for name, x in sorted_columns.items()}}


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "chunk": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(name, pa.binary())) for name, x in rows.items()], names=list(rows))


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, values, size).astype(np.float64)  # bincount of nothing would be integers


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``wanted`` is in ``keys``, which are in order, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


WORDS = "bucket int, keys binary, counts binary"


def _word_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def dealt() -> pa.RecordBatch:
            keys = np.fromiter(map(word_key, held), np.int64, len(held))
            return _batch(_dealt(_bucket(_stirred(keys), buckets), keys=keys, counts=np.fromiter(held.values(), np.int64, len(held))))

        for batch in batches:
            for text in batch["text"]:
                held.update(tokens(text.as_py()))
                if len(held) > CACHE_WORDS:
                    yield dealt()
                    held = Counter()
        if held:
            yield dealt()

    return run


def _summed_words(frame: pd.DataFrame) -> pd.DataFrame:
    keys, at = np.unique(_unpacked(frame["keys"]), return_inverse=True)
    counts = np.bincount(at, _unpacked(frame["counts"])).astype(np.int64)
    return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "keys": [_packed(keys)], "counts": [_packed(counts)], "n": counts.sum(), "v": len(keys)})


def _at_least(least: float):
    """(keys, counts) of the words with ``least`` tokens or more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = _unpacked(frame["counts"])
            yield pd.DataFrame({"keys": _unpacked(frame["keys"])[counts >= least], "counts": counts[counts >= least]})

    return run


@dataclass
class Vocabulary:
    """Ranked words: keys[r - 1] and counts[r - 1] for rank r."""

    keys: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int

    @property
    def start(self) -> int:
        """The history before a text's first word."""
        return len(self.keys) + 1

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.distinct + 1))

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Probability of a word seen ``counts`` times, or of the unknown word."""
        return np.maximum(counts, 1) / (self.total + 1)


ENCODED = "chunk long, doc_ids binary, no_id binary, held binary, sizes binary, ids binary, rare binary"


class _Ranks(dict):
    """Rank, or key of a word without one, by word; emptied when full."""

    def __init__(self, keys: np.ndarray):
        self.of_key = dict(zip(keys.tolist(), range(1, len(keys) + 1), strict=True))

    def __missing__(self, word: bytes) -> int:
        key = word_key(word)
        self[word] = rank = self.of_key.get(key, key)
        return rank


def _encoded(shared):
    """One row for each chunk: its documents, the ranks of their words in turn, 0 for one without, and the keys of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, chunk, docs, held, size = _Ranks(shared.value.keys), TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            flat = np.concatenate([x for _, _, x in docs])
            some = [i is None for i, _, _ in docs]
            columns = {
                "doc_ids": np.array([i or 0 for i, _, _ in docs], np.int64), "no_id": np.array(some, np.int64), "held": np.array([h for _, h, _ in docs], np.int64),
                "sizes": np.array([len(x) for _, _, x in docs], np.int64), "ids": np.where(flat >= HASHED, 0, flat), "rare": flat[flat >= HASHED],
            }
            return _batch({"chunk": [chunk], **{n: [_packed(x)] for n, x in columns.items()}})

        for batch in batches:
            for doc_id, out, text in zip(batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), batch["text"], strict=True):
                words = tokens(text.as_py())
                if len(ranks) > CACHE_WORDS:
                    ranks.clear()
                docs.append((doc_id, bool(out), np.fromiter(map(ranks.__getitem__, words), np.int64, len(words))))
                size += len(words)
                if size >= CHUNK_TOKENS:
                    yield row()
                    chunk, docs, size = chunk + 1, [], 0
        if docs:
            yield row()

    return run


class _Chunk:
    """The tokens of a chunk: history, word, and whether they are of a training text."""

    def __init__(self, sizes: bytes, held: bytes, ids: bytes, rare: bytes, start: int):
        get = lambda packed: _unpacked([packed])
        self.sizes, self.held, self.word = get(sizes), get(held).astype(bool), get(ids)
        self.word[self.word == 0] = get(rare)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.history = np.concatenate([[start], self.word[:-1]])
        self.history[self.begins] = start
        self.key, self.first, self.at = np.unique(_pair(self.history, self.word), return_index=True, return_inverse=True)
        self.v, self.w = self.history[self.first], self.word[self.first]
        self.trained = np.bincount(self.at, np.repeat(~self.held, self.sizes), len(self.key)).astype(np.int64)


def _asked(start: int, buckets: int):
    """The distinct bigrams of each chunk, with their number in its training texts, dealt by bigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                chunk = _Chunk(x["sizes"], x["held"], x["ids"], x["rare"], start)
                order = np.lexsort((chunk.w, chunk.v))  # neighbours alike: they compress
                rows = _dealt(_bucket(chunk.key[order], buckets), v=chunk.v[order], w=chunk.w[order], counts=chunk.trained[order])
                yield _batch({"chunk": [x["chunk"]] * len(rows["bucket"]), **rows})

    return run


BIGRAMS = "kind int, chunk long, bucket int, v binary, w binary, counts binary, seen array<long>"


def _counted(frame: pd.DataFrame) -> pd.DataFrame:
    """A bucket's table of bigrams, with how many were seen once, twice and so on, and what each chunk doesn't know by itself."""
    v, w, own = ([_unpacked([b]) for b in frame[c]] for c in ("v", "w", "counts"))
    ends = np.cumsum([len(x) for x in v])
    v, w, own = map(np.concatenate, (v, w, own))
    _, first, at = np.unique(_pair(v, w), return_index=True, return_inverse=True)
    total = np.bincount(at, own, len(first)).astype(np.int64)
    first, seen = first[total > 0], total[total > 0]
    order = np.lexsort((w[first], v[first]))
    spread = np.bincount(seen[seen <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)
    rows = [(TABLE, None, _packed(v[first][order]), _packed(w[first][order]), _packed(seen[order]), spread)]
    for chunk, end, begin in zip(frame["chunk"], ends, [0, *ends[:-1]], strict=True):
        part = slice(begin, end)
        other = total[at[part]] != own[part]
        rows.append((ANSWER, chunk, _packed(v[part][other]), _packed(w[part][other]), _packed(total[at[part]][other]), None))
    out = pd.DataFrame(rows, columns=["kind", "chunk", "v", "w", "counts", "seen"])
    return out.assign(chunk=out["chunk"].astype("Int64"), bucket=frame["bucket"].iloc[0])


def discounts(seen: dict[int, int], most: int = DISCOUNTED) -> np.ndarray:
    """Katz' factors for counts 0..most from the numbers of bigrams seen once, twice and so on.

    A factor that the numbers leave undefined or outside (0, 1) is one half less than the count, over it.
    """
    factor = np.ones(most + 1)
    last = (most + 1) * seen.get(most + 1, 0) / seen[1] if seen.get(1) else 1.0
    for r in range(1, most + 1):
        again = (r + 1) * seen.get(r + 1, 0) / (r * seen[r]) if seen.get(r) else 0.0
        d = (again - last) / (1 - last) if last < 1 else 0.0
        factor[r] = d if 0 < d < 1 else (r - 0.5) / r
    return factor


def _discounted(factor: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return factor[np.where(counts < len(factor), counts, 0)] * counts


HISTORIES = "bucket int, v binary, n binary, left binary, low binary, kind int, w binary"


def _histories(shared, factor: np.ndarray, buckets: int):
    """Of a bucket's bigrams: by history the count, the discounted count and the unigram mass of the ranked words that
    followed, dealt by history; and the bigrams whose word has no rank, dealt by word."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: Vocabulary = shared.value
        mass = np.concatenate([[0.0], known.unigram(known.counts)])
        for frame in frames:
            for i in range(len(frame)):
                v, w, counts = (_unpacked(frame[c].iloc[i : i + 1]) for c in ("v", "w", "counts"))
                rare = w >= HASHED
                each, at = np.unique(v, return_inverse=True)
                values = {"n": counts, "left": _discounted(factor, counts), "low": mass[np.where(rare, 0, w)]}
                rows = _dealt(_bucket(_stirred(each), buckets), v=each, **{k: _sums(at, x, len(each)) for k, x in values.items()})
                yield pd.DataFrame(rows).assign(kind=TABLE, w=None)
                rows = _dealt(_bucket(_stirred(w[rare]), buckets), v=v[rare], w=w[rare])
                yield pd.DataFrame(rows).assign(n=None, left=None, low=None, kind=RARE)

    return run


def _rare_mass(shared, buckets: int):
    """Unigram mass by history of the words without a rank that followed it."""

    def run(requests: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        v, w = _unpacked(requests["v"]), _unpacked(requests["w"])
        at, there = _found(_unpacked(table["keys"]), w)
        low = shared.value.unigram(np.where(there, _unpacked(table["counts"])[at], 0) if len(table) else np.zeros(len(w), np.int64))
        each, place = np.unique(v, return_inverse=True)
        return pd.DataFrame(_dealt(_bucket(_stirred(each), buckets), v=each, low=_sums(place, low, len(each))))

    return run


WEIGHTS = "bucket int, keys binary, total binary, weight binary"


def backoff(n: np.ndarray, left: np.ndarray, low: np.ndarray, train_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and backoff weight of histories, so that the probabilities of each sum to one."""
    total = np.where(n - left <= 1e-9 * n, n + 1.0, n)  # nothing was discounted: one more count is left for what is new
    return total, (1 - left / total) / np.maximum(1 - low, 1 / (train_tokens + 1))


def _weights(train_tokens: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sums, only_low = frame[frame["n"].notna()], frame[frame["n"].isna()]
        keys, at = np.unique(np.concatenate([_unpacked(sums["v"]), _unpacked(only_low["v"])]), return_inverse=True)
        here = at[: len(at) - len(_unpacked(only_low["v"]))]
        n, left = (_sums(here, _unpacked(sums[c], np.float64), len(keys)) for c in ("n", "left"))
        low = _sums(at, np.concatenate([_unpacked(sums["low"], np.float64), _unpacked(only_low["low"], np.float64)]), len(keys))
        total, weight = backoff(n, left, low, train_tokens)
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "keys": [_packed(keys)], "total": [_packed(total)], "weight": [_packed(weight)]})

    return run


def _ranked_weights(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        keys = _unpacked(frame["keys"])
        ranked = keys < HASHED
        yield pd.DataFrame({"rank": keys[ranked], "total": _unpacked(frame["total"], np.float64)[ranked], "weight": _unpacked(frame["weight"], np.float64)[ranked]})


@dataclass
class KatzModel:
    """What every worker has: the discounts, and unigrams, denominators and weights by rank. The rest stays in its tables."""

    factor: np.ndarray
    counts: np.ndarray
    total: np.ndarray
    weight: np.ndarray


def _asked_words(buckets: int):
    """The distinct words without a rank of each chunk, dealt by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                keys = np.unique(_unpacked([x["rare"]]))
                rows = _dealt(_bucket(_stirred(keys), buckets), keys=keys)
                yield _batch({"chunk": [x["chunk"]] * len(rows["bucket"]), **rows})

    return run


ANSWERS = "chunk long, keys binary, counts binary, total binary, weight binary"


def _answered_words(requests: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
    """Count of each word that a chunk asked for, and its denominator and weight as a history."""
    words, histories = tables[tables["counts"].notna()], tables[tables["total"].notna()]
    keys, counts = _unpacked(words["keys"]), np.append(_unpacked(words["counts"]), 0)
    places, of = _unpacked(histories["keys"]), {n: np.append(_unpacked(histories[n], np.float64), 1.0) for n in ("total", "weight")}
    rows = []
    for chunk, packed in zip(requests["chunk"], requests["keys"], strict=True):
        wanted = _unpacked([packed])
        (at, there), (place, known) = _found(keys, wanted), _found(places, wanted)
        at, place = np.where(there, at, -1), np.where(known, place, -1)  # the last entries stand for what was never seen
        rows.append((chunk, packed, _packed(counts[at]), *[_packed(of[n][place]) for n in ("total", "weight")]))
    return pd.DataFrame(rows, columns=["chunk", "keys", "counts", "total", "weight"])


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(shared, model, start: int):
    """The scores of a chunk's texts from what it has been told."""

    def run(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        vocabulary, katz, x = shared.value, model.value, chunks.iloc[0]
        chunk = _Chunk(x["sizes"], x["held"], x["ids"], x["rare"], start)
        told = answers[answers["v"].notna()]
        key, told_counts = _pair(_unpacked(told["v"]), _unpacked(told["w"])), _unpacked(told["counts"])
        order = np.argsort(key)
        at, there = _found(key[order], chunk.key)
        counts = chunk.trained.copy()
        counts[there] = told_counts[order][at[there]]
        words = answers[answers["keys"].notna()]
        keys = _unpacked(words["keys"])
        order = np.argsort(keys)

        def of(who: np.ndarray, by_rank: np.ndarray, name: str) -> np.ndarray:
            rare, out = who >= HASHED, by_rank[np.where(who >= HASHED, 0, who)]
            out[rare] = _unpacked(words[name], out.dtype)[order][_found(keys[order], who[rare])[0]]
            return out

        total, weight, n = of(chunk.v, katz.total, "total"), of(chunk.v, katz.weight, "weight"), of(chunk.w, katz.counts, "counts")
        p = np.where(counts > 0, _discounted(katz.factor, counts) / total, weight * vocabulary.unigram(n))
        each = lambda values: np.add.reduceat(values[chunk.at], chunk.begins)
        doc_id = pd.Series(_unpacked([x["doc_ids"]]), dtype="Int64").mask(_unpacked([x["no_id"]]).astype(bool))
        return pd.DataFrame({"doc_id": doc_id, "held_out": chunk.held, "n_tokens": chunk.sizes, "n_known": each((n > 0).astype(np.int64)), "base_score": each(vocabulary.base(n)), "score": each(np.log10(p))})

    return run


def score(docs: DataFrame, held_out: Column, ranked_share: float = RANKED_SHARE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of ``docs``.

    The model learns from the rows that are not held out; score is its log10 probability of the text,
    base_score that of single words with one added to each count. A null text counts as empty, which
    has the end alone. Repeated rows are texts of their own. With nothing to learn from, every word is
    unknown and scores are 0. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(chars / BUCKET_CHARS))

    words = docs.where("NOT held_out").select("text").mapInArrow(_word_counts(buckets), WORDS)
    words = materialize(words.groupBy("bucket").applyInPandas(_summed_words, f"{WORDS}, n long, v long"), "words")
    sums = words.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total = sums["n"] or 0
    least = max(2, ranked_share * total)  # at most 1 / ranked_share words or bigrams are as frequent
    ranked = words.mapInPandas(_at_least(least), "keys long, counts long").toPandas().sort_values(["counts", "keys"], ascending=[False, True])
    vocabulary = Vocabulary(ranked["keys"].to_numpy(np.int64), ranked["counts"].to_numpy(np.int64), total, sums["v"] or 0)
    start, shared = vocabulary.start, spark.sparkContext.broadcast(vocabulary)
    encoded = materialize(docs.mapInArrow(_encoded(shared), ENCODED), "encoded")

    asked = encoded.select("chunk", "sizes", "held", "ids", "rare").mapInArrow(_asked(start, buckets), "chunk long, bucket int, v binary, w binary, counts binary")
    counted = materialize(asked.groupBy("bucket").applyInPandas(_counted, BIGRAMS), "bigrams")
    bigrams = counted.where(F.col("kind") == TABLE)
    seen = bigrams.select(F.posexplode("seen").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n"))
    factor = discounts({x["r"]: x["n"] for x in seen.collect()})  # seven rows

    of_bigrams = materialize(bigrams.select("bucket", "v", "w", "counts").mapInPandas(_histories(shared, factor, buckets), HISTORIES), "histories")
    rare_mass = of_bigrams.where(F.col("kind") == RARE).select("bucket", "v", "w").groupBy("bucket").cogroup(words.groupBy("bucket"))
    rare_mass = rare_mass.applyInPandas(_rare_mass(shared, buckets), "bucket int, v binary, low binary")
    parts = of_bigrams.where(F.col("kind") == TABLE).select("bucket", "v", "n", "left", "low").unionByName(rare_mass, allowMissingColumns=True)
    weights = materialize(parts.groupBy("bucket").applyInPandas(_weights(total), WEIGHTS), "weights")
    discard(of_bigrams)
    by_rank = weights.mapInPandas(_ranked_weights, "rank long, total double, weight double").toPandas()  # one row for each ranked history
    totals, weight = np.ones(start + 1), np.ones(start + 1)
    totals[by_rank["rank"]], weight[by_rank["rank"]] = by_rank["total"], by_rank["weight"]
    model = spark.sparkContext.broadcast(KatzModel(factor, np.concatenate([[0], vocabulary.counts, [0]]), totals, weight))

    tables = words.select("bucket", "keys", "counts").unionByName(weights, allowMissingColumns=True)
    of_words = encoded.select("chunk", "rare").mapInArrow(_asked_words(buckets), "chunk long, bucket int, keys binary")
    of_words = materialize(of_words.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInPandas(_answered_words, ANSWERS), "answers")
    discard(words, weights)
    answers = counted.where(F.col("kind") == ANSWER).select("chunk", "v", "w", "counts").unionByName(of_words, allowMissingColumns=True)
    scored = encoded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_scored(shared, model, start), SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
