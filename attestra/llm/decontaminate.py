"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

The automaton of all items is built on each worker from the items' words, training texts stream
through it word by word, and the longest match that ends at each word gives the hit words. The items
are a side table; ``MAX_WORDS`` bounds what one automaton, and the driver, holds at a time. A larger
benchmark is dealt into shards by hash; the texts are still read once, and each batch of them goes
through the automata in turn.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import small_batches

WINDOW = 10
MAX_WORDS = 200_000
MAX_COVERAGE = 0.5

#: Lower-cases A-Z and turns every byte that no word holds into a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD_CHARS = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences; knows the items of every window."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.items: list[set] = []
        sequences = []
        for name, words in items:
            if words:
                sequences.append((name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        for _, ids in sequences:
            last = 0
            for x in ids:
                last = self._extend(last, x)
        self.shortest = min([window, *(len(ids) for _, ids in sequences)])
        self._mark(sequences)

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, origin: int, x: int) -> int:
        """The state that ``origin`` reaches by x, cut so that its length is one more than origin's."""
        target = self.next[origin][x]
        if self.length[target] == self.length[origin] + 1:
            return target
        copy = self._state(self.length[origin] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while origin >= 0 and self.next[origin].get(x) == target:
            self.next[origin][x] = copy
            origin = self.link[origin]
        return copy

    def _extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            return self._split(last, x)
        new, origin = self._state(self.length[last] + 1, 0, {}), last
        while origin >= 0 and x not in self.next[origin]:
            self.next[origin][x] = new
            origin = self.link[origin]
        if origin >= 0:
            self.link[new] = self._split(origin, x)
        return new

    def _mark(self, sequences: list) -> None:
        """Which items hold the window of each state, and which short items end at it."""
        n = len(self.length)
        self.items = [set() for _ in range(n)]
        self.short: list[list[tuple[int, str | None]]] = [[] for _ in range(n)]
        self.whole = list(range(n))
        for name, ids in sequences:
            state = 0
            for x in ids:
                state = self.next[state][x]
                if len(ids) >= self.window:
                    up = state
                    while up > 0 and self.length[up] >= self.window and name not in self.items[up]:
                        self.items[up].add(name)
                        up = self.link[up]
            if len(ids) < self.window:
                self.short[state].append((len(ids), name))
        order = sorted(range(1, n), key=self.length.__getitem__)
        for s in order:
            up = self.link[s]
            if self.length[up] >= self.window:
                self.whole[s] = self.whole[up]
            if up > 0 and self.short[up]:
                self.short[s] = self.short[s] + self.short[up]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words, [begin, end) in order and apart from each other, and the items found."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        spans: list[tuple[int, int]] = []
        found: set = set()
        for begin, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - begin >= self.shortest:
                self._run(ids[begin:end].tolist(), begin, spans, found)
        return spans, found

    def _run(self, ids: list[int], begin: int, spans: list, found: set) -> None:
        moves, link, length, state, matched = self.next, self.link, self.length, 0, 0
        for i, x in enumerate(ids, begin + 1):
            while state and x not in moves[state]:
                state = link[state]
                matched = length[state]
            if x in moves[state]:
                state, matched = moves[state][x], matched + 1
            reach = 0
            if matched >= self.window:
                reach = matched
                found |= self.items[self.whole[state]]
            for size, name in self.short[state]:
                if size <= matched:
                    reach = max(reach, size)
                    found.add(name)
            if reach:
                first = i - reach
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i))


class Shard:
    """Some of the items, broadcast; its automaton is built once for a worker."""

    def __init__(self, key: str, items):
        self.key, self.items = key, items

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Shard) and self.key == other.key

    def __hash__(self) -> int:
        return hash(self.key)


@lru_cache(maxsize=1)
def automaton_of(shard: Shard, window: int) -> ItemAutomaton:
    return ItemAutomaton(((name, words_of(text)) for name, text in shard.items.value), window)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and out[-1][1] >= begin:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def _found(texts: list[str | None], shards: list[Shard], window: int) -> list[tuple[int, list[tuple[int, int]], set]]:
    """Number of words, hit spans and items of each text; all texts meet one automaton after the other."""
    words = [words_of(t) for t in texts]
    spans, items = [[] for _ in texts], [set() for _ in texts]
    for shard in shards:
        automaton = automaton_of(shard, window)
        for k, found in enumerate(map(automaton.hits, words)):
            spans[k] += found[0]
            items[k] |= found[1]
    return [(len(w), merged(s) if len(shards) > 1 else s, i) for w, s, i in zip(words, spans, items, strict=True)]


def shards_of(benchmark: DataFrame, max_words: int = MAX_WORDS) -> list[Shard]:
    """The items in broadcast shards of about ``max_words`` words, read one after the other; one letter counts as a word at least."""
    spark = benchmark.sparkSession
    small_batches(spark)
    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    words = texts.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\u0080-\U0010ffff]+")))).first()[0] or 0
    n, key = max(1, math.ceil(words / max_words)), uuid.uuid4().hex
    part = lambda k: texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
    return [Shard(f"{key}-{k}", spark.sparkContext.broadcast([tuple(r) for r in part(k).collect()])) for k in range(n)]


#: What ``scan`` adds to the documents.
FOUND = T.StructType([T.StructField("__n_words", T.LongType()), T.StructField("__spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("__items", T.ArrayType(T.StringType()))])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with __n_words, __spans ([begin, end) of hit words) and __items (ids found, as strings), in one scan.

    A null text has no words. Items without words are never found; one without an id hits words but
    is not listed. Rows are never dropped; repeated rows are scanned alike. Columns of ``docs`` of the
    added names give way to them.
    """
    shards = shards_of(benchmark, max_words)
    docs = docs.drop(*FOUND.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, items = zip(*found, strict=True) if (found := _found(batch["text"].to_pylist(), shards, window)) else ((), (), ())
            more = [pa.array(counts, pa.int64()), pa.array([[list(x) for x in s] for s in spans], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x for x in i if x is not None) for i in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *FOUND.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema, *FOUND]))


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])


def _cut(text: str, spans: list[list[int]]) -> str:
    at = [m.span() for m in WORD_CHARS.finditer(text)]
    left, begin = [], 0
    for first, last in spans:
        left.append(text[begin : at[first][0]])
        begin = at[last - 1][1]
    return "".join([*left, text[begin:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` without what the items' windows hit: hit spans are cut out of the texts.

    A text of which more than ``max_coverage`` of the words are hit goes as a whole. Texts without a
    hit and null texts stay as they are; n_chars, where there, follows a text that was cut. Other
    columns of any name stay.
    """
    shards = shards_of(benchmark, max_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = [(n, s) for n, s, _ in _found(texts, shards, window)]
            cut = {k: _cut(texts[k], s) for k, (_, s) in enumerate(found) if s}
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            if cut:
                columns["text"] = pa.array([cut.get(k, t) for k, t in enumerate(texts)], batch["text"].type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(cut[k]) if k in cut else n for k, n in enumerate(batch["n_chars"].to_pylist())], batch["n_chars"].type)
            few = pa.array([sum(b - a for a, b in s) <= max_coverage * n for n, s in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(few)

    return docs.mapInArrow(run, docs.schema)
