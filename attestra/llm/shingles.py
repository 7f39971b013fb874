"""Near-duplicate texts: candidates by covering tables of SimHash fingerprints, links by exact similarity of five-word shingles.

``PRINTS`` fingerprints of a text's distinct words go to the tables of radius ``RADIUS``. Two texts
whose sets of five-word shingles have a Jaccard similarity of 0.8 or more share most words, so that
their fingerprints are within the radius, or agree on a table beyond it, in at least one case out of the
``PRINTS`` with a probability of over 99 %. A candidate is confirmed on the whole sets before it links, so no text goes for
another that is less alike. Texts of equal word sequences are one node.

A member of larger buckets is first compared with the smallest member that it meets, then with the one that
has most links. After that only members that are not connected yet are compared: as pairs in small buckets, in blocks inside tasks in large ones, which
return at most one link for each member. So a group of copies costs little more than its members.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import materialize, small_batches
from attestra.llm.components import connected_components
from attestra.llm.covering import apart, covering_masks, majority, mixed, table_keys

WORDS = 5
#: Similarity of 4 / 5 or more.
LEAST = (4, 5)
#: Fingerprints of a text, the radius of their tables, and the bits of all of them in which candidates may differ: texts of similarity 0.8 differ in 40 or so.
PRINTS, RADIUS, CLOSE = 6, 3, 80
NAMES = [f"fp{k}" for k in range(PRINTS)]
#: Members of a small bucket, and of a block of a large one.
SMALL_BUCKET, BLOCK = 16, 256
SEED = 42


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the text's shingles, each once, in order. A text of fewer words is one shingle; one without words has none."""
    found = _words(text)
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(found) - words + 1, 1)
    stops = (ends[words - 1 :] if len(found) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[:last].tolist(), stops, strict=True)), np.uint64, last))


def word_prints(words: list[bytes]) -> list[np.uint64]:
    """Fingerprints of the distinct words; zeros without any."""
    distinct = set(words)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in distinct), np.uint64, len(distinct))
    return [majority(mixed(hashes, c)) if len(hashes) else np.uint64(0) for c in range(PRINTS)]


def _node(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED)


def _longs(values: list) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _marks(batches):
    for batch in batches:
        texts = [_words(t.as_py()) for t in batch["text"]]
        prints = np.array([word_prints(w) for w in texts], np.uint64).reshape(-1, PRINTS)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["__text"], _longs([_node(w) for w in texts]), *map(_longs, prints.T)], names=["doc_id", "__text", "node", *NAMES])


def _sets(batches):
    for batch in batches:
        texts = [t.as_py() for t in batch["text"]]
        sets = [shingle_set(t) for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _longs(np.concatenate([*sets, np.zeros(0, np.uint64)])))
        yield pa.RecordBatch.from_arrays([_longs([_node(_words(t)) for t in texts]), lists], names=["node", "shingles"])


def marks_of(docs: DataFrame) -> DataFrame:
    """(doc_id, __text, node, fingerprints): the text's hash, its words' hash and fingerprints, for each row."""
    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("__text"), "text")
    return read.mapInArrow(_marks, f"doc_id long, __text long, node long, {', '.join(f'{n} long' for n in NAMES)}")


def _enough(common: Column, a: Column, b: Column) -> Column:
    """Whether two sets of sizes a and b with ``common`` members are alike enough, in whole numbers."""
    over, under = LEAST
    return common * (over + under) >= (a + b) * over


def _pairs(close: np.ndarray, i: int, j: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of close pairs with one side in block i and the other in block j."""
    a, b = np.nonzero(close & ((block == i)[:, None] & (block == j)[None, :]))
    apart_rows = a < b if i == j else a != b
    return a[apart_rows], b[apart_rows]


def _candidates(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block whose components differ, whose fingerprints are close, and that no table before this one holds."""
    prints, root = frame[NAMES].to_numpy().view(np.uint64), frame["root"].to_numpy()
    bits = sum(np.bitwise_count(prints[:, None, k] ^ prints[None, :, k]).astype(np.int32) for k in range(PRINTS))
    a, b = _pairs((bits <= CLOSE) & (root[:, None] != root[None, :]), frame["i"].iloc[0], frame["j"].iloc[0], frame["block"].to_numpy())
    masks = np.array(covering_masks(RADIUS), np.uint64)
    shared = ((prints[a] ^ prints[b])[:, :, None] & masks[None, None, :]) == 0
    first = shared.reshape(len(a), PRINTS * len(masks)).argmax(axis=1) == frame["t"].iloc[0]
    return a[first], b[first]


def _with_partner(frame: pd.DataFrame) -> pd.DataFrame:
    """The members of a block that are in a candidate pair."""
    return frame.iloc[np.unique(np.concatenate(_candidates(frame)))]


def _block_links(frame: pd.DataFrame) -> pd.DataFrame:
    """Confirmed links of a block, one for each member at most: to the smallest node that it reaches there."""
    frame = frame.sort_values("node").reset_index(drop=True)
    sets, (over, under), root = frame["shingles"].to_list(), LEAST, np.arange(len(frame))

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(*_candidates(frame), strict=True):
        x, y = top(a), top(b)
        if x != y and len(np.intersect1d(sets[a], sets[b], assume_unique=True)) * (over + under) >= (len(sets[a]) + len(sets[b])) * over:
            root[max(x, y)] = min(x, y)
    nodes, tops = frame["node"].to_numpy(), np.array([top(x) for x in range(len(frame))], np.int64)
    moved = tops != np.arange(len(frame))
    return pd.DataFrame({"a": nodes[moved], "b": nodes[tops[moved]]})


def linked_sets(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(id, component) of the nodes that links reach; ``distinct`` has node, first (a row of it) and fingerprints."""
    keys = distinct.select("node", F.posexplode(table_keys(NAMES, RADIUS)).alias("t", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low")).where("n > 1")
    members = materialize(keys.join(shared, "key"), "members")
    marks = distinct.select("node", *NAMES)

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = nodes.distinct().join(distinct.select("node", F.col("first.doc_id").alias("__id"), F.col("first.__text").alias("__hash")), "node").drop("node")
        at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__text"), "text")
        read = at.join(wanted, at["doc_id"].eqNullSafe(wanted["__id"]) & (at["__text"] == wanted["__hash"]), "left_semi").select("text")
        return materialize(read.mapInArrow(_sets, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose fingerprints are close."""
        side = lambda s: marks.select(F.col("node").alias(s), *[F.col(n).alias(f"{s}_{n}") for n in NAMES])
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.where(apart([f"a_{n}" for n in NAMES], [f"b_{n}" for n in NAMES]) <= CLOSE).select("a", "b")

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"{s}_set"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        common = F.size(F.array_intersect("a_set", "b_set")).cast("long")
        return both.where(_enough(common, F.size("a_set"), F.size("b_set"))).select("a", "b")

    ends = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))

    def links_of(pairs: DataFrame) -> DataFrame:
        near = materialize(close(pairs.distinct()), "near")
        return materialize(confirmed(near, sets_of(ends(near))), "edges")

    def rooted(placed: DataFrame, edges: DataFrame) -> DataFrame:
        """The rows with their nodes' components as root and numbers of links."""
        degree = ends(edges).groupBy("node").agg(F.count("*").alias("links"))
        state = connected_components(edges).withColumnRenamed("id", "node").join(degree, "node")
        found = placed.join(state, "node", "left").withColumns({"root": F.coalesce("component", "node"), "links": F.coalesce("links", F.lit(0))})
        return materialize(found.drop("component"), "rooted")

    twos = members.where("n = 2 AND node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    others = members.where("n > 2").groupBy(F.col("node").alias("a")).agg(F.min("low").alias("b")).where("a <> b")
    edges = links_of(twos.unionByName(others))
    placed = rooted(members.where("n > 2").select("key", "t", "n", "node"), edges)
    centre = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max(F.struct("links", "node", "root")).alias("c"))
    rest = materialize(placed.join(centre.where("x < y").select("key", "c"), "key"), "open")  # the buckets whose members are in several components
    best = rest.where("root <> c.root").groupBy(F.col("node").alias("a")).agg(F.max("c").alias("c"))
    edges = edges.unionByName(links_of(best.select("a", F.col("c.node").alias("b"))))
    places = rest.groupBy("node").agg(F.collect_list(F.struct("key", "t", "n")).alias("places"))  # one for each table at most
    places = rooted(places, edges).join(marks, "node").select("node", "root", *NAMES, F.explode("places").alias("p"))
    rest = materialize(places.select("p.*", "node", "root", *NAMES), "places")
    few, many = rest.where(F.col("n") <= SMALL_BUCKET), rest.where(F.col("n") > SMALL_BUCKET)
    side = lambda s: few.select("key", F.col("node").alias(s), F.col("root").alias(f"{s}_root"), *[F.col(n).alias(f"{s}_{n}") for n in NAMES])
    pairs = side("a").join(side("b"), "key").where("a > b AND a_root <> b_root").where(apart([f"a_{n}" for n in NAMES], [f"b_{n}" for n in NAMES]) <= CLOSE)
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    still = many.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y")
    many = many.join(still, "key", "left_semi")  # else blocks of a closed bucket would be dealt out for nothing
    many = many.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "t", "node", "root", "block", *NAMES)
    many = materialize(many.groupBy("key", "i", "j").applyInPandas(_with_partner, many.schema), "blocks")

    sets = sets_of(ends(pairs).unionByName(many.select("node")))
    found = many.join(sets, "node").groupBy("key", "i", "j").applyInPandas(_block_links, "a long, b long")
    return connected_components(edges.unionByName(confirmed(pairs, sets)).unionByName(found))
