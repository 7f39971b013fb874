"""SimHash near-duplicates found by covering locality-sensitive hashing.

Each text gets one 64-bit fingerprint. Fingerprints that differ in r bits or fewer agree on everything
that at least one table of a covering mask keeps: no pair within the radius is missed.

Equal fingerprints are merged before the search. Small buckets compare their pairs. In a large bucket
every member names itself and its one-bit neighbours among the positions that the table drops: two
members within two bits share such a name, and at most 65 members share one, so the work stays in
proportion to the members whatever the size of a group of copies.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import materialize, set_aside, small_batches
from attestra.llm.components import connected_components
from attestra.llm.covering import apart, covering_masks, longs, mixed, table_keys
from attestra.llm.shingles import NAMES, linked_sets, marks_of

SHINGLE = 3
SEED = 42
RADIUS = 2
SMALL_BUCKET = 48
#: Where buckets give star edges, only those of up to this many members give pairs, so that links stay in proportion to members.
PAIR_BUCKET = 4
BLOCK = 2048
CHUNK = 200_000


def fingerprints_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED, chunks: int = 1) -> np.ndarray:
    """``chunks`` unsigned fingerprints of one text, which make one of 64 bits each: bit i is 1 if over half of the shingle hashes have it.

    The first is of the hashes themselves, the others of the hashes mixed with a number of their own.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(chunks, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - shingle + 1, 1)
    firsts, stops = starts[:last].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros((chunks, 64), np.int64)
    for at in range(0, last, CHUNK):
        part = slice(at, at + CHUNK)
        hashes = np.fromiter((digest(joined[i:j], seed) for i, j in zip(firsts[part], stops[part], strict=True)), np.uint64, min(CHUNK, last - at))
        for c in range(chunks):
            stirred = mixed(hashes, c) if c else hashes
            ones[c] += np.unpackbits(stirred.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > last, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text."""
    return int(fingerprints_of(text, shingle, seed)[0])


def _fingerprints(shingle: int, seed: int, names: list[str]):
    def run(batches):
        for batch in batches:
            marks = np.array([fingerprints_of(t.as_py(), shingle, seed, len(names)) for t in batch["text"]], np.uint64).reshape(-1, len(names))
            kept = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*[batch[name] for name in kept], *[pa.array(column.copy().view(np.int64)) for column in marks.T]], names=[*kept, *names])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, more: Sequence[Column] = (), names: Sequence[str] = ("fp",)) -> DataFrame:
    """(doc_id, *more, *names): one row for each row of ``docs``; each name is a fingerprint's 64 bits as a long.

    A null text or one without words has fingerprint zero. Repeated rows give repeated rows.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long"), *more, "text")
    return read.mapInArrow(_fingerprints(shingle, seed, list(names)), T.StructType([*read.drop("text").schema, *[T.StructField(name, T.LongType()) for name in names]]))


def _block_links(chunks: list[str], limit: int):
    """Star edges of the links between two blocks of a bucket; each node's to the smallest node it reaches there."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node").reset_index(drop=True)
        nodes, block, marks = frame["node"].to_numpy(), frame["block"].to_numpy(), frame[chunks].to_numpy().view(np.uint64)
        left, right = np.flatnonzero(block == frame["i"].iloc[0]), np.flatnonzero(block == frame["j"].iloc[0])
        root = np.arange(len(nodes))
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            bits = sum(np.bitwise_count(marks[some, None, c] ^ marks[None, right, c]).astype(np.int16) for c in range(len(chunks)))
            a, b = np.nonzero(bits <= limit)
            a, b = some[a], right[b]
            while (split := root[a] != root[b]).any():
                a, b = a[split], b[split]
                np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
                while (root != root[root]).any():
                    root = root[root]
        moved = root != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[moved], "b": nodes[root[moved]]})

    return run


def linked_nodes(distinct: DataFrame, chunks: Sequence[str], radius: int, limit: int, small_bucket: int = PAIR_BUCKET, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between ``node`` ids whose ``chunks`` differ in ``limit`` bits or fewer in all, found within ``radius`` bits of one chunk.

    Buckets of up to ``small_bucket`` members give every such pair. Others are compared in blocks of about
    ``block`` members, whose tasks return star edges: one for each member at most. The components are the same either way.
    """
    chunks = list(chunks)
    keys = distinct.select("node", F.explode(table_keys(chunks, radius)).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keys.join(shared, "key").join(distinct.select("node", *chunks), "node"), "buckets")
    few, many = members.where(F.col("n") <= small_bucket), members.where(F.col("n") > small_bucket)
    side = lambda s: few.select("key", F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in chunks])
    near = side("a").join(side("b"), "key").where("a > b").where(apart([f"a_{c}" for c in chunks], [f"b_{c}" for c in chunks]) <= limit).select("a", "b")
    many = many.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("key", "node", *chunks, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return near.unionByName(many.groupBy("key", "i", "j").applyInPandas(_block_links(chunks, limit), "a long, b long"))


def linked_fingerprints(distinct: DataFrame, radius: int = RADIUS, small_bucket: int = SMALL_BUCKET, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the distinct ``fp`` values: their components are those of all pairs within ``radius``.

    Small buckets give every pair within the radius. Large ones give, for radius 2, links through
    shared one-bit neighbours; see ``linked_nodes`` for other radii. The components are the same either way.
    """
    if radius != 2:
        return linked_nodes(distinct.select(F.col("fp").alias("node"), "fp"), ["fp"], radius, radius, small_bucket, block)
    masks = covering_masks(radius)
    keys = distinct.select("fp", F.posexplode(F.transform(longs(masks), lambda m: F.col("fp").bitwiseAND(m))).alias("t", "key"))
    shared = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keys.join(shared, ["t", "key"]), "buckets")
    few, many = members.where(F.col("n") <= small_bucket), members.where(F.col("n") > small_bucket)
    left, right = few.select("t", "key", F.col("fp").alias("a")), few.select("t", "key", F.col("fp").alias("b"))
    near = left.join(right, ["t", "key"]).where("a > b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    flips = F.array(*[longs([0] + [1 << i for i in range(64) if not m >> i & 1]) for m in masks])
    names = many.select("t", "fp", F.explode(F.transform(F.get(flips, F.col("t")), lambda f: F.col("fp").bitwiseXOR(f))).alias("name"))
    met = names.groupBy("t", "name").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return near.unionByName(met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of ``docs``.

    component_id is the smallest doc_id of the texts that links of at most ``radius`` bits reach, the
    row's own included (null ids count only where no other id is there). An empty table gives no
    rows; other columns of ``docs`` are not read.
    """
    marks = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(linked_fingerprints(distinct.select("fp"), radius, small_bucket))
    of_fp = distinct.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    lowest = of_fp.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = of_fp.join(lowest, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the first by doc_id, then by text.

    Columns stay as they are. A row without an id comes after those with one. Of repeated rows that
    agree in id and text one stays. Texts link if their sets of five-word shingles have a similarity
    of 0.8 or more; see ``shingles``.
    """
    docs, back = set_aside(docs, ("__id", "__text"))
    key = {"__id": F.col("doc_id").cast("long"), "__text": F.xxhash64("text")}
    marks = materialize(marks_of(docs), "marks")
    firsts = marks.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__text")).alias("first"), *[F.any_value(n).alias(n) for n in NAMES])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = materialize(firsts.repartition(parts, "node"), "distinct")  # few bytes that become many rows: not in few tasks
    roots = linked_sets(docs, distinct)
    of_fp = distinct.join(roots.withColumnRenamed("id", "node"), "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first"))
    keep = of_fp.select(F.col("first.doc_id").alias("__id"), F.col("first.__text").alias("__text"))
    copies = marks.groupBy(F.col("doc_id").alias("__id"), "__text").agg(F.count("*").alias("n"))
    same = [copies["__id"].eqNullSafe(keep["__id"]), copies["__text"] == keep["__text"]]
    keep = materialize(keep.join(copies, same).select(copies["__id"], copies["__text"], "n"), "keep")

    def rows(wanted: DataFrame) -> DataFrame:
        at = docs.withColumns(key)
        return at.join(wanted, at["__id"].eqNullSafe(wanted["__id"]) & (at["__text"] == wanted["__text"]), "left_semi")

    kept, repeated = rows(keep.where("n = 1")), keep.where("n > 1")
    if not repeated.isEmpty():  # texts are moved a second time only where rows agree in id and text
        kept = kept.unionByName(rows(repeated).dropDuplicates(["__id", "__text"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).withColumnsRenamed(back)
