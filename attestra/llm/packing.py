"""Harmonic packing of token sequences into bins of a fixed capacity.

Class j holds pieces of at most capacity // j tokens, and a bin of class j holds exactly j of them. A
document's full capacities are pieces of class 1; of what is left, a piece that fills its slot well
stays whole, and otherwise the largest exact slot is cut off and the rest is looked at again, so a
piece soon meets its slot. Pieces get their place in a class from counts by partition and class, so
workers fill bins independently and only counts meet. The last, incomplete bin of each class (at
most j - 1 pieces, a number that depends on the classes alone) goes to one best-fit packing.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.llm.common import materialize, small_batches

CAPACITY = 4096
END_ID = 2
#: A piece of this share of its slot or more is not cut.
FILL = 63 / 64
#: Pieces of so many tokens or fewer are not cut.
LEAST_PIECE = 32
CACHE_WORDS = 400_000


def classes(capacity: int = CAPACITY) -> list[int]:
    """1 to 64, then powers of two."""
    return [j for j in range(1, min(64, capacity) + 1)] + [j for j in (1 << k for k in range(7, capacity.bit_length())) if j <= capacity]


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, class) of a document's pieces."""
    kinds = classes(capacity)
    slots = [capacity // j for j in kinds]
    full = length // capacity
    pieces, at, left = [(i * capacity, capacity, 1) for i in range(full)], full * capacity, length % capacity
    while left:
        k = max(i for i, s in enumerate(slots) if s >= left)
        if left <= LEAST_PIECE or left >= FILL * slots[k] or k + 1 == len(kinds):
            pieces.append((at, left, kinds[k]))
            break
        pieces.append((at, slots[k + 1], kinds[k + 1]))
        at, left = at + slots[k + 1], left - slots[k + 1]
    return pieces


#: A word of small letters of plain Latin text, as UTF-8, which the tokenizer takes as it is.
WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Punctuation after a Latin letter, small or large; without the apostrophe, which the tokenizer joins with some letters.
MARK = re.compile(rb"[.,;:!?*#$%&()-](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
#: Byte-level tokenizers show a byte as the character of its number if that is printable, and the others from 256 on.
SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: What a tokenizer file has to say for its texts to be encoded in parts.
BY_PARTS = {
    "normalizer": ["NFC", {"Regex": r"\s+"}, " ", "Lowercase"],
    "pre_tokenizer": [{"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "Removed", True, "ByteLevel", False, False],
}


def encodes_by_parts(said: dict) -> bool:
    """Whether a tokenizer file lower-cases, drops white space, keeps letters apart from what follows them and works on bytes."""
    try:
        (nfc, spaces, lower), (split, level), model = said["normalizer"]["normalizers"], said["pre_tokenizer"]["pretokenizers"], said["model"]
        normal = [nfc["type"], spaces["pattern"], spaces["content"], lower["type"]]
        before = [split["pattern"], split["behavior"], split["invert"], level["type"], level["add_prefix_space"], level["use_regex"]]
        plain = model["type"] == "BPE" and not (model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"] or said["post_processor"])
        return {"normalizer": normal, "pre_tokenizer": before} == BY_PARTS and plain and all(t["content"].startswith("<|") for t in said["added_tokens"])
    except (KeyError, TypeError, ValueError):
        return False


class PartIds(dict):
    """Ids of parts of texts as little-endian 32-bit bytes; a part is encoded when it is first met."""

    def __init__(self, tokenizer):
        self.whole, self.model = tokenizer.encode, tokenizer.model

    def __missing__(self, part: bytes) -> bytes:
        if WORD.fullmatch(part):
            ids = [t.id for t in self.model.tokenize(part.decode("latin-1").translate(SHOWN))]
        else:
            ids = self.whole(part.decode("utf-8"), add_special_tokens=False).ids
        self[part] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class CachedEncoder:
    """Ids of texts as little-endian 32-bit bytes.

    If the file says that nothing is joined across white space, nor letters with the punctuation after
    them, the ids of a text are those of its parts in order, and a part is encoded once. Other
    tokenizers, and texts with a control string's opening, take whole texts. The cache is emptied when
    it holds ``CACHE_WORDS`` parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        source = Path(path).read_text("utf-8")
        self.tokenizer, self.by_parts = Tokenizer.from_str(source), encodes_by_parts(json.loads(source))
        self.ids = PartIds(self.tokenizer)

    def encode(self, text: str) -> bytes:
        if not self.by_parts or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
        return b"".join(map(self.ids.__getitem__, MARK.sub(rb" \g<0>", text.encode("utf-8").lower()).split()))


@lru_cache(maxsize=2)
def encoder_of(path: str) -> CachedEncoder:
    """One encoder for each worker, whose cache serves all its tasks."""
    return CachedEncoder(path)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, place long"


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part, places = encoder_of(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), Counter()
        cuts: dict[int, list] = {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                if n not in cuts and len(cuts) < 20_000:
                    cuts[n] = cut(n, capacity)
                for start, length, kind in cuts[n] if n in cuts else cut(n, capacity):
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, kind, part, places[kind]))
                    places[kind] += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "place"]
            types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names=names)

    return run


def _best_fit(capacity: int, first: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True]).reset_index(drop=True)
        room, where, offset = np.zeros(0, np.int64), [], []
        for length in frame["length"]:
            fits = np.flatnonzero(room >= length)
            if len(fits):
                k = fits[room[fits].argmin()]
            else:
                k, room = len(room), np.append(room, capacity)
            where.append(first + k)
            offset.append(capacity - room[k])
            room[k] -= length
        return frame.assign(sequence_id=np.array(where, np.int64), offset=np.array(offset, np.int64))[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has the end id alone. Repeated rows are documents of their own. An empty
    table gives no rows. Columns other than doc_id and text are not read.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(read.mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECES), "pieces")
    counts = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n"))
    totals = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # one row for each class
    bases, first = [], 0
    for kind in sorted(totals):
        full = totals[kind] // kind
        bases.append((kind, first, full * kind))
        first += full
    of_class = docs.sparkSession.createDataFrame(bases, "class int, base long, whole long")
    placed = pieces.join(before.select("class", "part", "before"), ["class", "part"]).withColumn("place", F.col("place") + F.col("before"))
    placed = placed.join(F.broadcast(of_class), "class")  # at most one row for each class
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = placed.where("place < whole").withColumn("sequence_id", F.expr("base + place div class"))
    in_order = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("offset", F.sum("length").over(in_order) - F.col("length")).select(*out)
    rest = placed.where("place >= whole").select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    rest = rest.groupBy().applyInPandas(_best_fit(capacity, first), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(rest)
