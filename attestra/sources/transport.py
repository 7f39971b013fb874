"""Reader of version 5 transport files: 80-byte cards, 140-byte variable descriptors, hexadecimal floats.

The driver reads the headers; rows are decoded in tasks, member by member, with array operations.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.model import ORD, Dataset, Variable

# Fixed values of the format.
CARD, DESCRIPTOR = 80, 140
LIBRARY = b"HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!"
MEMBER = b"HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!"
NAMES = b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!"
ROWS = b"HEADER RECORD*******OBS     HEADER RECORD!!!!!!!"
MISSING = b"._ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHUNK_ROWS = 50_000


class TransportError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    name: str
    label: str
    numeric: bool
    length: int
    offset: int


@dataclass(frozen=True)
class Member:
    name: str
    label: str
    fields: tuple[Field, ...]
    begin: int
    end: int

    @property
    def width(self) -> int:
        return sum(f.length for f in self.fields)


def _text(raw: bytes) -> str:
    return raw.decode("latin-1").rstrip(" \0")


def members(data: bytes) -> list[Member]:
    """The members of a file and where their rows lie."""
    if not data.startswith(LIBRARY):
        raise TransportError("not a version 5 transport file")
    starts = [i for i in range(3 * CARD, len(data) - CARD + 1, CARD) if data.startswith(MEMBER, i)]
    out = []
    for k, at in enumerate(starts):
        stop = starts[k + 1] if k + 1 < len(starts) else len(data)
        size = int(data[at + 74 : at + 78].strip() or DESCRIPTOR)
        name_card = at + 2 * CARD
        title, label = _text(data[name_card + 8 : name_card + 16]), _text(data[name_card + CARD + 32 : name_card + CARD + 72])
        head = name_card + 2 * CARD
        if not data.startswith(NAMES, head):
            raise TransportError("variable descriptors are missing")
        count = int(data[head + 54 : head + 58])
        fields = []
        for i in range(count):
            d = data[head + CARD + i * size : head + CARD + (i + 1) * size]
            if len(d) < 88:
                raise TransportError("a variable descriptor is cut off")
            kind, _, length = struct.unpack(">hhh", d[:6])
            fields.append(Field(_text(d[8:16]), _text(d[16:56]), kind == 1, length, struct.unpack(">i", d[84:88])[0]))
        rows = head + CARD + -(-count * size // CARD) * CARD
        if not data.startswith(ROWS, rows):
            raise TransportError("the rows' header is missing")
        out.append(Member(title, label, tuple(fields), rows + CARD, stop))
    return out


def numbers(cells: np.ndarray) -> np.ndarray:
    """Hexadecimal floats (rows by bytes, 2 to 8 of them) as doubles; missing codes become nan."""
    full = np.zeros((len(cells), 8), np.uint8)
    full[:, : cells.shape[1]] = cells
    first, rest = full[:, 0], full[:, 1:]
    missing = (rest == 0).all(axis=1) & np.isin(first, np.frombuffer(MISSING, np.uint8))
    mantissa = (rest.astype(np.uint64) << np.uint64(8) * np.arange(6, -1, -1, dtype=np.uint64)).sum(axis=1).astype(np.float64)
    value = np.ldexp(mantissa, 4 * ((first & 0x7F).astype(np.int64) - 64) - 56)
    return np.where(missing, np.nan, np.where(first & 0x80, -value, value))


def _decoded(member: Member):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                data = content.as_buffer()
                size = (member.end - member.begin) // member.width if member.width else 0
                rows = np.frombuffer(data, np.uint8, size * member.width, member.begin).reshape(size, member.width) if size else np.zeros((0, 1), np.uint8)
                filled = np.flatnonzero((rows != 32).any(axis=1))  # what pads the last card are blank rows
                rows = rows[: filled[-1] + 1] if len(filled) else rows[:0]
                for at in range(0, len(rows), CHUNK_ROWS):
                    some = rows[at : at + CHUNK_ROWS]
                    columns = [pa.array(np.arange(at, at + len(some)))]
                    for f in member.fields:
                        cells = np.ascontiguousarray(some[:, f.offset : f.offset + f.length])
                        if f.numeric:
                            values = numbers(cells)
                            columns.append(pa.array(values, mask=np.isnan(values)))
                        else:
                            texts = np.char.rstrip(np.char.decode(cells.view(f"S{f.length}").ravel(), "latin-1"), " \0")
                            columns.append(pa.array(texts.tolist(), pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=[ORD, *[f.name for f in member.fields]])

    return run


def read_transport(spark: SparkSession, path: str) -> list[Dataset]:
    """The members of a transport file. Numbers are doubles, missing codes null, texts without trailing blanks."""
    files = spark.read.format("binaryFile").load(path).select("content")
    content = files.first()
    if content is None:
        raise TransportError(f"{path} is empty")
    out = []
    for member in members(bytes(content[0])):
        schema = T.StructType([T.StructField(ORD, T.LongType()), *[T.StructField(f.name, T.DoubleType() if f.numeric else T.StringType()) for f in member.fields]])
        df: DataFrame = files.mapInArrow(_decoded(member), schema)
        whole = [f.name for f in member.fields if f.numeric]
        checks = df.agg(*[F.coalesce(F.bool_and(F.col(c).isNull() | ((F.col(c) == F.floor(c)) & (F.abs(c) < 2**53))), F.lit(True)).alias(c) for c in whole]).first() if whole else {}
        df = df.withColumns({c: F.col(c).cast("bigint") for c in whole if checks[c]})
        variables = tuple(Variable(f.name, f.label, "Num" if f.numeric else "Char", f.length) for f in member.fields)
        out.append(Dataset(member.name, df, member.name, member.label, PurePosixPath(path).name, "xpt", variables))
    return out
