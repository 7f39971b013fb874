"""Readers of tables: CSV, column-oriented JSON packages, study directories, Parquet.

Types follow from all values of a column, as text would be read by hand: a column is Boolean, whole
numbers, numbers or text; one odd value makes it text.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Sequence
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions.scalars import quoted
from attestra.model import ORD, Dataset, Variable

# Fixed formats of cells.
BOOLEAN = ("true", "TRUE", "True", "false", "FALSE", "False")
INTEGER = r"^-?(?:0|[1-9][0-9]*)$"
DECIMAL = r"^-?[0-9]+(?:\.[0-9]+(?:[eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+|\.)$"
LARGEST_EXACT = 2**53 - 1
#: A package is one JSON document, which the driver reads; larger data belong in CSV or Parquet.
PACKAGE_BYTES = 256 * 1024 * 1024


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file of any store that Spark reads, also one whose name begins with an underscore."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def infer(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Types of text columns by one aggregate over all rows: Boolean, long, double or text.

    A column without a value is Boolean. Whole numbers beyond 2^53 - 1 that meet decimals make text.
    """
    if not columns:
        return df
    checks = []
    for i, c in enumerate(columns):
        v = quoted(c)
        whole = v.rlike(INTEGER) & v.try_cast("bigint").isNotNull()
        number = (whole & (F.abs(v.try_cast("double")) <= LARGEST_EXACT)) | (v.rlike(DECIMAL) & (F.abs(v.try_cast("double")) < float("inf")))
        for kind, fits in (("b", v.isin(*BOOLEAN)), ("l", whole), ("d", number & v.isNotNull())):
            checks.append(F.coalesce(F.bool_and(v.isNull() | fits), F.lit(True)).alias(f"{kind}{i}"))
        checks.append(F.coalesce(F.bool_or(v.rlike(DECIMAL)), F.lit(False)).alias(f"f{i}"))
    seen = df.agg(*checks).first()
    out: dict[str, Column] = {}
    for i, c in enumerate(columns):
        kind = "boolean" if seen[f"b{i}"] else "bigint" if seen[f"l{i}"] else "double" if seen[f"d{i}"] and not _mixed(seen, i) else "string"
        out[c] = quoted(c).cast(kind)
    return df.withColumns(out)


def _mixed(seen: Any, i: int) -> bool:
    """Decimals beside plain whole numbers: such a column stays text."""
    return not seen[f"f{i}"]


def read_csv(spark: SparkSession, path: str, name: str | None = None, typed: bool = True, multi_line: bool = True) -> Dataset:
    """A CSV file with a header, or a folder of them; an empty cell is null. The table is named by the file, in capitals.

    Rows follow files by name, then their place. Cells with line breaks make a file one task; without such
    cells ``multi_line=False`` lets Spark split large files.
    """
    stem = name or PurePosixPath(path).stem.upper()
    df = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line, nullValue="", emptyValue="")
    columns = df.columns
    df = df.withColumn(ORD, F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("k")))
    return Dataset(stem, infer(df, columns) if typed else df, stem[:2] if not stem.startswith("AD") else stem, filename=PurePosixPath(path).name, source_format="csv", variables=tuple(Variable(c) for c in columns))


def read_parquet(spark: SparkSession, path: str, order: Sequence[str] = (), name: str | None = None) -> Dataset:
    """A Parquet table; its rows' order is that of the columns ``order``, else the files'."""
    df = spark.read.parquet(path)
    key = F.monotonically_increasing_id() if not order else quoted(order[0]) if len(order) == 1 else F.struct(*map(quoted, order))
    stem = name or PurePosixPath(path).stem.upper()
    return Dataset(stem, df.withColumn(ORD, key), stem, filename=PurePosixPath(path).name, source_format="parquet", variables=tuple(Variable(c) for c in df.columns))


def column_type(values: Sequence[Any]) -> T.DataType:
    """The type of a JSON column: of its values, all of them."""
    present = [v for v in values if v is not None]
    if all(isinstance(v, bool) for v in present):
        return T.BooleanType()
    if any(isinstance(v, bool) or not isinstance(v, int | float) for v in present):
        return T.StringType()
    if all(isinstance(v, int) for v in present):
        return T.LongType() if all(-(2**63) <= v < 2**63 for v in present) else T.StringType()
    exact = all(isinstance(v, float) or abs(v) <= LARGEST_EXACT for v in present)
    return T.DoubleType() if exact else T.StringType()


def cell_text(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def from_columns(spark: SparkSession, records: dict[str, Sequence[Any]]) -> DataFrame:
    """A table of equally long columns, with the order column."""
    kinds = {c: column_type(v) for c, v in records.items()}
    convert = {c: (cell_text if isinstance(k, T.StringType) else float if isinstance(k, T.DoubleType) else None) for c, k in kinds.items()}
    size = max((len(v) for v in records.values()), default=0)
    rows = []
    for i in range(size):
        cells = []
        for c, values in records.items():
            v = values[i] if i < len(values) else None
            cells.append(v if v is None or convert[c] is None else convert[c](v))
        rows.append((i, *cells))
    return spark.createDataFrame(rows, T.StructType([T.StructField(ORD, T.LongType(), False), *[T.StructField(c, k) for c, k in kinds.items()]]))


def read_package(spark: SparkSession, path: str) -> list[Dataset]:
    """The tables of a JSON package: datasets with filename, label, domain, variables and records by column."""
    source = read_text(spark, path)
    if len(source) > PACKAGE_BYTES:
        raise ValueError(f"{path} holds over {PACKAGE_BYTES} characters; keep such tables as CSV or Parquet")
    out = []
    for entry in json.loads(source).get("datasets", []):
        variables = tuple(Variable(v.get("name", ""), v.get("label", ""), v.get("type", ""), v.get("length"), {k: x for k, x in v.items() if k not in ("name", "label", "type", "length")}) for v in entry.get("variables", []))
        filename = entry.get("filename", "")
        name = entry.get("name") or entry.get("domain") or PurePosixPath(filename).stem.upper()
        records = entry.get("records") or {v.name: [] for v in variables}
        out.append(Dataset(name, from_columns(spark, records), entry.get("domain"), entry.get("label", ""), filename, "json", variables))
    return out


DECLARED = {"char": "string", "text": "string", "num": "double", "float": "double", "integer": "double", "bool": "boolean", "boolean": "boolean"}


def _declared(source: str, stems: Sequence[str]) -> list[dict[str, str]]:
    """Rows of dataset, variable, label, type and length, from either layout of a study's variables."""
    rows = list(csv.reader(io.StringIO(source)))
    headers = [h.strip() for h in rows[0]] if rows else []
    if not {h.lower() for h in headers} & {"dataset", "variable", "name", "variable_name", "variable name"} and len(set(stems)) == 1:
        cell = lambda k, i: rows[k][i].strip() if k < len(rows) and i < len(rows[k]) else ""
        return [{"dataset": stems[0], "variable": h.upper(), "label": cell(1, i), "type": cell(2, i), "length": cell(3, i)} for i, h in enumerate(headers) if h]
    return list(csv.DictReader(io.StringIO(source)))


def _by_label(names: Sequence[str], variables: Sequence[Variable]) -> dict[str, str]:
    """New names of columns that are headed by the label of one variable."""
    plain = lambda text: " ".join(text.split()).upper()
    known, labels = {v.name.upper() for v in variables}, [plain(v.label) for v in variables]
    named = {label: v.name for label, v in zip(labels, variables, strict=True) if label and labels.count(label) == 1}
    return {n: named[plain(n)] for n in names if n.strip().upper() not in known and plain(n) in named and named[plain(n)] not in names}


def read_study(spark: SparkSession, folder: str) -> tuple[list[Dataset], list[str]]:
    """The tables of a study directory, and warnings.

    ``_datasets.csv`` (Filename, Label) lists them, ``_variables.csv`` (dataset, variable, label, type,
    length) declares types; for a study of one table it may also be laid out like the table, with
    rows of labels, types and lengths. A column headed by a variable's label gets its name. A number that
    can't be read, empty or a point becomes null; text keeps its empty cells. Files outside the folder
    are refused.
    """
    folder = folder.rstrip("/")
    listed = list(csv.DictReader(io.StringIO(read_text(spark, f"{folder}/_datasets.csv"))))
    lower = lambda row: {(k or "").strip().lower(): (v or "").strip() for k, v in row.items()}
    declared = _declared(read_text(spark, f"{folder}/_variables.csv"), [PurePosixPath(lower(r).get("filename", "")).stem.upper() for r in listed])
    by_table: dict[str, list[dict[str, str]]] = {}
    for row in map(lower, declared):
        by_table.setdefault(row.get("dataset", "").upper().rpartition(".")[0] or row.get("dataset", "").upper(), []).append(row)
    tables, warnings = [], []
    for row in map(lower, listed):
        filename = row.get("filename", "")
        if filename.startswith("/") or ".." in PurePosixPath(filename).parts:
            raise ValueError(f"{filename} is outside the study")
        stem = PurePosixPath(filename).stem.upper()
        raw = spark.read.csv(f"{folder}/{filename}", header=True, inferSchema=False, quote='"', escape='"', multiLine=True, nullValue="\u0000", emptyValue="")
        raw = raw.fillna("")
        names = raw.columns
        variables = tuple(Variable(v["variable"], v.get("label", ""), v.get("type", ""), int(v["length"]) if v.get("length", "").isdigit() else None) for v in by_table.get(stem, []) if v.get("variable"))
        kinds = {v.name: DECLARED.get(v.type.lower(), "string") for v in variables}
        raw = raw.withColumnsRenamed(_by_label(names, variables))
        names = raw.columns
        df = raw.withColumn(ORD, F.monotonically_increasing_id())
        bad = []
        for c in names:
            if kinds.get(c, "string") == "double":
                plain = F.trim(quoted(c))
                value = F.when(~plain.isin("", "."), plain.try_cast("double"))
                bad.append(F.count(F.when(~plain.isin("", ".") & value.isNull(), 1)).alias(c))
                df = df.withColumn(c, value)
            elif kinds.get(c) == "boolean":
                df = df.withColumn(c, F.when(F.lower(quoted(c)).isin("true", "y", "1"), True).when(F.lower(quoted(c)).isin("false", "n", "0"), False))
        if bad:
            for c, n in raw.agg(*bad).first().asDict().items():
                if n:
                    warnings.append(f"{filename}: {n} values of {c} are no numbers")
        tables.append(Dataset(stem, df, stem, row.get("label", ""), filename, "csv", variables))
    return tables, warnings


def scan_folder(spark: SparkSession, folder: str) -> tuple[list[Dataset], list[str]]:
    """All tables of a folder in name order, not below it; unknown kinds of file give warnings."""
    from attestra.sources.transport import read_transport

    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(s.getPath().toString() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at))
    if any(n.endswith("/_datasets.csv") for n in names):
        return read_study(spark, folder)
    tables, warnings = [], []
    for path in names:
        kind = re.sub(r".*\.", "", path.rpartition("/")[2]).lower()
        if kind == "csv":
            tables.append(read_csv(spark, path))
        elif kind == "json":
            tables += read_package(spark, path)
        elif kind == "parquet":
            tables.append(read_parquet(spark, path))
        elif kind == "xpt":
            tables += read_transport(spark, path)
        else:
            warnings.append(f"{path} is of no known kind")
    return tables, warnings
