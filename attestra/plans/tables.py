"""Tables that rules about metadata run on, made from what is known of the datasets."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from attestra.functions import scalars
from attestra.model import ORD, Dataset, RuleError
from attestra.sources.metadata import Define
from attestra.sources.tables import from_columns


#: The table of what is wrong with a document's structure, which rules of the JSON schema type read.
SCHEMA_ISSUES = "JSONSchemaIssue"


def dataset_metadata(spark: SparkSession, datasets: Sequence[Dataset], counts: bool = True) -> Dataset:
    """One row for each table."""
    records = {
        "dataset_name": [d.name for d in datasets], "dataset_label": [d.label for d in datasets], "DOMAIN": [d.domain for d in datasets], "dataset_location": [d.filename for d in datasets],
        "dataset_names": ["|".join(d.name for d in datasets)] * len(datasets),
    }
    if counts:
        records["record_count"] = [d.df.count() for d in datasets]
    return Dataset("DATASETS", from_columns(spark, records))


def variable_metadata(spark: SparkSession, ds: Dataset, define: Define | None = None, library: dict[str, dict[str, Any]] | None = None) -> Dataset:
    """One row for each variable of a table, in its order; what Define-XML and the standard's library say of it beside what the table says."""
    labels = {n.upper(): (n, label) for n, label in ((library or {}).get((ds.domain or ds.name).upper(), {}).get("labels") or {}).items()}
    known = {v.name: v for v in ds.variables}
    said = {v.get("name"): v for v in (define.variables if define else []) if v.get("dataset") == ds.name}
    kinds = {f.name: "Num" if f.dataType.typeName() in ("long", "integer", "double", "float") else "Char" for f in ds.df.schema}
    names = ds.columns
    records = {
        "variable_name": names, "variable_label": [known[n].label if n in known else "" for n in names], "variable_data_type": [(known[n].type if n in known else "") or kinds[n] for n in names],
        "variable_size": [known[n].length if n in known else None for n in names], "variable_order_number": list(range(1, len(names) + 1)), "dataset_name": [ds.name] * len(names),
        "dataset_label": [ds.label] * len(names), "variable_type": [(known[n].type if n in known else "") or kinds[n] for n in names],
        "variable_length": [known[n].length if n in known else None for n in names], "variable_order": list(range(1, len(names) + 1)),
        "library_variable_name": [labels.get(n.upper(), (None, None))[0] for n in names], "library_variable_label": [labels.get(n.upper(), (None, None))[1] for n in names],
        "define_variable_name": [n if n in said else None for n in names], "define_variable_label": [said.get(n, {}).get("label") for n in names], "define_variable_role": [said.get(n, {}).get("role") for n in names], "define_variable_type": [said.get(n, {}).get("type") for n in names],
        "define_variable_ccode": [said.get(n, {}).get("codelist") for n in names], "define_variable_mandatory": [said.get(n, {}).get("mandatory") for n in names],
    }
    return Dataset(ds.name, from_columns(spark, records), ds.domain, ds.label, ds.filename, ds.source_format)


def value_metadata(ds: Dataset) -> Dataset:
    """One row for each value of a text variable: variable_name, variable_value and its row."""
    texts = [c for c in ds.columns if ds.df.schema[c].dataType.typeName() == "string"]
    pairs = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(c).alias("variable_name"), scalars.quoted(c).alias("variable_value")) for i, c in enumerate(texts)])
    rows = ds.df.select(F.col(ORD).alias("__row_ord"), F.explode(pairs).alias("x")) if texts else ds.df.select(F.col(ORD).alias("__row_ord"), F.explode(F.array().cast("array<struct<k:int,variable_name:string,variable_value:string>>")).alias("x"))
    return ds.with_df(rows.select(F.struct("__row_ord", "x.k").alias(ORD), "x.variable_name", "x.variable_value"))


def presence_anchor(spark: SparkSession, datasets: Sequence[Dataset]) -> Dataset:
    """One row with a column for each domain that is there."""
    names = dict.fromkeys(n for d in datasets for n in (d.domain, d.name) if n)
    return Dataset("STUDY", from_columns(spark, {n: [n] for n in names} or {"__none": [None]}))


def domain_tables(rule_type: str, spark: SparkSession, datasets: Sequence[Dataset], define: Define | None = None, library: dict[str, dict[str, Any]] | None = None) -> list[Dataset]:
    """The tables that a rule of the type runs on."""
    if rule_type == "json_schema":
        found = [d for d in datasets if d.name.upper() == SCHEMA_ISSUES.upper()]
        if not found:
            raise RuleError(f"no table {SCHEMA_ISSUES}", "missing_dataset")
        return found
    if rule_type == "dataset_metadata":
        return [dataset_metadata(spark, datasets)]
    if rule_type == "variable_metadata":
        return [variable_metadata(spark, d, define, library) for d in datasets]
    if rule_type == "value_metadata":
        return [value_metadata(d) for d in datasets]
    if rule_type == "domain_presence":
        return [presence_anchor(spark, datasets)]
    return list(datasets)
