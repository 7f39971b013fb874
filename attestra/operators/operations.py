"""Dataset operations: each takes a table and its specification, and returns the table that follows.

A statistic of a group is an aggregate that is joined back to the rows, so a group of any size is
summed before the shuffle. ``ORD`` keeps the order of rows through every step.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.functions import dates, patterns, scalars
from attestra.functions.positions import with_position
from attestra.functions.scalars import Scalar, quoted
from attestra.model import ORD, Condition, Dataset, MissingColumn, RuleError, expand
from attestra.operators.conditions import violations


@dataclass
class Context:
    """What an operation may look up besides its own table."""

    datasets: Sequence[Dataset] = ()
    parse_condition: Callable[[Any], Condition] | None = None
    codelists: DataFrame | None = None  # code, extensible, term_code, value, pref_term, version
    codelist_dates: dict[str, list[str]] = field(default_factory=dict)
    #: What a standard's library says of a domain: by domain, "columns", "required", "expected", "permissible" and "model" lists of names.
    library: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    def find(self, name: str) -> Dataset | None:
        """The first table whose name, domain or file stem is ``name``."""
        wanted = name.upper()
        for d in self.datasets:
            if wanted in (d.name.upper(), (d.domain or "").upper(), d.filename.upper(), d.filename.upper().rpartition(".")[0]):
                return d
        return None


def first_of(spec: dict[str, Any], *keys: str) -> Any:
    """The value of the first key that is there."""
    return next((spec[k] for k in keys if k in spec), None)


def word(spec: dict[str, Any], *keys: str) -> str | None:
    value = first_of(spec, *keys)
    return value if isinstance(value, str) else None


def words(spec: dict[str, Any], *keys: str) -> list[str]:
    value = first_of(spec, *keys)
    if isinstance(value, str):
        return [v.strip() for v in value.split(",") if v.strip()]
    return [str(v) for v in value] if isinstance(value, list | tuple) else []


BY = ("by", "keys", "columns", "group", "group_by")
OUT = ("as", "target", "output", "output_column", "id")
SOURCE = ("source_column", "source", "column", "from", "name")


def columns_of(ds: Dataset, names: Sequence[str], exact: bool = True) -> list[str]:
    out = []
    for name in names:
        found = ds.column(name, exact)
        if found is None:
            raise MissingColumn(expand(name, ds.domain))
        out.append(found)
    return out


def new_column(ds: Dataset, name: str | None, column: Column) -> Dataset:
    """Adds a column; ``$x`` is also written as ``x``."""
    if not name:
        raise RuleError("the operation names no column to write")
    name = expand(name, ds.domain)
    if name in ds.columns:
        raise RuleError(f"column {name} exists already")
    df = ds.df.withColumn(name, column)
    if name.startswith("$") and name[1:] not in ds.columns:
        df = df.withColumn(name[1:], quoted(name))
    return ds.with_df(df)


def group_keys(ds: Dataset, names: Sequence[str], typed: bool = False) -> list[Column]:
    """Keys of groups: as text with null as empty, or typed with null a key of its own."""
    found = columns_of(ds, names)
    if typed:
        return [quoted(c) for c in found]
    return [F.coalesce(scalars.text(scalars.of_column(ds.df, c), None), F.lit("")) for c in found]


def joined_back(ds: Dataset, keys: Sequence[Column], aggregates: dict[str, Column]) -> DataFrame:
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = ds.df.withColumns(dict(zip(names, keys, strict=True)))
    if not names:
        return keyed.join(F.broadcast(keyed.agg(*[c.alias(n) for n, c in aggregates.items()])))  # one row
    groups = keyed.groupBy(*names).agg(*[c.alias(n) for n, c in aggregates.items()])
    right = groups.withColumnsRenamed({n: f"{n}r" for n in names})
    same = [F.col(n).eqNullSafe(F.col(f"{n}r")) for n in names]
    return keyed.join(right, same, "left").drop(*names, *[f"{n}r" for n in names])


# rows


def _mask(ds: Dataset, condition: Any, context: Context) -> DataFrame:
    return violations(ds, context.parse_condition(condition))


def _shorthand(value: Any) -> Any:
    """``{COLUMN: value}`` means that every column equals its value."""
    if isinstance(value, dict) and not {"all", "any", "not", "name", "operator"} & set(value):
        return {"all": [{"name": k, "operator": "equal_to", "value": v, "value_is_literal": True} for k, v in value.items()]}
    return value


def filter_rows(ds: Dataset, spec: dict, context: Context) -> Dataset:
    condition = first_of(spec, "where", "condition", "conditions", "check", "filter")
    masked = _mask(ds, _shorthand(condition), context)
    return ds.with_df(masked.where("__mask").select(*ds.df.columns))


def sort_rows(ds: Dataset, spec: dict, context: Context) -> Dataset:
    """Stable; nulls first upwards and last downwards; one direction for all keys."""
    down = first_of(spec, "descending", "desc") is True or str(first_of(spec, "order", "direction") or "").lower().startswith("desc")
    keys = [quoted(c) for c in columns_of(ds, words(spec, *BY))]
    order = [k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys]
    return ds.with_df(with_position(ds.df.withColumnRenamed(ORD, "__old"), [*order, F.col("__old")], ORD).drop("__old"))


def select_columns(ds: Dataset, spec: dict, context: Context) -> Dataset:
    found = columns_of(ds, words(spec, "columns", "variables", "keep"))
    return ds.with_df(ds.df.select(*[quoted(c) for c in found], *[c for c in ds.df.columns if c.startswith("__")]))


def drop_columns(ds: Dataset, spec: dict, context: Context) -> Dataset:
    found = columns_of(ds, words(spec, "columns", "variables", "drop"), exact=False)
    if set(found) >= set(ds.columns):
        raise RuleError("all columns would go")
    return ds.with_df(ds.df.drop(*found))


def rename_columns(ds: Dataset, spec: dict, context: Context) -> Dataset:
    mapping = first_of(spec, "mapping", "columns", "rename")
    if not isinstance(mapping, dict):
        mapping = {word(spec, "from", "source"): word(spec, "to", "target", "as")}
    names = {columns_of(ds, [old], exact=False)[0]: new for old, new in mapping.items()}
    return ds.with_df(ds.df.withColumnsRenamed(names))


def distinct_rows(ds: Dataset, spec: dict, context: Context) -> Dataset:
    """The first row of each key, or of rows that are alike in all columns."""
    keys = [quoted(c) for c in columns_of(ds, words(spec, *BY) or ds.columns)]
    rest = [c for c in ds.df.columns]
    first = ds.df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*[quoted(c) for c in rest]), ORD).alias("r"))
    return ds.with_df(first.select(*[F.col("r").getField(c).alias(c) for c in rest]))


def row_number(ds: Dataset, spec: dict, context: Context) -> Dataset:
    """From 1 in row order within the groups."""
    names = words(spec, "by", "keys", "group", "partition_by")
    target = word(spec, *OUT) or "row_number"
    if not names:
        return ds.with_df(with_position(ds.df, [ORD], target))
    window = Window.partitionBy(*group_keys(ds, names, typed=True)).orderBy(ORD)
    return new_column(ds, target, F.row_number().over(window))


# columns


def derive(ds: Dataset, spec: dict, context: Context) -> Dataset:
    """A constant, a copy, or ``$uppercase``, ``$lowercase``, ``$trim`` and ``$concat`` of columns and literals."""
    target = word(spec, "target", "as", "output", "column", "name", "id")
    if "expression" in spec or "jsonata" in spec:
        return new_column(ds, target, expression(ds, str(first_of(spec, "expression", "jsonata"))))
    source = word(spec, "from", "source_column", "copy_from", "source")
    if source is not None:
        return new_column(ds, target, quoted(columns_of(ds, [source])[0]))
    value = first_of(spec, "value", "literal")
    return new_column(ds, target, F.lit(value) if value is not None else F.lit(None).cast("boolean"))


def expression(ds: Dataset, source: str) -> Column:
    source = source.strip()
    call = re.fullmatch(r"\$(uppercase|lowercase|trim|concat)\((.*)\)", source, re.S)
    if call:
        inner = [expression(ds, a) for a in arguments(call[2])]
        if call[1] == "concat":
            return F.concat(*[F.coalesce(a.cast("string"), F.lit("")) for a in inner])
        if len(inner) != 1:
            raise RuleError(f"${call[1]} takes one argument")
        return {"uppercase": scalars.ascii_upper, "lowercase": scalars.ascii_lower, "trim": scalars.strip}[call[1]](inner[0])
    if re.fullmatch(r"\"[^\"]*\"|'[^']*'", source):
        return F.lit(source[1:-1])
    if re.fullmatch(r"-?\d+(\.\d+)?", source):
        return F.lit(source)
    return scalars.text(scalars.of_column(ds.df, columns_of(ds, [source])[0]), None)


def arguments(source: str) -> list[str]:
    """Comma-separated parts outside quotes and brackets."""
    out, depth, quote, begin = [], 0, "", 0
    for i, c in enumerate(source):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(source[begin:i])
            begin = i + 1
    return [*out, source[begin:]]


def map_values(ds: Dataset, spec: dict, context: Context) -> Dataset:
    """The output of the first entry whose columns all have its values, else the empty text."""
    out = None
    for entry in spec.get("map", []):
        fits = F.lit(True)
        for name, value in entry.items():
            if name != "output":
                found = ds.column(name)
                held = scalars.of_value(name) if found is None else scalars.of_column(ds.df, found)
                fits = fits & scalars.equal(held, scalars.of_value(value))
        says = F.lit(str(entry.get("output", "")))
        out = F.when(fits, says) if out is None else out.when(fits, says)
    return new_column(ds, word(spec, *OUT), F.lit("") if out is None else out.otherwise(F.lit("")))


def split_by(ds: Dataset, spec: dict, context: Context) -> Dataset:
    source = scalars.text(scalars.of_column(ds.df, columns_of(ds, [word(spec, "name", "source_column", "column")])[0]), None)
    pieces = F.transform(F.split(source, re.escape(str(spec.get("delimiter", ",")))), scalars.strip)
    return new_column(ds, word(spec, *OUT), F.array_join(F.filter(pieces, lambda p: p != ""), "|"))


def study_day(ds: Dataset, spec: dict, context: Context) -> Dataset:
    day = scalars.text(scalars.of_column(ds.df, columns_of(ds, [word(spec, "name", "source_column")])[0]), None)
    reference = word(spec, "reference") or "RFSTDTC"
    found = ds.column(reference)
    if found is not None:
        return new_column(ds, word(spec, *OUT), dates.study_day(day, scalars.text(scalars.of_column(ds.df, found), None)))
    subjects = context.find("DM")
    if subjects is None or ds.column("USUBJID") is None:
        raise MissingColumn(reference)
    at = subjects.df.select(quoted("USUBJID").alias("__subject"), scalars.text(scalars.of_column(subjects.df, columns_of(subjects, [reference])[0]), None).alias("__reference")).groupBy("__subject").agg(F.min("__reference").alias("__reference"))
    df = ds.df.join(at, quoted("USUBJID") == F.col("__subject"), "left")
    done = new_column(ds.with_df(df), word(spec, *OUT), dates.study_day(day, F.col("__reference")))
    return done.with_df(done.df.drop("__subject", "__reference"))


# statistics


STATISTICS = {"avg": "mean", "average": "mean", "count_distinct": "count_distinct", "distinct_count": "count_distinct", "sum": "sum", "mean": "mean", "min": "min", "max": "max"}


def aggregate(ds: Dataset, spec: dict, context: Context) -> Dataset:
    """Adds a group's count or statistic to its rows.

    A filter limits what is counted; for other statistics it limits the rows that stay. A group
    without numbers sums to 0 and has no mean, least or largest. Unknown functions count.
    """
    function = STATISTICS.get(str(first_of(spec, "function", "aggregation", "statistic") or "").lower(), "count")
    target, names = word(spec, *OUT), words(spec, "by", "keys", "group", "group_by")
    target = expand(target or "count", ds.domain)
    if target in ds.columns:
        raise RuleError(f"column {target} exists already")
    condition = _shorthand(spec.get("filter"))
    if function == "count":
        keys = group_keys(ds, names)
        pattern = spec.get("regex")
        if isinstance(pattern, str):
            ported = patterns.port(pattern)
            keys = [F.when(k.rlike(ported), F.regexp_extract(k, ported, 0)).otherwise(k) for k in keys]
        if condition is None:
            df = joined_back(ds, keys, {target: F.count("*")})
        else:
            masked = ds.with_df(_mask(ds, condition, context))
            df = joined_back(masked, keys, {target: F.sum(F.col("__mask").cast("bigint"))}).select(*ds.df.columns, quoted(target))
        return _dollar(ds.with_df(df), target)
    if condition is not None:
        ds = ds.with_df(_mask(ds, condition, context).where("__mask").select(*ds.df.columns))
    source = scalars.of_column(ds.df, columns_of(ds, [word(spec, *SOURCE)])[0])
    if function == "count_distinct":
        made = F.count_distinct(scalars.text(source, None))
    else:
        value = scalars.number(source)
        made = {"sum": F.coalesce(F.sum(value), F.lit(0.0)), "mean": F.avg(value), "min": F.min(value), "max": F.max(value)}[function]
    return _dollar(ds.with_df(joined_back(ds, group_keys(ds, names), {target: made})), target)


def _dollar(ds: Dataset, target: str) -> Dataset:
    if target.startswith("$") and target[1:] not in ds.columns:
        return ds.with_df(ds.df.withColumn(target[1:], quoted(target)))
    return ds


def _least_or_largest(source: Scalar, largest: bool) -> Column:
    """As a number if every value that isn't blank is one, else as text; always shown as text."""
    shown = scalars.text(source, None)
    filled = F.when(scalars.strip(shown) != "", shown)
    value = scalars.number(source)
    pick = F.max if largest else F.min
    numbers = F.count(filled) == F.count(F.when(filled.isNotNull(), value))
    return F.when(numbers, scalars.number_text(pick(F.when(filled.isNotNull(), value)))).otherwise(pick(filled))


def extreme(largest: bool) -> Callable[[Dataset, dict, Context], Dataset]:
    """Least or largest value of a group, of this table or looked up from another."""

    def run(ds: Dataset, spec: dict, context: Context) -> Dataset:
        target, other = word(spec, "as", "id", "output", "target"), word(spec, "dataset", "domain")
        names = words(spec, "by", "group", "keys")
        if not names:
            raise RuleError("no keys", "unsupported_operation")
        source = word(spec, *SOURCE)
        outside = context.find(other) if other else None
        if outside is None or outside.name == ds.name:
            made = _least_or_largest(scalars.of_column(ds.df, columns_of(ds, [source])[0]), largest)
            return _dollar(ds.with_df(joined_back(ds, group_keys(ds, names), {target: made})), target)
        made = _least_or_largest(scalars.of_column(outside.df, columns_of(outside, [source])[0]), largest)
        return _dollar(looked_up(ds, outside, names, words(spec, "group_aliases"), {target: made}), target)

    return run


def looked_up(ds: Dataset, other: Dataset, names: Sequence[str], aliases: Sequence[str], aggregates: dict[str, Column], default: Any = None) -> Dataset:
    """Statistics of another table's groups, joined by keys; ``aliases`` name this table's keys."""
    theirs = [k.alias(f"__k{i}") for i, k in enumerate(group_keys(other, names))]
    mine = group_keys(ds, [*aliases, *names[len(aliases) :]])
    groups = other.df.groupBy(*theirs).agg(*[c.alias(n) for n, c in aggregates.items()])
    same = [m == F.col(f"__k{i}") for i, m in enumerate(mine)]
    df = ds.df.join(groups, same, "left").drop(*[f"__k{i}" for i in range(len(mine))])
    if default is not None:
        df = df.fillna(default, list(aggregates))
    return ds.with_df(df)


def record_count(ds: Dataset, spec: dict, context: Context) -> Dataset:
    """Rows of the group here, or of the matching group of another table (0 where there is none)."""
    outside = context.find(word(spec, "dataset") or "") if word(spec, "dataset") else None
    names = words(spec, "group", "by", "keys")
    if outside is None or outside.name == ds.name or not names:
        return aggregate(ds, {**spec, "function": "count", "by": names}, context)
    if spec.get("filter") is not None:
        outside = filter_rows(outside, {"where": spec["filter"]}, context)
    target = word(spec, *OUT) or "record_count"
    return _dollar(looked_up(ds, outside, names, words(spec, "group_aliases"), {target: F.count("*")}, 0), target)


def distinct_values(ds: Dataset, spec: dict, context: Context) -> Dataset:
    """The group's distinct values, in order, joined by a bar; of this table or looked up from another."""
    target, source, names = word(spec, "id", "as", "output"), word(spec, "name", "source_column", "column"), words(spec, "by", "group", "keys")
    outside = context.find(word(spec, "dataset") or "") if word(spec, "dataset") else None
    table = ds if outside is None else outside
    if spec.get("filter") is not None:
        table = filter_rows(table, {"where": spec["filter"]}, context)
    shown = scalars.text(scalars.of_column(table.df, columns_of(table, [source])[0]), None)
    made = {target: F.array_join(F.array_sort(F.collect_set(F.when(scalars.strip(shown) != "", shown))), "|")}
    if table is ds:
        return _dollar(ds.with_df(joined_back(ds, group_keys(ds, names), made)), target)
    if not names:
        return _dollar(ds.with_df(ds.df.join(F.broadcast(table.df.agg(*[c.alias(n) for n, c in made.items()])))), target)  # one row
    return _dollar(looked_up(ds, table, names, words(spec, "group_aliases"), made, ""), target)


def distinct(ds: Dataset, spec: dict, context: Context) -> Dataset:
    if spec.get("value_is_reference") is True:
        return referenced_variables(ds, spec, context)
    return distinct_values(ds, spec, context) if word(spec, "id", "as", "output") else distinct_rows(ds, spec, context)


# metadata


def domain_label(ds: Dataset, spec: dict, context: Context) -> Dataset:
    return new_column(ds, word(spec, *OUT), F.lit(ds.label or ds.domain or ds.name))


def study_domains(ds: Dataset, spec: dict, context: Context) -> Dataset:
    names = sorted({n.upper() for d in context.datasets for n in (d.name, d.domain) if n})
    return new_column(ds, word(spec, *OUT), F.lit("|".join(names)))


def variable_count(ds: Dataset, spec: dict, context: Context) -> Dataset:
    name = word(spec, "name", "source_column") or ""
    return new_column(ds, word(spec, *OUT), F.lit(sum(expand(name, d.domain) in d.columns for d in context.datasets)))


def extract_metadata(ds: Dataset, spec: dict, context: Context) -> Dataset:
    known = {"dataset_name": ds.name, "name": ds.name, "domain": ds.domain or "", "dataset_domain": ds.domain or "", "dataset_label": ds.label, "label": ds.label}
    key = (word(spec, "field", "name") or "").lower()
    if key not in known:
        raise RuleError(f"no metadata {key}")
    return new_column(ds, word(spec, *OUT), F.lit(known[key]))


def valid_codelist_dates(ds: Dataset, spec: dict, context: Context) -> Dataset:
    kinds = words(spec, "ct_package_types") or list(context.codelist_dates)
    found = sorted({d for k in kinds for d in context.codelist_dates.get(k, [])})
    return new_column(ds, word(spec, *OUT), F.lit("|".join(found)))


def _codelist(spec: dict, context: Context) -> DataFrame:
    if context.codelists is None:
        raise RuleError("no codelists were given")
    table = context.codelists
    if spec.get("version") is not None:
        table = table.where(F.coalesce(F.col("version"), F.lit("")) <= F.lit(str(spec["version"])))
    return table


def codelist_extensible(ds: Dataset, spec: dict, context: Context) -> Dataset:
    codes = words(spec, "codelist_code", "codelist", "codelists", "name")
    table = _codelist(spec, context)
    column = ds.column(codes[0]) if codes else None
    by_code = table.groupBy("code").agg(F.max(F.col("extensible").cast("boolean")).alias("__extensible"))
    key = F.lit(codes[0]) if column is None else quoted(column)
    df = ds.df.withColumn("__code", key).join(by_code, F.col("__code") == F.col("code"), "left").drop("code", "__code")
    done = new_column(ds.with_df(df), word(spec, *OUT), F.coalesce("__extensible", F.lit(False)))
    return done.with_df(done.df.drop("__extensible"))


def codelist_terms(ds: Dataset, spec: dict, context: Context) -> Dataset:
    """A codelist's terms joined by a bar, or the term that a column's value or code names."""
    codes, wanted = words(spec, "codelists", "codelist", "codelist_code"), str(spec.get("returntype", "value")).lower()
    table = _codelist(spec, context).where(F.col("code").isin(codes))
    shown = {"code": "term_code", "term_code": "term_code", "pref_term": "pref_term"}.get(wanted, "value")
    for key in ("term_code", "pref_term", "value"):
        column = ds.column(spec[key]) if isinstance(spec.get(key), str) else None
        if column is not None:
            terms = table.groupBy(F.col(key).alias("__term")).agg(F.min(shown).alias("__shown"))
            done = new_column(ds.with_df(ds.df.join(terms, quoted(column) == F.col("__term"), "left")), word(spec, *OUT), F.coalesce("__shown", F.lit("")))
            return done.with_df(done.df.drop("__term", "__shown"))
    every = table.agg(F.array_join(F.array_sort(F.collect_set(shown)), "|").alias("__terms"))  # one row
    done = new_column(ds.with_df(ds.df.join(F.broadcast(every))), word(spec, *OUT), F.col("__terms"))
    return done.with_df(done.df.drop("__terms"))


def filtered_variables(ds: Dataset, spec: dict, context: Context) -> Dataset:
    """The table's variables whose metadata have a value, as a list text of names."""
    key, value = str(spec.get("key_name", "")), spec.get("key_value")
    names = [v.name for v in ds.variables if str(getattr(v, key, v.extra.get(key, ""))) == str(value)]
    return new_column(ds, word(spec, *OUT), F.lit("[" + ", ".join(f"'{n}'" for n in names) + "]"))


def column_order(ds: Dataset, spec: dict, context: Context) -> Dataset:
    source = (context.find(ds.name) if "variable_name" in ds.columns else None) or ds  # a table of variables stands for the table they are of
    return new_column(ds, word(spec, *OUT), F.lit("|".join(source.columns)))


def from_library(kind: str) -> Callable[[Dataset, dict, Context], Dataset]:
    """A list of variable names that the standard's library has for the table's domain, joined by a bar."""

    def run(ds: Dataset, spec: dict, context: Context) -> Dataset:
        domain = (ds.domain or ds.name).upper()
        names = [expand(n, ds.domain) for n in context.library.get(domain, {}).get(kind, [])]
        if kind == "filtered":
            names = [expand(n, ds.domain) for n in context.library.get(domain, {}).get(str(spec.get("key_value", "")).lower(), [])]
        return new_column(ds, word(spec, *OUT), F.lit("|".join(names)))

    return run


def parent_column_order(ds: Dataset, spec: dict, context: Context) -> Dataset:
    """The library's column order of the domain that each row's RDOMAIN names."""
    source = columns_of(ds, [word(spec, "name", "source_column") or "RDOMAIN"])[0]
    out = F.lit("")
    for domain, lists in sorted(context.library.items()):
        out = F.when(F.upper(quoted(source)) == domain, F.lit("[" + ", ".join(f"'{n}'" for n in lists.get("columns", [])) + "]")).otherwise(out)
    return new_column(ds, word(spec, *OUT), out)


def referenced_variables(ds: Dataset, spec: dict, context: Context) -> Dataset:
    """The variables of the table that each row's RDOMAIN names, joined by a bar."""
    source = columns_of(ds, [word(spec, "name", "source_column") or "RDOMAIN"])[0]
    out = F.lit("")
    for other in context.datasets:
        out = F.when(F.upper(quoted(source)).isin(other.name.upper(), (other.domain or other.name).upper()), F.lit("|".join(other.columns))).otherwise(out)
    return new_column(ds, word(spec, *OUT), out)


def domain_is_custom(ds: Dataset, spec: dict, context: Context) -> Dataset:
    return new_column(ds, word(spec, *OUT), F.lit((ds.domain or ds.name).upper() not in context.library))


def dataset_names(ds: Dataset, spec: dict, context: Context) -> Dataset:
    return new_column(ds, word(spec, *OUT), F.lit("|".join(d.name for d in context.datasets)))


def variable_exists(ds: Dataset, spec: dict, context: Context) -> Dataset:
    return new_column(ds, word(spec, *OUT), F.lit(ds.column(word(spec, "name") or "") is not None))


# Elements that a fragment may hold, attributes that all and that some may have; elements of the reference namespace with theirs and the one each needs.
XHTML = "root a b br div em i img li ol p small span strong sub sup table tbody td th thead tr u ul".split()
XHTML_ATTRIBUTES = {"": ("class", "id", "style"), "a": ("href", "title"), "img": ("alt", "src"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan")}
USDM_ATTRIBUTES, USDM_NEEDS = {"tag": ("name",), "ref": ("attribute", "id", "klass")}, {"tag": "name", "ref": "id"}


def _split(tag: str) -> tuple[str, str]:
    """Namespace and local name."""
    space, _, name = tag.rpartition("}")
    return space.lstrip("{"), name


def _good_element(e: ElementTree.Element, namespace: str) -> bool:
    space, name = _split(e.tag)
    have = {_split(a)[1] for a in e.attrib}
    if space == namespace:  # a reference: of a known kind, with what it needs, and empty
        return name in USDM_ATTRIBUTES and USDM_NEEDS[name] in have <= set(USDM_ATTRIBUTES[name]) and not len(e) and not (e.text or "").strip()
    items = name not in ("ul", "ol") or all(_split(child.tag)[1] == "li" for child in e)
    return name in XHTML and items and have <= {*XHTML_ATTRIBUTES[""], *XHTML_ATTRIBUTES.get(name, ())}


def _is_fragment(text: str, namespace: str) -> bool:
    try:
        root = ElementTree.fromstring(f"<root xmlns:usdm={quoteattr(namespace)}>{text}</root>")
    except ElementTree.ParseError:
        return False
    return all(_good_element(e, namespace) for e in root.iter() if e is not root)


def xhtml_errors(ds: Dataset, spec: dict, context: Context) -> Dataset:
    """``invalid xhtml`` where a column's text is no fragment of the elements and attributes allowed, else null.

    ``namespace`` is that of the reference elements, whose prefix is usdm.
    """
    namespace = word(spec, "namespace") or "urn:usdm"

    @F.pandas_udf("string")
    def check(values: pd.Series) -> pd.Series:
        return values.map(lambda v: "invalid xhtml" if v and v.strip() and not _is_fragment(v, namespace) else None)

    source = columns_of(ds, [word(spec, "name", "source_column")])[0]
    return new_column(ds, word(spec, *OUT), check(quoted(source).cast("string")))


OPERATIONS: dict[str, Callable[[Dataset, dict, Context], Dataset]] = {
    **dict.fromkeys(("filter", "where", "subset"), filter_rows),
    **dict.fromkeys(("derive", "add_column"), derive),
    **dict.fromkeys(("aggregate", "group_by", "group_count"), aggregate),
    "record_count": record_count,
    **dict.fromkeys(("min", "min_date"), extreme(False)),
    **dict.fromkeys(("max", "max_date"), extreme(True)),
    **dict.fromkeys(("sort", "order_by"), sort_rows),
    **dict.fromkeys(("select", "keep", "project"), select_columns),
    **dict.fromkeys(("drop", "remove_columns", "exclude_columns"), drop_columns),
    **dict.fromkeys(("rename", "rename_columns"), rename_columns),
    **dict.fromkeys(("distinct", "deduplicate", "unique"), distinct),
    **dict.fromkeys(("row_number", "rank"), row_number),
    "domain_label": domain_label,
    "study_domains": study_domains,
    "variable_count": variable_count,
    "dy": study_day,
    "extract_metadata": extract_metadata,
    "valid_codelist_dates": valid_codelist_dates,
    "map": map_values,
    "codelist_extensible": codelist_extensible,
    "codelist_terms": codelist_terms,
    "split_by": split_by,
    "get_dataset_filtered_variables": filtered_variables,
    "get_xhtml_errors": xhtml_errors,
    "get_column_order_from_dataset": column_order,
    "get_column_order_from_library": from_library("columns"),
    "get_model_column_order": from_library("model"),
    "get_model_filtered_variables": from_library("filtered"),
    "get_parent_model_column_order": parent_column_order,
    "required_variables": from_library("required"),
    "expected_variables": from_library("expected"),
    "permissible_variables": from_library("permissible"),
    "referenced_variables": referenced_variables,
    "domain_is_custom": domain_is_custom,
    "dataset_names": dataset_names,
    "variable_exists": variable_exists,
}


def apply(ds: Dataset, spec: dict, context: Context) -> Dataset:
    """Runs the operation that ``operator`` (or else ``name``) names."""
    called = word(spec, "operator", "operation") or word(spec, "name") or ""
    operation = OPERATIONS.get(called.strip().lower().replace(" ", "_"))
    if operation is None:
        raise RuleError(f"unknown operation {called}", "unsupported_operation")
    if "operator" not in spec and "operation" not in spec:
        spec = {k: v for k, v in spec.items() if k != "name"}
    return operation(ds, spec, context)
