"""The tables that a rule's Match Datasets make: lookups joined to each table in scope, or a chain of tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import functions as F

from attestra.functions.positions import with_position
from attestra.functions.scalars import quoted
from attestra.model import ORD, SOURCE_ROW, ColumnRef, Dataset, Rule, RuleError, Values, leaves
from attestra.operators import joins
from attestra.operators.operations import Context, first_of
from attestra.plans.rules import snake

NAMED_BY, KEYED_BY = ("dataset", "domain", "name", "id"), ("by", "keys", "on", "join_keys", "match_keys")


def mentioned(rule: Rule) -> set[str]:
    """Upper-cased names that the rule's condition and output variables may mean."""
    names = list(rule.output_variables)
    for leaf in leaves(rule.conditions):
        names.append(leaf.target)
        names += [leaf.comparator.name] if isinstance(leaf.comparator, ColumnRef) else [v for v in leaf.comparator.values if isinstance(v, str)] if isinstance(leaf.comparator, Values) else []
    return {n.upper() for n in names if n}


def keys_of(spec: dict[str, Any], left: Dataset, right: Dataset) -> tuple[list[str], list[str]]:
    """Key columns of either side: a text, a list, or {left, right}; without any, the columns that both have."""
    given = first_of(spec, *KEYED_BY)
    given = [given] if isinstance(given, str | dict) else given or [c for c in left.columns if right.column(c)]
    side = lambda k, s: k.get(s) if isinstance(k, dict) else k
    return [side(k, "left") for k in given], [side(k, "right") for k in given]


def _suffixed(left: Dataset, right: Dataset, keys: Sequence[str], name: str, names: set[str]) -> Dataset:
    """The right side with ``COLUMN.NAME`` for what the left side has too or the rule mentions so; keys get a copy."""
    df, own = right.df, {k.upper() for k in keys}
    for c in right.columns:
        new = f"{c}.{name}"
        if c.upper() in own:
            if left.column(c) and new.upper() in names:
                df = df.withColumn(new, quoted(c))
        elif left.column(c) or new.upper() in names:
            df = df.withColumnRenamed(c, new)
    return right.with_df(df)


def look_up(rule: Rule, base: Dataset, spec: dict[str, Any], name: str, other: Dataset) -> Dataset:
    """``base`` with the lookup's columns: with a prefix if one is given or mentioned, else with suffixes where names clash."""
    names, (left_by, right_by) = mentioned(rule), keys_of(spec, base, other)
    if not left_by:
        raise RuleError(f"no keys for {name}", "missing_dataset")
    prefix = spec.get("prefix")
    if prefix is None:
        prefix = f"{name}." if any(n.startswith(f"{name.upper()}.") for n in names) else ""
    how = "inner" if str(spec.get("join_type", "")).lower() == "inner" else "left"
    if not prefix:
        return joins.join(base, _suffixed(base, other, right_by, name, names), how, left_by, right_by, "")
    out = joins.join(base, other, how, left_by, right_by, prefix)
    own = {k.upper() for k in right_by}
    plain = [c for c in other.columns if c.upper() in names and c.upper() not in own and not out.column(c) and out.column(f"{prefix}{c}")]
    return out.with_df(out.df.withColumns({c: quoted(f"{prefix}{c}") for c in plain})) if plain else out


def with_source_row(ds: Dataset) -> Dataset:
    """Rows keep the place they have now through every join that follows."""
    return ds if SOURCE_ROW in ds.df.columns else ds.with_df(with_position(ds.df, [ORD], SOURCE_ROW))


def matched(rule: Rule, scoped: Sequence[Dataset], datasets: Sequence[Dataset]) -> list[tuple[Dataset, Dataset]]:
    """(table, joined table) pairs.

    One lookup, and any number under an entity scope, are joined to each table in scope, whose rows the
    issues name; a lookup that may be absent (Join Type: left) leaves nulls. Several lookups otherwise make
    a chain that begins with the first of them. A supplemental-qualifier table gets its parents' rows.
    """
    context, specs = Context(datasets), [{snake(k): v for k, v in s.items()} for s in rule.match_datasets]
    named = [(str(first_of(s, *NAMED_BY) or ""), s) for s in specs]
    if not named:
        return [(ds, ds) for ds in scoped]
    found = {name: context.find(name) for name, _ in named}
    if len(named) > 1 and not rule.entities:
        absent = next((name for name, other in found.items() if other is None), None)
        if absent is not None:
            raise RuleError(f"no table {absent}", "missing_dataset")
        first = out = found[named[0][0]]
        for name, spec in named[1:]:
            keys = spec if first_of(spec, *KEYED_BY) else named[0][1]
            left_by, right_by = keys_of(keys, out, found[name])
            out = joins.join(out, found[name], "left", left_by, right_by, spec.get("prefix"))
        return [(first, out)]
    others = [ds for ds in scoped if rule.entities or found[named[0][0]] is None or ds.name != found[named[0][0]].name]
    if not others:
        return [(ds, ds) for ds in scoped]
    pairs = []
    for ds in others:
        firsts = [k for _, spec in named[:1] if found[named[0][0]] for k in keys_of(spec, ds, found[named[0][0]])[0]]
        if not all(ds.column(k) for k in firsts):
            continue  # a table without the keys is not looked at
        out = with_source_row(ds)
        for name, spec in named:
            other = found[name]
            if other is None and str(spec.get("join_type", "")).lower() == "left":
                absent = [n for n in sorted(mentioned(rule)) if n.endswith(f".{name.upper()}") and not out.column(n)]
                out = out.with_df(out.df.withColumns({n: F.lit(None).cast("string") for n in absent})) if absent else out
            elif other is None:
                raise RuleError(f"no table {name}", "missing_dataset")
            elif name.upper().startswith("SUPP") and ds.column("IDVAR"):
                out = joins.supplemental(other, out)
            else:
                out = look_up(rule, out, spec, name, other)
        pairs.append((ds, out))
    return pairs
