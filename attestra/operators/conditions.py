"""Condition trees as Boolean columns: true means that the row violates the rule.

Row operators are plain expressions. Operators over groups add their statistics by an aggregate and
an equi-join, so that one very large group is summed before the shuffle and can be split in the join;
only operators about the next row or about order use windows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.functions import dates, patterns, scalars
from attestra.functions.scalars import Scalar, quoted, two_valued
from attestra.model import ORD, All, AnyOf, ColumnRef, Condition, Dataset, Leaf, Literal, MissingColumn, Not, NoValue, RuleError, Terms, Values, expand, leaves

#: Lists up to this length become IN lists; longer ones become semi-joins.
INLINE_VALUES = 1000

RELATIONSHIP = {"is_not_unique_relationship", "is_not_unique_set", "is_unique_set"}
#: Operators that have a result for a column that is not there.
MISSING = {
    "exists": False, "not_exists": True, "is_empty": False, "is_not_empty": False, "is_not_contained_by": False, "is_not_contained_by_case_insensitive": False,
    "is_not_unique_set": None, "is_unique_set": None,
}
ALIASES = {"empty": "is_empty", "non_empty": "is_not_empty"}


@dataclass
class Compiler:
    """Compiles one tree for one table; ``df`` gains hidden columns on the way."""

    dataset: Dataset
    presence: bool = False
    df: DataFrame = None
    _names: Any = field(default_factory=itertools.count)

    def __post_init__(self):
        if self.df is None:
            self.df = self.dataset.df

    def hidden(self) -> str:
        return f"__c{next(self._names)}"

    # names and values

    def find(self, name: str) -> str | None:
        return self.dataset.column(name)

    def need(self, name: str) -> Scalar:
        found = self.find(name)
        if found is None:
            raise MissingColumn(expand(name, self.dataset.domain))
        return scalars.of_column(self.df, found)

    def scalar(self, leaf: Leaf) -> Scalar:
        c = leaf.comparator
        if isinstance(c, ColumnRef):
            found = self.find(c.name)
            return scalars.of_value(expand(c.name, self.dataset.domain)) if found is None else scalars.of_column(self.df, found)
        if isinstance(c, Values):
            raise RuleError(f"{leaf.operator} takes no list")
        return scalars.of_value(c.value if isinstance(c, Literal) else None)

    def literal(self, leaf: Leaf) -> str:
        c = leaf.comparator
        if not isinstance(c, Literal) or c.value is None:
            raise RuleError(f"{leaf.operator} takes a literal")
        return scalars_text(c.value)

    def option_column(self, leaf: Leaf, key: str, needed: bool = False) -> str | None:
        name = leaf.options.get(key)
        if not isinstance(name, str):
            if needed:
                raise RuleError(f"{leaf.operator} needs {key}")
            return None
        found = self.find(name)
        if found is None:
            raise MissingColumn(expand(name, self.dataset.domain))
        return found

    # trees

    def tree(self, condition: Condition) -> Column:
        if isinstance(condition, All):
            out = F.lit(True)
            for part in condition.parts:
                out = out & self.tree(part)
            return out
        if isinstance(condition, AnyOf):
            columns, missing = [], None
            for part in condition.parts:
                try:
                    columns.append(self.tree(part))
                except MissingColumn as error:
                    missing = error
            if not columns and missing is not None:
                raise missing
            out = F.lit(False)
            for c in columns:
                out = out | c
            return out
        if isinstance(condition, Not):
            return ~self.tree(condition.part)
        return self.leaf(condition)

    def leaf(self, leaf: Leaf) -> Column:
        name = ALIASES.get(leaf.operator, leaf.operator)
        operator = OPERATORS.get(name)
        if operator is None:
            raise RuleError(f"unknown operator {leaf.operator}", "unsupported_operator")
        if self.find(leaf.target) is None and MISSING.get(name, self) is not self and MISSING[name] is not None:
            return F.lit(MISSING[name])
        return two_valued(operator(self, leaf))

    def listed(self, shown: Column, terms: DataFrame) -> Column:
        """Whether ``terms`` (distinct) has the text, by an equi-join."""
        listed, key = self.hidden(), self.hidden()
        self.df = self.df.join(terms.select(F.col("term").alias(key), F.lit(True).alias(listed)), shown == F.col(key), "left").drop(key)
        return F.col(listed)

    # groups

    def grouped(self, keys: list[Column], **aggregates: Column) -> dict[str, Column]:
        """Statistics of each row's group, joined on; keys must not be null."""
        names = [self.hidden() for _ in keys] or [self.hidden()]
        keyed = self.df.withColumns(dict(zip(names, keys or [F.lit(0)], strict=True)))
        out = {k: self.hidden() for k in aggregates}
        groups = keyed.groupBy(*names).agg(*[c.alias(out[k]) for k, c in aggregates.items()])
        self.df = keyed.join(groups, names, "left")
        return {k: F.col(v) for k, v in out.items()}


def scalars_text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def _option(leaf: Leaf, key: str) -> bool:
    value = leaf.options.get(key)
    return value is True or (isinstance(value, str) and value.strip().lower() in ("true", "yes", "y", "1"))


# presence and emptiness


def _exists(c: Compiler, leaf: Leaf) -> Column:
    found = c.find(leaf.target)
    if c.presence:
        return F.lit(found is not None)
    return scalars.of_column(c.df, found).col.isNotNull()


def _empty(c: Compiler, leaf: Leaf) -> Column:
    return scalars.is_empty(c.need(leaf.target))


# equality and membership


def _equal(fold: bool = False) -> Callable[[Compiler, Leaf], Column]:
    def run(c: Compiler, leaf: Leaf) -> Column:
        return scalars.within(c.need(leaf.target), c.scalar(leaf), fold, _option(leaf, "type_insensitive"))

    return run


def _contained(fold: bool = False) -> Callable[[Compiler, Leaf], Column]:
    def run(c: Compiler, leaf: Leaf) -> Column:
        target, loose = c.need(leaf.target), _option(leaf, "type_insensitive")
        if isinstance(leaf.comparator, NoValue):
            raise RuleError(f"{leaf.operator} has nothing to look in")
        if isinstance(leaf.comparator, Terms):
            shown, term = scalars.text(target, None), F.col("term").cast("string")
            return c.listed(scalars.ascii_lower(shown) if fold else shown, leaf.comparator.df.select((scalars.ascii_lower(term) if fold else term).alias("term")).distinct())
        if not isinstance(leaf.comparator, Values):
            return scalars.within(target, c.scalar(leaf), fold, loose)
        values = list(leaf.comparator.values)
        plain = target.kind == "str" and not loose and all(isinstance(v, str) and "|" not in v for v in values)
        if not plain:
            out = F.lit(False)
            for v in values:
                out = out | scalars.within(target, scalars.of_value(v), fold, loose)
            return out
        shown = scalars.ascii_lower(target.col) if fold else target.col
        words = sorted({v.translate(LOWER) if fold else v for v in values})
        if len(words) <= INLINE_VALUES:
            return shown.isin(words)
        return c.listed(shown, c.df.sparkSession.createDataFrame([(w,) for w in words], "term string"))

    return run


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _contains(fold: bool = False) -> Callable[[Compiler, Leaf], Column]:
    def run(c: Compiler, leaf: Leaf) -> Column:
        target, needle = c.need(leaf.target), c.literal(leaf)
        hay = target.col if target.kind == "str" else scalars.text(target, None)
        if fold:
            hay, needle = scalars.ascii_lower(hay), needle.translate(LOWER)
        return F.when(hay.contains("|"), F.exists(scalars.parts(hay), lambda p: p == needle)).otherwise(hay.contains(F.lit(needle)))

    return run


def _contains_all(c: Compiler, leaf: Leaf) -> Column:
    target = c.need(leaf.target)
    if isinstance(leaf.comparator, Values):
        wanted = F.array(*[F.lit(scalars_text(v) if v is not None else "null") for v in leaf.comparator.values])
    else:
        wanted = scalars.as_list(c.scalar(leaf))
    return F.forall(wanted, lambda w: F.array_contains(_members(target), w))


def _members(s: Scalar) -> Column:
    """What a text holds as a list: its parts if there is a bar, and the text itself."""
    whole = F.array(scalars.text(s))
    return whole if s.kind != "str" else F.concat(whole, F.when(two_valued(s.col.contains("|")), scalars.parts(s.col)).otherwise(F.array().cast("array<string>")))


def _disjoint(c: Compiler, leaf: Leaf) -> Column:
    a, b = c.need(leaf.target), c.scalar(leaf)
    same_kind = a.kind == b.kind or "null" in (a.kind, b.kind)
    met = F.arrays_overlap(scalars.as_list(a), scalars.as_list(b)) if same_kind else a.col.isNull() & b.col.isNull()
    return ~two_valued(met)


def _not_ordered_subset(c: Compiler, leaf: Leaf) -> Column:
    left, right = scalars.as_list(c.need(leaf.target)), scalars.as_list(c.scalar(leaf))
    start = F.lit(0)  # how far the right list has been used; -1: something was not found

    def step(used: Column, want: Column) -> Column:
        at = F.array_position(F.slice(right, used + 1, F.greatest(F.size(right) - used, F.lit(0))), want).cast("int")
        return F.when((used < 0) | (at == 0), F.lit(-1)).otherwise(used + at)

    return F.aggregate(left, start, step) < 0


# order


def _ordered(operator: str) -> Callable[[Compiler, Leaf], Column]:
    return lambda c, leaf: scalars.compare(c.need(leaf.target), c.scalar(leaf), operator)


# patterns and affixes


def _text(c: Compiler, leaf: Leaf) -> Column:
    return scalars.text(c.need(leaf.target), None)


def _filled(c: Compiler, leaf: Leaf) -> Column:
    """The target as text, null where empty."""
    value = _text(c, leaf)
    return F.when(value != "", value)


def _matches(c: Compiler, leaf: Leaf) -> Column:
    return _text(c, leaf).rlike(patterns.port(c.literal(leaf)))


def _not_full(c: Compiler, leaf: Leaf) -> Column:
    return ~_filled(c, leaf).rlike(patterns.full(c.literal(leaf)))


def _size(leaf: Leaf, key: str) -> int:
    try:
        return int(leaf.options[key])
    except (KeyError, TypeError, ValueError):
        raise RuleError(f"{leaf.operator} needs {key}") from None


def _prefix(c: Compiler, leaf: Leaf) -> Column:
    return F.left(_filled(c, leaf), F.lit(_size(leaf, "prefix")))


def _suffix(c: Compiler, leaf: Leaf) -> Column:
    return F.right(_filled(c, leaf), F.lit(_size(leaf, "suffix")))


def _starts(c: Compiler, leaf: Leaf) -> Column:
    return _filled(c, leaf).startswith(scalars.text(c.scalar(leaf), None))


def _not_in(part: Callable[[Compiler, Leaf], Column]) -> Callable[[Compiler, Leaf], Column]:
    def run(c: Compiler, leaf: Leaf) -> Column:
        shown = part(c, leaf)
        if isinstance(leaf.comparator, Values):
            return F.when(shown.isNotNull(), ~shown.isin([scalars_text(v) for v in leaf.comparator.values if v is not None]))
        return F.when(shown.isNotNull(), ~scalars.within(Scalar(shown, "str"), c.scalar(leaf)))

    return run


def _string_part(c: Compiler, leaf: Leaf) -> Column:
    pattern = leaf.options.get("regex")
    if not isinstance(pattern, str):
        raise RuleError("does_not_equal_string_part needs regex")
    ported, other = patterns.port(pattern), scalars.text(c.scalar(leaf), None)
    return other.rlike(ported) & (F.coalesce(_text(c, leaf), F.lit("")) != F.regexp_extract(other, ported, 1))


# dates


def _date(operator: str) -> Callable[[Compiler, Leaf], Column]:
    ops = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}

    def run(c: Compiler, leaf: Leaf) -> Column:
        a, b = c.need(leaf.target), c.scalar(leaf)
        if a.kind != "str" or b.kind != "str":
            return F.lit(False)
        return ops[operator](dates.date_key(a.col), dates.date_key(b.col))

    return run


def _date_state(state: str) -> Callable[[Compiler, Leaf], Column]:
    def run(c: Compiler, leaf: Leaf) -> Column:
        s = c.need(leaf.target)
        value = scalars.text(s, None)
        whole, partly = dates.is_complete(value), dates.is_incomplete(value)
        return value.isNotNull() & {"complete": whole, "incomplete": partly, "invalid": ~(whole | partly)}[state]

    return run


def _bad_duration(c: Compiler, leaf: Leaf) -> Column:
    value = _text(c, leaf)
    return (scalars.strip(value) != "") & ~dates.is_duration(scalars.strip(value))


# groups


def _names(c: Compiler, leaf: Leaf) -> list[str]:
    if isinstance(leaf.comparator, ColumnRef):
        return [leaf.comparator.name]
    if isinstance(leaf.comparator, Literal) and isinstance(leaf.comparator.value, str):
        return [leaf.comparator.value]
    if isinstance(leaf.comparator, Values):
        return [str(v) for v in leaf.comparator.values]
    raise RuleError(f"{leaf.operator} needs column names")


def _key(c: Compiler, name: str) -> Column:
    found = c.find(name)
    return F.lit("Not in dataset") if found is None else F.coalesce(scalars.text(scalars.of_column(c.df, found), None), F.lit(""))


def _set_count(c: Compiler, leaf: Leaf) -> Column:
    pattern = leaf.options.get("regex")
    found = c.find(leaf.target)
    target = F.lit("Not in dataset") if found is None else scalars.text(scalars.of_column(c.df, found))
    keys = [_key(c, n) for n in _names(c, leaf)] + [target]
    if isinstance(pattern, str):
        ported = patterns.port(pattern)
        keys = [F.when(k.rlike(ported), F.regexp_extract(k, ported, 0)).otherwise(k) for k in keys]
    return c.grouped(keys, n=F.count("*"))["n"]


def _relationship(c: Compiler, leaf: Leaf) -> Column:
    a, b = c.need(leaf.target), c.need(_names(c, leaf)[0])
    left, right = (F.coalesce(scalars.text(s, None), F.lit("")) for s in (a, b))
    direction, out = leaf.options.get("direction"), F.lit(False)
    for side, key, other in (("comparator_to_target", left, right), ("target_to_comparator", right, left)):
        if direction != side:  # each direction leaves the other out
            low_high = c.grouped([key], low=F.min(other), high=F.max(other))
            out = out | (low_high["low"] != low_high["high"])
    return out


def _inconsistent(c: Compiler, leaf: Leaf) -> Column:
    target = scalars.text(c.need(leaf.target))
    low_high = c.grouped([_key(c, n) for n in _names(c, leaf)], low=F.min(target), high=F.max(target))
    return low_high["low"] != low_high["high"]


def _once(c: Compiler, leaf: Leaf) -> Column:
    target, within = c.need(leaf.target), c.option_column(leaf, "within")
    key = F.lit("") if within is None else _key(c, within)
    return ~scalars.is_empty(target) & (c.grouped([key, scalars.text(target)], n=F.count("*"))["n"] == 1)


def _order_key(s: Scalar) -> Column:
    """A total order of a column: null last, numbers and number-like text by value, other text by bytes."""
    return F.struct(s.col.isNull().alias("null"), scalars.number(s).isNull().alias("text"), scalars.number(s).alias("n"), scalars.text(s, None).alias("t"))


def _empty_but_last(c: Compiler, leaf: Leaf) -> Column:
    target, group = c.need(leaf.target), _names(c, leaf)[0]
    if c.find(group) is None:
        raise MissingColumn(group)
    order = F.struct(_order_key(scalars.of_column(c.df, c.option_column(leaf, "ordering", True))).alias("k"), F.col(ORD).alias("o"))
    last = c.grouped([_key(c, group)], last=F.max(order))["last"]
    return scalars.is_empty(target) & (F.col(ORD) != last["o"])


def _next_differs(c: Compiler, leaf: Leaf) -> Column:
    target, other = c.need(leaf.target), c.need(_names(c, leaf)[0])
    ordering, within = c.option_column(leaf, "ordering", True), c.option_column(leaf, "within")
    w = Window.partitionBy(_key(c, within) if within else F.lit("")).orderBy(_order_key(scalars.of_column(c.df, ordering)), ORD)
    follows, more = c.hidden(), c.hidden()
    c.df = c.df.withColumns({follows: F.lead(other.col).over(w), more: F.lead(F.lit(1)).over(w)})
    return F.col(more).isNotNull() & ~scalars.equal(target, Scalar(F.col(follows), other.kind))


def _not_sorted(c: Compiler, leaf: Leaf) -> Column:
    """Rows of a pair whose sort keys differ and whose targets are the other way round.

    Where a group has such a pair and a sort key that is a date with parts missing, all its rows with a target count.
    """
    if not isinstance(leaf.comparator, Values) or not leaf.comparator.values:
        raise RuleError("target_is_not_sorted_by needs sort keys")
    target, within = c.need(leaf.target), c.option_column(leaf, "within")
    keys, unsure = [], []
    for spec in leaf.comparator.values:
        if not isinstance(spec, dict) or not isinstance(spec.get("name"), str):
            raise RuleError("a sort key needs a name")
        key = c.need(spec["name"])
        down = str(spec.get("sort_order", "")).lower() == "desc"
        first = (str(spec.get("null_position", "")).lower() == "first") != down  # descending turns nulls too
        plain = F.struct(scalars.number(key).isNull(), scalars.number(key), scalars.text(key, None))
        if key.kind == "str":
            unsure.append((scalars.strip(key.col) != "") & dates.is_incomplete(key.col))
        keys += [key.col.isNull().desc() if first else key.col.isNull().asc(), plain.desc() if down else plain.asc()]
    rank, group = c.hidden(), c.hidden()
    c.df = c.df.withColumn(group, _key(c, within) if within else F.lit(""))
    c.df = c.df.withColumn(rank, F.dense_rank().over(Window.partitionBy(group).orderBy(*keys)))
    ranked = Window.partitionBy(group).orderBy(rank)
    before, after = ranked.rangeBetween(Window.unboundedPreceding, -1), ranked.rangeBetween(1, Window.unboundedFollowing)
    value, words = scalars.number(target), scalars.text(target, None) if target.kind == "str" else F.lit(None).cast("string")
    odd = F.when(value.isNull(), words)  # text that is no number is compared with all text
    out = two_valued(F.max(value).over(before) > value) | two_valued(F.min(value).over(after) < value)
    if target.kind == "str":
        seen = F.when(value.isNull(), F.max(words).over(before)).otherwise(F.max(odd).over(before))
        comes = F.when(value.isNull(), F.min(words).over(after)).otherwise(F.min(odd).over(after))
        out = out | two_valued(seen > words) | two_valued(comes < words)
    if not unsure:
        return out
    inverted, partial, whole = c.hidden(), c.hidden(), Window.partitionBy(group)
    c.df = c.df.withColumns({inverted: out, partial: two_valued(reduce(Column.__or__, unsure))})
    return F.col(inverted) | (target.col.isNotNull() & F.max(partial).over(whole) & F.max(inverted).over(whole))


def _gap_in_columns(c: Compiler, leaf: Leaf) -> Column:
    first = c.need(leaf.target)
    columns, name = [first], c.find(leaf.target)
    for k in itertools.count(1):
        found = c.dataset.column(f"{name}{k}")
        if found is None:
            break
        columns.append(scalars.of_column(c.df, found))
    out, gap = F.lit(False), F.lit(False)
    for s in columns:
        out, gap = out | (gap & ~scalars.is_empty(s)), gap | scalars.is_empty(s)
    return out


def _negated(operator: Callable[[Compiler, Leaf], Column]) -> Callable[[Compiler, Leaf], Column]:
    return lambda c, leaf: ~two_valued(operator(c, leaf))


def _guarded(operator: Callable[[Compiler, Leaf], Column]) -> Callable[[Compiler, Leaf], Column]:
    """The complement where the target is filled, else false."""
    return lambda c, leaf: _filled(c, leaf).isNotNull() & ~two_valued(operator(c, leaf))


OPERATORS: dict[str, Callable[[Compiler, Leaf], Column]] = {
    "exists": _exists,
    "not_exists": _negated(_exists),
    "is_empty": _empty,
    "is_not_empty": _negated(_empty),
    "equal_to": _equal(),
    "not_equal_to": _negated(_equal()),
    "equal_to_case_insensitive": _equal(True),
    "not_equal_to_case_insensitive": _negated(_equal(True)),
    "contains": _contains(),
    "does_not_contain": _negated(_contains()),
    "contains_case_insensitive": _contains(True),
    "does_not_contain_case_insensitive": _negated(_contains(True)),
    "is_contained_by": _contained(),
    "is_not_contained_by": _negated(_contained()),
    "is_contained_by_case_insensitive": _contained(True),
    "is_not_contained_by_case_insensitive": _negated(_contained(True)),
    "contains_all": _contains_all,
    "not_contains_all": _negated(_contains_all),
    "shares_no_elements_with": _disjoint,
    "is_not_ordered_subset_of": _not_ordered_subset,
    "less_than": _ordered("<"),
    "less_than_or_equal_to": _ordered("<="),
    "greater_than": _ordered(">"),
    "greater_than_or_equal_to": _ordered(">="),
    "matches_regex": _matches,
    "does_not_match_regex": _negated(_matches),
    "not_matches_regex": _not_full,
    "longer_than": lambda c, leaf: F.length(_filled(c, leaf)) > int(float(c.literal(leaf))),
    "starts_with": _starts,
    "prefix_not_equal_to": _guarded(_starts),
    "prefix_equal_to": lambda c, leaf: _prefix(c, leaf) == scalars.text(c.scalar(leaf), None),
    "not_prefix_matches_regex": lambda c, leaf: ~_prefix(c, leaf).rlike(patterns.port(c.literal(leaf))),
    "prefix_is_not_contained_by": _not_in(_prefix),
    "suffix_is_not_contained_by": _not_in(_suffix),
    "ends_with": lambda c, leaf: _filled(c, leaf).endswith(c.literal(leaf)),
    "suffix_matches_regex": lambda c, leaf: _suffix(c, leaf).rlike(patterns.port(c.literal(leaf))),
    "not_suffix_matches_regex": lambda c, leaf: ~_suffix(c, leaf).rlike(patterns.port(c.literal(leaf))),
    "date_equal_to": _date("="),
    "date_not_equal_to": _date("!="),
    "date_less_than": _date("<"),
    "date_less_than_or_equal_to": _date("<="),
    "date_greater_than": _date(">"),
    "date_greater_than_or_equal_to": _date(">="),
    "is_complete_date": _date_state("complete"),
    "is_incomplete_date": _date_state("incomplete"),
    "invalid_date": _date_state("invalid"),
    "invalid_duration": _bad_duration,
    "target_is_not_sorted_by": _not_sorted,
    "empty_within_except_last_row": _empty_but_last,
    "does_not_have_next_corresponding_record": _next_differs,
    "not_present_on_multiple_rows_within": _once,
    "inconsistent_enumerated_columns": _gap_in_columns,
    "is_not_unique_set": lambda c, leaf: _set_count(c, leaf) > 1,
    "is_unique_set": lambda c, leaf: _set_count(c, leaf) == 1,
    "is_not_unique_relationship": _relationship,
    "is_inconsistent_across_dataset": _inconsistent,
    "does_not_equal_string_part": _string_part,
}


def wants_presence(condition: Condition, rule_type: str = "record_data", sensitivity: str = "record") -> bool:
    """Whether ``exists`` asks for the column and not for the cell."""
    by_rule = sensitivity == "dataset" and rule_type in ("record_data", "domain_presence")
    return by_rule or any(leaf.operator in RELATIONSHIP for leaf in leaves(condition))


def violations(dataset: Dataset, condition: Condition, presence: bool | None = None) -> DataFrame:
    """The table with __mask: true on rows that violate."""
    compiler = Compiler(dataset, wants_presence(condition) if presence is None else presence)
    mask = compiler.tree(condition)
    return compiler.df.withColumn("__mask", mask)
