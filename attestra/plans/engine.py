"""Validation: rules and tables in, results and one DataFrame of issues out."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.positions import checkpointed
from attestra.model import ORD, All, AnyOf, Condition, Dataset, Leaf, MissingColumn, Not, NoValue, Result, Rule, RuleError, Terms, Values, leaves
from attestra.operators import joins, operations
from attestra.plans.batch import ISSUE_COLUMNS, batch_issues
from attestra.plans.matching import matched
from attestra.plans.post import once_for_dataset
from attestra.plans.rules import parse_condition
from attestra.plans.selection import for_standard, in_scope, select_rules, unsupported
from attestra.plans.tables import domain_tables
from attestra.sources.metadata import Define, Terminology

#: Rules that are evaluated in one projection.
BATCH = 40


@dataclass
class Knowledge:
    """Metadata that rules may refer to."""

    define: Define | None = None
    terminology: Terminology | None = None
    dictionaries: DataFrame | None = None
    codelists: DataFrame | None = None
    codelist_dates: dict[str, list[str]] = field(default_factory=dict)
    #: By domain, the standard's lists of variables: columns, required, expected, permissible, model and lists by role, and labels by variable.
    library: dict[str, dict[str, Any]] = field(default_factory=dict)


@dataclass
class Report:
    results: list[Result]
    issues: DataFrame


def with_codelists(condition: Condition, knowledge: Knowledge) -> Condition:
    """Membership tests without a list get the codelist or dictionary that their options name."""
    if isinstance(condition, Not):
        return Not(with_codelists(condition.part, knowledge))
    if isinstance(condition, All | AnyOf):
        return type(condition)(tuple(with_codelists(p, knowledge) for p in condition.parts))
    if not isinstance(condition.comparator, NoValue) or "contained_by" not in condition.operator:
        return condition
    options, terms = condition.options, None
    if "ct_codelist" in options and knowledge.terminology:
        terms = knowledge.terminology.find(str(options["ct_codelist"]))
    elif "define_codelist" in options and knowledge.define:
        terms = knowledge.define.codelist(str(options["define_codelist"]))
    elif "dictionary" in options and knowledge.dictionaries is not None:
        of_one = knowledge.dictionaries.where(F.col("dictionary") == str(options["dictionary"])).select("term")
        return Leaf(condition.target, condition.operator, Terms(of_one), options)  # of any size: joined, never collected
    return condition if terms is None else Leaf(condition.target, condition.operator, Values(tuple(terms)), options)


def operated(rule: Rule, ds: Dataset, datasets: Sequence[Dataset], knowledge: Knowledge) -> Dataset:
    context = operations.Context(datasets, parse_condition, knowledge.codelists, knowledge.codelist_dates, knowledge.library)
    for spec in rule.operations:
        called = operations.word(spec, "operator", "operation") or operations.word(spec, "name") or ""
        if called.lower().replace(" ", "_") in joins.KINDS:
            other = context.find(operations.word(spec, "right", "with", "dataset", "match") or "")
            if other is None:
                raise RuleError(f"no table for {called}", "missing_dataset")
            left_by = operations.words(spec, "left_by", "left_keys", "on", "by", "keys")
            ds = joins.join(ds, other, called.lower(), left_by, operations.words(spec, "right_by", "right_keys") or left_by, spec.get("prefix"))
        else:
            ds = operations.apply(ds, spec, context)
    return ds


def _tables(rule: Rule, spark: SparkSession, datasets: Sequence[Dataset], knowledge: Knowledge) -> list[Dataset]:
    if rule.rule_type in ("domain_presence", "json_schema"):
        return domain_tables(rule.rule_type, spark, datasets)
    scoped = [d for d in datasets if in_scope(rule, d)]
    wanted = [operations.word(s, "dataset") for s in rule.operations if operations.word(s, "operator", "name") and not s.get("group")]
    named = [d for d in scoped if any(w and w.upper() in (d.name.upper(), (d.domain or "").upper()) for w in wanted[:1])]
    return domain_tables(rule.rule_type, spark, named or scoped, knowledge.define, knowledge.library)


def _counts_only(rule: Rule) -> bool:
    """A rule of whole tables that counts variables, or records without groups, has one issue for a table."""
    counted = lambda s: (operations.word(s, "operator", "operation") or operations.word(s, "name") or "").lower()
    return rule.sensitivity == "dataset" and any(counted(s) == "variable_count" or (counted(s) == "record_count" and not operations.first_of(s, *operations.BY)) for s in rule.operations)


#: Columns of issues as SQL types.
ISSUES = "rule_id string, dataset string, domain string, row long, variables array<string>, message string, usubjid string, seq string"


def _made_up(spark: SparkSession, rule: Rule, name: str, domain: str | None, row: int | None, variables: list[str]) -> DataFrame:
    return spark.createDataFrame([(rule.id, name, domain, row, variables, rule.message, None, None)], ISSUES)


def rule_issues(rule: Rule, spark: SparkSession, datasets: Sequence[Dataset], knowledge: Knowledge, absent: str = "", narrowed: Collection[str] = ()) -> list[tuple[Dataset, DataFrame]]:
    """The rule's issues on each of its tables, lazily; a table that lacks a column is left out if there are others.

    ``absent`` column: such a table has one issue, at row 0. ``absent`` table: where no table is in scope, the first
    one that the scope names has one issue.
    """
    rule = replace(rule, conditions=with_codelists(rule.conditions, knowledge))
    out, error = [], None
    for ds, joined in matched(rule, _tables(rule, spark, datasets, knowledge), datasets):
        try:
            issues = batch_issues(operated(rule, joined, datasets, knowledge), [rule], narrowed)
        except RuleError as e:
            if absent == "column" and isinstance(e, MissingColumn):
                out.append((ds, _made_up(spark, rule, ds.name, ds.domain, 0, [e.column])))
                continue
            error = e
            if e.reason != "missing_column":
                raise
            continue
        out.append((ds, once_for_dataset(issues) if _counts_only(rule) else issues))
    if not out and error is not None:
        raise error
    named = operations.words(rule.domains, "Include", "include") if isinstance(rule.domains, dict) else []
    if not out and absent == "table" and named:
        out.append((Dataset(named[0], spark.createDataFrame([], f"{ORD} long"), named[0]), _made_up(spark, rule, named[0], named[0], None, [])))
    return out


def validate(
    spark: SparkSession, rules: Sequence[Rule], datasets: Sequence[Dataset], knowledge: Knowledge | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (), standard: str | None = None, version: str | None = None, hooks: dict[str, Any] | None = None, absent: dict[str, str] | None = None, narrowed: Collection[str] = ()
) -> Report:
    """Runs the rules and counts their issues with one job for each batch of rules that share a table.

    Rules that need nothing but one table's rows go through one scan together. ``hooks`` may give a
    function of the issues DataFrame for a rule's id; ``absent`` says by rule id whether a missing column or table is an
    issue, and ``narrowed`` lists rules that name only the targets that fail (see ``rule_issues``, ``batch_issues``).
    """
    knowledge, hooks, absent = knowledge or Knowledge(), hooks or {}, absent or {}
    chosen, results = select_rules(rules, include, exclude)
    chosen, outside = for_standard(chosen, standard, version, asked_for=bool(include))
    results += outside
    frames: list[DataFrame] = []
    ran: list[tuple[Rule, str]] = []
    simple: dict[str, list[Rule]] = {}
    by_name = {d.name: d for d in datasets}
    for rule in chosen:
        reason = unsupported(rule)
        if reason:
            results.append(Result(rule.id, "", "skipped", rule.message, skip_reason=reason))
            continue
        plain = rule.rule_type == "record_data" and rule.sensitivity == "record" and not rule.operations and not rule.match_datasets and not (rule.id in hooks or rule.id in absent or rule.id in narrowed)
        if plain and all(not isinstance(leaf.comparator, NoValue) or "contained_by" not in leaf.operator for leaf in leaves(rule.conditions)):
            tables = [d for d in datasets if in_scope(rule, d)]
            fits = [d for d in tables if all(d.column(leaf.target) for leaf in leaves(rule.conditions))]
            if fits and len(fits) == len(tables):
                for d in fits:
                    simple.setdefault(d.name, []).append(rule)
                    ran.append((rule, d.name))
                continue
        try:
            found = rule_issues(rule, spark, datasets, knowledge, absent.get(rule.id, ""), narrowed)
        except RuleError as error:
            results.append(Result(rule.id, "", "skipped", str(error), skip_reason=error.reason))
            continue
        if not found:
            results.append(Result(rule.id, "", "skipped", "no table is in scope", skip_reason="no_dataset"))
        for ds, issues in found:
            frames.append(hooks[rule.id](issues) if rule.id in hooks else issues)
            ran.append((rule, ds.name))
    for name, some in simple.items():
        for at in range(0, len(some), BATCH):
            try:
                frames.append(batch_issues(by_name[name], some[at : at + BATCH]))
            except RuleError:
                for rule in some[at : at + BATCH]:  # one rule can't be compiled: the others still run
                    try:
                        frames.append(batch_issues(by_name[name], [rule]))
                    except RuleError as error:
                        ran.remove((rule, name))
                        results.append(Result(rule.id, name, "skipped", str(error), skip_reason=error.reason))
    shape = [F.col(c).cast("array<string>" if c == "variables" else "long" if c == "row" else "string").alias(c) for c in ISSUE_COLUMNS]
    empty = spark.createDataFrame([], ISSUES)
    issues = checkpointed(reduce(DataFrame.unionByName, [f.select(*shape) for f in frames], empty))  # counted, reported and shown: found once
    counts = {(r["rule_id"], r["dataset"]): r["count"] for r in issues.groupBy("rule_id", "dataset").count().collect()}  # one row for each rule and table
    for rule, name in ran:
        n = counts.get((rule.id, name), 0)
        results.append(Result(rule.id, name, "failed" if n else "passed", rule.message, issues.where((F.col("rule_id") == rule.id) & (F.col("dataset") == name)), n))
    order = {r.id: i for i, r in enumerate(rules)}
    return Report(sorted(results, key=lambda r: (order.get(r.rule_id, len(order)), r.dataset)), issues)
