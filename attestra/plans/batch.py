"""Issues of rules on a table: one scan for all rules that need no operations of their own."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import scalars
from attestra.functions.positions import with_position
from attestra.model import ORD, SOURCE_ROW, AnyOf, ColumnRef, Dataset, Leaf, Rule, leaves
from attestra.operators.conditions import Compiler, wants_presence

ISSUE_COLUMNS = ["rule_id", "dataset", "domain", "row", "variables", "message", "usubjid", "seq"]


def reported_variables(ds: Dataset, rule: Rule) -> list[str]:
    """The output variables of the rule, or its targets and the columns they are compared with."""
    if rule.output_variables:
        return [ds.column(v) or v for v in rule.output_variables]
    names: list[str] = []
    for leaf in leaves(rule.conditions):
        shown = [leaf.target, leaf.comparator.name] if isinstance(leaf.comparator, ColumnRef) and ds.column(leaf.comparator.name) else [leaf.target]
        names += [n for n in (ds.column(s) or s for s in shown) if n and n not in names]
    return names


def subject_of(ds: Dataset) -> Column:
    found = ds.column("USUBJID")
    return scalars.text(scalars.of_column(ds.df, found), None) if found else F.lit(None).cast("string")


def sequence_of(ds: Dataset) -> Column:
    """The first sequence number of the row that is not null: the domain's own column, then any other."""
    own = f"{ds.domain or ''}SEQ"
    names = [c for c in ds.columns if c == own] + [c for c in ds.columns if c.endswith("SEQ") and c != own]
    return F.coalesce(*[scalars.text(scalars.of_column(ds.df, c), None) for c in names]) if names else F.lit(None).cast("string")


def _signature(ds: Dataset, names: Sequence[str]) -> Column:
    """The values of the reported variables, which tell the groups of a group rule apart."""
    shown = [scalars.text(scalars.of_column(ds.df, ds.column(n)), None) if ds.column(n) else F.lit(None).cast("string") for n in names]
    return F.array(*[F.concat(F.lit(f"{n.upper()}="), F.coalesce(c, F.lit(""))) for n, c in zip(names, shown, strict=True)]).cast("array<string>")


def _failing(compiler: Compiler, rule: Rule) -> Column:
    """The targets of those parts of an ``any`` of plain parts that hold; the others' are left out."""
    parts = [(part, compiler.dataset.column(part.target)) for part in rule.conditions.parts]
    return F.array_distinct(F.array_compact(F.array(*[F.when(compiler.leaf(part), F.lit(name)) for part, name in parts if name]).cast("array<string>")))


def batch_issues(ds: Dataset, rules: Sequence[Rule], narrowed: Collection[str] = ()) -> DataFrame:
    """One row for each row of the table and rule that it violates; the table is read once.

    All conditions are columns of one projection. Only rows' order keys and issues are numbered, and the
    rules that hold are exploded afterwards. Of a group rule the first issue of each group stays. The rules of
    ``narrowed`` name only the targets of the parts of an ``any`` that hold.
    """
    compiler, found, grouped = Compiler(ds), [], [r.id for r in rules if r.sensitivity == "group"]
    for rule in rules:
        compiler.presence = wants_presence(rule.conditions, rule.rule_type, rule.sensitivity)
        mask = compiler.tree(rule.conditions)
        names = reported_variables(ds, rule)
        plain_any = isinstance(rule.conditions, AnyOf) and all(isinstance(part, Leaf) for part in rule.conditions.parts)
        shown = _failing(compiler, rule) if rule.id in narrowed and plain_any else F.array(*map(F.lit, names)).cast("array<string>")
        said = {"rule_id": F.lit(rule.id), "variables": shown, "message": F.lit(rule.message)}
        said["signature"] = _signature(ds, names) if rule.id in grouped else F.lit(None).cast("array<string>")
        found.append(F.when(mask, F.struct(*[c.alias(n) for n, c in said.items()])))
    issues = F.array_compact(F.array(*found)).alias("issues")
    rows = compiler.df.select(ORD, *[c for c in (SOURCE_ROW,) if c in ds.df.columns], subject_of(ds).alias("usubjid"), sequence_of(ds).alias("seq"), issues)
    if SOURCE_ROW in rows.columns:
        placed = rows.where(F.size("issues") > 0).withColumn("row", F.col(SOURCE_ROW).cast("long"))
    else:
        some = F.size("issues") > 0
        rows = rows.withColumns({c: F.when(some, F.col(c)) for c in ("usubjid", "seq", "issues")})
        placed = with_position(rows, [ORD], "row").where("issues IS NOT NULL")
    out = placed.select(F.lit(ds.name).alias("dataset"), F.lit(ds.domain).alias("domain"), "row", "usubjid", "seq", F.explode("issues").alias("issue"))
    out = out.select("issue.rule_id", "dataset", "domain", "row", "issue.variables", "issue.message", "usubjid", "seq", "issue.signature")
    if grouped:
        kept = F.struct(*ISSUE_COLUMNS)
        firsts = out.where(F.col("rule_id").isin(grouped)).groupBy("rule_id", "signature").agg(F.min_by(kept, "row").alias("x")).select("x.*")
        out = out.where(~F.col("rule_id").isin(grouped)).drop("signature").unionByName(firsts) if len(grouped) < len(rules) else firsts
    return out.select(*ISSUE_COLUMNS)
