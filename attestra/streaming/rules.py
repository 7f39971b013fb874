"""Row rules on a stream (an extension): every record is judged by itself, so no state is kept.

Rules about groups, order or other tables need the whole table and are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.model import Dataset, Rule, RuleError, leaves
from attestra.operators.conditions import Compiler
from attestra.plans.batch import reported_variables, sequence_of, subject_of

STATEFUL = {
    "target_is_not_sorted_by", "empty_within_except_last_row", "does_not_have_next_corresponding_record", "not_present_on_multiple_rows_within",
    "is_not_unique_set", "is_unique_set", "is_not_unique_relationship", "is_inconsistent_across_dataset",
}


def stream_issues(name: str, stream: DataFrame, rules: Sequence[Rule], domain: str | None = None) -> DataFrame:
    """Issues of a streaming table: rule_id, dataset, variables, message, usubjid, seq and the record's own columns as ``record``."""
    ds = Dataset(name, stream, domain or name)
    compiler, found = Compiler(ds), []
    for rule in rules:
        needs = [leaf.operator for leaf in leaves(rule.conditions) if leaf.operator in STATEFUL]
        if needs or rule.operations or rule.match_datasets:
            raise RuleError(f"{rule.id} needs the whole table", "needs_whole_table")
        names = F.array(*[F.lit(n) for n in reported_variables(ds, rule)]).cast("array<string>")
        found.append(F.when(compiler.tree(rule.conditions), F.struct(F.lit(rule.id).alias("rule_id"), names.alias("variables"), F.lit(rule.message).alias("message"))))
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in ds.columns]))
    rows = compiler.df.select(F.lit(name).alias("dataset"), subject_of(ds).alias("usubjid"), sequence_of(ds).alias("seq"), record.alias("record"), F.explode(F.array_compact(F.array(*found))).alias("issue"))
    return rows.select("issue.rule_id", "dataset", "issue.variables", "issue.message", "usubjid", "seq", "record")
