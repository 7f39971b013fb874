"""Comparing issues with expected ones as multisets, by joins of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The identity of an issue, strict and relaxed.
STRICT = ("rule_id", "dataset", "row", "variables", "usubjid", "seq")
RELAXED = ("rule_id", "dataset", "row")
BUCKETS = ("match", "match_relaxed", "missing", "extra", "both_differ", "no_expectation", "not_run", "empty_match")


def _plain(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c.cast("string"))), F.lit(""))


def issue_keys(issues: DataFrame, identity: Sequence[str] = STRICT) -> DataFrame:
    """Issues as texts that compare: trimmed, in capitals, variables sorted, nulls empty."""
    out = []
    for name in identity:
        c = F.col(name)
        if dict(issues.dtypes)[name].startswith("array"):
            c = F.array_join(F.array_sort(F.transform(c, lambda v: F.upper(F.trim(v)))), "|")
        out.append(_plain(c).alias(name))
    return issues.select(*out)


def difference(found: DataFrame, expected: DataFrame, identity: Sequence[str] = STRICT) -> DataFrame:
    """Identity columns with n_found and n_expected of every issue that differs in number."""
    left = issue_keys(found, identity).groupBy(*identity).agg(F.count("*").alias("n_found"))
    right = issue_keys(expected, identity).groupBy(*identity).agg(F.count("*").alias("n_expected"))
    both = left.join(right, list(identity), "full").fillna(0, ["n_found", "n_expected"])
    return both.where("n_found <> n_expected")


def score(found: DataFrame, expected: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """(rule_id, bucket, found, expected): one row for each rule.

    ``cases``: rule_id and ran (Boolean) of every rule that was to run; rules that are only in the
    issues count as run. A rule matches strictly, or relaxed where only details of an issue differ.
    """
    rule = F.upper(F.trim("rule_id")).alias("rule_id")
    n_found, n_expected = found.groupBy(rule).agg(F.count("*").alias("found")), expected.groupBy(rule).agg(F.count("*").alias("expected"))
    counts = n_found.join(n_expected, "rule_id", "full")
    if cases is not None:
        counts = counts.join(cases.select(rule, "ran"), "rule_id", "full")
    else:
        counts = counts.withColumn("ran", F.lit(True))
    counts = counts.fillna(0, ["found", "expected"]).withColumn("ran", F.coalesce("ran", F.lit(True)))
    sides = lambda d, name: d.groupBy("rule_id").agg(F.bool_or(F.col("n_found") > F.col("n_expected")).alias(f"{name}_extra"), F.bool_or(F.col("n_found") < F.col("n_expected")).alias(f"{name}_missing"))
    joined = counts.join(sides(difference(found, expected), "strict"), "rule_id", "left").join(sides(difference(found, expected, RELAXED), "relaxed"), "rule_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    bucket = (
        F.when(~F.col("ran"), "not_run").when((F.col("found") == 0) & (F.col("expected") == 0), "empty_match").when(~yes("strict_extra") & ~yes("strict_missing"), "match").when(~yes("relaxed_extra") & ~yes("relaxed_missing"), "match_relaxed")
        .when((F.col("expected") == 0), "no_expectation").when(yes("relaxed_extra") & yes("relaxed_missing"), "both_differ").when(yes("relaxed_missing"), "missing").otherwise("extra")
    )
    return joined.select("rule_id", bucket.alias("bucket"), "found", "expected")


def scoreboard(scores: DataFrame) -> DataFrame:
    """(bucket, rules, share) over all rules."""
    total = scores.count()
    return scores.groupBy("bucket").agg(F.count("*").alias("rules")).withColumn("share", F.round(F.col("rules") / F.lit(max(total, 1)), 4))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rule_id, before, after) of rules whose bucket changed between two scores."""
    old, new = before.select("rule_id", F.col("bucket").alias("before")), after.select("rule_id", F.col("bucket").alias("after"))
    return old.join(new, "rule_id", "full").where(~F.col("before").eqNullSafe(F.col("after")))


# How a generated case can end, in the order in which they are asked.
CASE_CLASSES = {
    "EXPECTED_OUTPUT_MISSING": "n_expected IS NULL",
    "ACTUAL_OUTPUT_MISSING": "n_found IS NULL AND NOT skipped",
    "ACTUAL_MIXED_SKIPPED_AND_ISSUES": "skipped AND n_found > 0",
    "ACTUAL_SKIPPED_BY_CORE": "skipped",
    "NEGATIVE_DID_NOT_TRIGGER": "n_expected > 0 AND n_found = 0",
    "POSITIVE_TRIGGERED_UNEXPECTEDLY": "n_expected = 0 AND n_found > 0",
    "PARTIAL_STRUCTURAL_CHECK": "n_expected <> n_found AND n_described < n_expected AND n_matched = n_described",
    "ISSUE_COUNT_MISMATCH": "n_expected <> n_found",
    "STRUCTURAL_MISMATCH": "n_matched < n_described",
    "PASS": "true",
}


def classified(cases: DataFrame) -> DataFrame:
    """``cases`` with class: the first of ``CASE_CLASSES`` that holds.

    Columns: rule_id, case_id, n_expected (issues wanted; null: no expectation), n_found (null: no report), skipped,
    n_described (issues whose details are given) and n_matched (those found with their details).
    """
    out = F.lit(None).cast("string")
    for name, condition in reversed(CASE_CLASSES.items()):
        out = F.when(F.expr(condition), name).otherwise(out)
    return cases.withColumn("class", out)


def class_counts(cases: DataFrame) -> DataFrame:
    """(class, cases, rules) of classified cases."""
    return cases.groupBy("class").agg(F.count("*").alias("cases"), F.count_distinct("rule_id").alias("rules"))


def gate(cases: DataFrame, allow_skipped: bool = False) -> bool:
    """Whether there are cases and all of them passed, or were skipped where that is allowed."""
    fine = ["PASS", *(["ACTUAL_SKIPPED_BY_CORE"] if allow_skipped else [])]
    row = cases.agg(F.count("*").alias("n"), F.count_if(F.col("class").isin(fine)).alias("fine")).first()
    return row["n"] > 0 and row["n"] == row["fine"]
