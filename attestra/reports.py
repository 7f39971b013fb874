"""Reports of a validation: JSON, CSV and log lines for what a person reads, Parquet for large runs."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator, Sequence
from itertools import groupby
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.model import Result
from attestra.plans.engine import Report

# Fixed format of the issues' CSV.
CSV_COLUMNS = ["rule_id", "status", "dataset", "domain", "row", "variables", "message", "error_count", "usubjid", "seq", "skip_reason"]


def summary(results: Sequence[Result]) -> dict[str, int]:
    counts = {s: sum(r.status == s for r in results) for s in ("passed", "failed", "skipped")}
    return {"total": len(results), **counts, "errors": sum(r.error_count for r in results)}


def _in_order(report: Report) -> DataFrame:
    """Issues with __k, the number of their result, sorted by it and by row."""
    spark = report.issues.sparkSession
    numbers = [(k, r.rule_id, r.dataset, r.status, r.error_count) for k, r in enumerate(report.results) if r.error_count]
    known = spark.createDataFrame(numbers, "__k int, rule_id string, dataset string, status string, error_count long")  # one row for each rule and table
    return report.issues.join(F.broadcast(known), ["rule_id", "dataset"]).orderBy("__k", "row")


def _by_rule(report: Report) -> Iterator[tuple[Result, Iterator]]:
    """Results with their issues, streamed in order from the cluster by one job."""
    groups = groupby(_in_order(report).toLocalIterator(), lambda r: r["__k"])
    ready = next(groups, None)
    for k, result in enumerate(report.results):
        if ready is not None and ready[0] == k:
            yield result, ready[1]
            ready = next(groups, None)
        else:
            yield result, iter(())


def write_issues(issues: DataFrame, path: str) -> None:
    """The whole issues table as Parquet, by rule."""
    issues.write.mode("overwrite").partitionBy("rule_id").parquet(path)


def write_json(report: Report, out: TextIO, metadata: dict[str, str] | None = None) -> None:
    """The report as one JSON document, written as the issues arrive."""
    said = lambda x: json.dumps(x, ensure_ascii=False)
    out.write(f'{{"metadata": {said(metadata or {})}, "summary": {said(summary(report.results))}, "results": [')
    for k, (result, rows) in enumerate(_by_rule(report)):
        head = {"rule_id": result.rule_id, "dataset": result.dataset, "status": result.status, "message": result.message, "error_count": result.error_count, "skip_reason": result.skip_reason or None, "provenance": result.provenance}
        out.write((",\n" if k else "\n") + said(head)[:-1] + ', "errors": [')
        for i, r in enumerate(rows):
            issue = {"dataset": r["dataset"], "domain": r["domain"], "row": r["row"], "variables": list(r["variables"] or []), "message": r["message"], "usubjid": r["usubjid"], "seq": r["seq"]}
            out.write((", " if i else "") + said(issue))
        out.write("]}")
    out.write("\n]}\n")


def safe_cell(value: object) -> str:
    """Text that a spreadsheet would take for a formula gets an apostrophe."""
    said = "" if value is None else str(value)
    return f"'{said}" if said[:1] in ("=", "+", "-", "@", "\t", "\r") else said


def write_csv(report: Report, out: TextIO) -> None:
    """One line for each issue, and one for each result without any, written as the issues arrive."""
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(CSV_COLUMNS)
    for result, rows in _by_rule(report):
        some = False
        for r in rows:
            some = True
            cells = [result.rule_id, result.status, r["dataset"], r["domain"], r["row"], "|".join(r["variables"] or []), r["message"], result.error_count, r["usubjid"], r["seq"], ""]
            writer.writerow([safe_cell(c) if not isinstance(c, int) else c for c in cells])
        if not some:
            writer.writerow([safe_cell(c) for c in (result.rule_id, result.status, result.dataset, "", "", "", result.message, "0", "", "", result.skip_reason)])


def csv_rows(report: Report) -> DataFrame:
    """The lines of the CSV report as a DataFrame of texts, for a report that Spark writes in parts."""
    spark = report.issues.sparkSession
    guarded = lambda c: F.when(c.rlike("^[=+@\\t\\r-]"), F.concat(F.lit("'"), c)).otherwise(F.coalesce(c, F.lit("")))
    shown = {"variables": F.array_join("variables", "|"), "skip_reason": F.lit("")}
    issues = _in_order(report).select("__k", *[(F.col(c).cast("string") if c in ("row", "error_count") else guarded(shown.get(c, F.col(c)).cast("string"))).alias(c) for c in CSV_COLUMNS])
    others = [(k, *map(safe_cell, (r.rule_id, r.status, r.dataset, "", "", "", r.message, "0", "", "", r.skip_reason))) for k, r in enumerate(report.results) if not r.error_count]
    rest = spark.createDataFrame(others, "__k int, " + ", ".join(f"`{c}` string" for c in CSV_COLUMNS))
    return issues.unionByName(rest).orderBy("__k", F.expr("try_cast(row AS BIGINT)")).select(*CSV_COLUMNS)


def write_csv_parts(report: Report, path: str) -> None:
    """The CSV report as a folder of parts, each with the header: of any size, and never through the driver."""
    csv_rows(report).write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


def _line(**values: object) -> str:
    def shown(v: object) -> str:
        said = "".join(c if c.isprintable() else f"\\u{ord(c):04x}" for c in str(v))
        return f'"{said}"' if " " in said or '"' in said else said

    return " ".join(f"{k}={shown(v)}" for k, v in values.items())


def write_log(report: Report, out: TextIO) -> None:
    lines = [_line(event="summary", **summary(report.results))]
    lines += [_line(event="result", rule=r.rule_id, dataset=r.dataset, status=r.status, errors=r.error_count, reason=r.skip_reason or "-") for r in report.results]
    out.write("\n".join(lines) + "\n")


def counts_by_variable(issues: DataFrame) -> DataFrame:
    """(rule_id, dataset, variable, issues): how often each variable is named."""
    return issues.select("rule_id", "dataset", F.explode("variables").alias("variable")).groupBy("rule_id", "dataset", "variable").agg(F.count("*").alias("issues"))
