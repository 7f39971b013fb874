"""Command line: ``python -m attestra.cli validate --rules DIR --data DIR``, and the catalog tools."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from attestra import reports
from attestra.catalog import rules as catalog
from attestra.plans.engine import Knowledge, validate
from attestra.plans.rules import load_rules
from attestra.session import local_session
from attestra.sources import metadata, tables
from attestra.sources.transport import read_transport


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="attestra")
    commands = top.add_subparsers(dest="command", required=True)
    mapped = commands.add_parser("map", help="the best match of each catalog rule in another catalog, and how far each can be converted")
    mapped.add_argument("--catalog", required=True, help="CSV, or an XML configuration")
    mapped.add_argument("--other", required=True)
    mapped.add_argument("--output", required=True, help="folder of CSV parts")
    gathered = commands.add_parser("gather", help="all rules of a tree of JSON and YAML files and archives")
    gathered.add_argument("--rules", required=True)
    gathered.add_argument("--output", required=True, help="folder of Parquet parts")
    run = commands.add_parser("validate", help="run rules on tables")
    run.add_argument("--rules", nargs="+", required=True)
    run.add_argument("--data", nargs="+", required=True, help="folders, or CSV, JSON, Parquet and transport files")
    run.add_argument("--include", nargs="*", default=[])
    run.add_argument("--exclude", nargs="*", default=[])
    run.add_argument("--standard")
    run.add_argument("--version")
    run.add_argument("--define")
    run.add_argument("--terminology")
    run.add_argument("--dictionary")
    run.add_argument("--library", help="JSON: by domain, the standard's lists of variables")
    run.add_argument("--format", nargs="+", choices=["json", "csv", "log", "csv-parts", "parquet"], default=["json"])
    run.add_argument("--output", default=".")
    run.add_argument("--fail-on-issues", action="store_true")
    run.add_argument("--fail-on-skipped", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "map":
        spark = local_session()
        ours, theirs = ((catalog.read_config if p.lower().endswith(".xml") else catalog.read_catalog)(spark, p) for p in (args.catalog, args.other))
        catalog.classify(ours, catalog.map_rules(ours, theirs)).write.mode("overwrite").csv(args.output, header=True)
        return 0
    if args.command == "gather":
        catalog.read_rule_files(local_session(), args.rules).write.mode("overwrite").parquet(args.output)
        return 0
    if args.include and args.exclude:
        print("ids can be included or excluded, not both", file=sys.stderr)
        return 2
    spark, found, warnings = local_session(), [], []
    for path in args.data:
        kind = Path(path).suffix.lower()
        if kind in (".csv", ".parquet"):
            found.append((tables.read_csv if kind == ".csv" else tables.read_parquet)(spark, path))
        elif kind == ".json":
            found += tables.read_package(spark, path)
        elif kind == ".xpt":
            found += read_transport(spark, path)
        else:
            more, said = tables.scan_folder(spark, path)
            found, warnings = found + more, warnings + said
    knowledge = Knowledge(
        metadata.read_define(spark, args.define) if args.define else None, metadata.read_terminology(spark, args.terminology) if args.terminology else None, metadata.read_dictionaries(spark, args.dictionary) if args.dictionary else None,
        library=metadata.read_library(spark, args.library) if args.library else {},
    )
    report = validate(spark, load_rules(args.rules), found, knowledge, args.include, args.exclude, args.standard, args.version)
    out = Path(args.output)
    out.mkdir(parents=True, exist_ok=True)
    for kind in args.format:
        if kind in ("csv-parts", "parquet"):
            {"csv-parts": reports.write_csv_parts, "parquet": lambda r, path: reports.write_issues(r.issues, path)}[kind](report, str(out / f"report-{kind}"))
            continue
        with (out / f"report.{kind}").open("w", encoding="utf-8") as file:
            {"json": reports.write_json, "csv": reports.write_csv, "log": reports.write_log}[kind](report, file)
    for said in warnings:
        print(said, file=sys.stderr)
    counts = reports.summary(report.results)
    print(" ".join(f"{k}={v}" for k, v in counts.items()))
    return int((args.fail_on_issues and counts["failed"] > 0) or (args.fail_on_skipped and counts["skipped"] > 0))


if __name__ == "__main__":
    sys.exit(main())
