"""Whole runs: a small study, its issues, reports, scores and catalogs."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from attestra import reports
from attestra.catalog import rules as catalog
from attestra.cli import main
from attestra.harness import score
from attestra.model import ORD, Dataset
from attestra.plans.engine import Knowledge, validate
from attestra.plans.rules import parse_rule
from attestra.sources.metadata import Terminology, parse_define


def rule(id, check, **more):
    return parse_rule({"Core": {"Id": id}, "Rule Type": "Record Data", "Sensitivity": "Record", "Check": check, "Outcome": {"Message": f"{id} message"}, **more})


@pytest.fixture(scope="module")
def study(spark):
    ae = spark.createDataFrame([(1, "s1", 1, "MILD", 5.0), (2, "s1", 2, "BAD", 9.0), (3, "s2", 1, None, 7.0), (4, "s3", 1, "SEVERE", 1.0)], f"{ORD} long, USUBJID string, AESEQ long, AESEV string, AEVAL double")
    dm = spark.createDataFrame([(1, "s1", "F"), (2, "s2", "X")], f"{ORD} long, USUBJID string, SEX string")
    return [Dataset("AE", ae, "AE", "Events", "ae.csv"), Dataset("DM", dm, "DM", "Subjects", "dm.csv")]


RULES = [
    rule("R1", {"name": "AESEV", "operator": "is_not_contained_by", "ct_codelist": "SEV"}, Scope={"Domains": {"Include": ["AE"]}}),
    rule("R2", {"all": [{"name": "SEX", "operator": "is_not_contained_by", "value": ["F", "M"]}]}, Scope={"Domains": {"Include": ["DM"]}}),
    rule("R3", {"name": "USUBJID", "operator": "exists"}, Operations=[{"operator": "anti_join", "dataset": "AE", "right": "DM", "on": ["USUBJID"]}], Scope={"Domains": {"Include": ["AE"]}}),
    rule("R4", {"all": [{"name": "M", "operator": "greater_than", "value": 8}, {"name": "K", "operator": "equal_to", "value": 1}]}, Operations=[{"operator": "sort", "by": ["USUBJID"]}, {"operator": "aggregate", "by": ["USUBJID"], "function": "max", "source_column": "AEVAL", "as": "M"}, {"operator": "row_number", "by": ["USUBJID"], "as": "K"}], Scope={"Domains": {"Include": ["AE"]}}),
    rule("R5", {"name": "DM.SEX", "operator": "equal_to", "value": "X", "value_is_literal": True}, **{"Match Datasets": [{"Name": "DM", "Keys": ["USUBJID"]}], "Scope": {"Domains": {"Include": ["AE"]}}}),
    rule("R6", {"name": "LB", "operator": "not_exists"}, **{"Rule Type": "Domain Presence Check", "Sensitivity": "Dataset"}),
    rule("R7", {"all": [{"name": "variable_name", "operator": "equal_to", "value": "AEVAL", "value_is_literal": True}]}, **{"Rule Type": "Variable Metadata Check", "Scope": {"Domains": {"Include": ["AE"]}}}),
    rule("R8", {"name": "record_count", "operator": "less_than", "value": 3}, **{"Rule Type": "Dataset Metadata Check", "Sensitivity": "Dataset"}),
    rule("R9", {"name": "AESEV", "operator": "made_up"}),
    rule("R10", {"name": "NOWHERE", "operator": "equal_to", "value": 1}, Scope={"Domains": {"Include": ["AE"]}}),
    rule("R11", {"name": "AESEV", "operator": "is_not_contained_by", "define_codelist": "CL.1"}, Scope={"Domains": {"Include": ["AE"]}}),
    rule("R12", {"name": "AEVAL", "operator": "greater_than", "value": 4}, Scope={"Domains": {"Include": ["AE"]}}, Sensitivity="Group"),
    rule("R13", {"all": [{"name": "variable_value", "operator": "equal_to", "value": "BAD", "value_is_literal": True}]}, **{"Rule Type": "Value Level Metadata Check", "Scope": {"Domains": {"Include": ["AE"]}}}),
]


@pytest.fixture(scope="module")
def report(spark, study):
    terms = Terminology()
    terms.add(["SEV"], ["MILD", "SEVERE"])
    define = parse_define('<ODM><CodeList OID="CL.1"><CodeListItem CodedValue="MILD"/></CodeList></ODM>')
    return validate(spark, RULES, study, Knowledge(define, terms))


def test_results(report):
    found = {(r.rule_id, r.dataset): (r.status, r.error_count, r.skip_reason) for r in report.results}
    assert found[("R1", "AE")] == ("failed", 2, "") and found[("R2", "DM")] == ("failed", 1, "")
    assert found[("R3", "AE")] == ("failed", 1, "") and found[("R4", "AE")] == ("failed", 1, "") and found[("R5", "AE")] == ("failed", 1, "")
    assert found[("R6", "STUDY")] == ("failed", 1, "") and found[("R7", "AE")] == ("failed", 1, "") and found[("R8", "DATASETS")] == ("failed", 1, "")
    assert found[("R9", "")][2] == "unsupported_operator" and found[("R10", "")][2] == "missing_column"
    assert found[("R11", "AE")] == ("failed", 3, "") and found[("R12", "AE")] == ("failed", 3, "") and found[("R13", "AE")] == ("failed", 1, "")


def test_issues(report):
    rows = {(r["rule_id"], r["row"]): r for r in report.issues.collect()}
    bad = rows[("R1", 2)]
    assert (bad["usubjid"], bad["seq"], bad["variables"], bad["message"], bad["domain"]) == ("s1", "2", ["AESEV"], "R1 message", "AE")
    assert ("R1", 3) in rows and ("R3", 1) in rows and rows[("R3", 1)]["usubjid"] == "s3"  # the place in the joined table


def test_reports(report, tmp_path):
    said = {k: io.StringIO() for k in ("json", "csv", "log")}
    reports.write_json(report, said["json"], {"study": "x"})
    reports.write_csv(report, said["csv"])
    reports.write_log(report, said["log"])
    out = json.loads(said["json"].getvalue())
    assert out["summary"]["total"] == len(report.results) and out["metadata"] == {"study": "x"}
    rows = list(csv.DictReader(io.StringIO(said["csv"].getvalue())))
    assert sum(r["rule_id"] == "R1" for r in rows) == 2 and next(r for r in rows if r["rule_id"] == "R9")["skip_reason"] == "unsupported_operator"
    assert reports.safe_cell("=1+1") == "'=1+1" and "event=summary" in said["log"].getvalue() and '"' in reports._line(a="b c")
    assert next(r for r in out["results"] if r["rule_id"] == "R1")["errors"][0]["row"] == 2
    reports.write_csv_parts(report, str(tmp_path / "parts"))
    parts = [r for f in sorted((tmp_path / "parts").glob("*.csv")) for r in csv.DictReader(f.open(newline=""))]
    assert parts == rows
    reports.write_issues(report.issues, str(tmp_path / "issues"))
    assert {r["variable"] for r in reports.counts_by_variable(report.issues).where("rule_id = 'R4'").collect()} == {"M", "K"}


def test_include_and_hooks(spark, study):
    got = validate(spark, RULES, study, include=["R2", "R99"], hooks={"R2": lambda issues: issues.withColumn("row", F.col("row") + 1)})
    assert [(r.rule_id, r.status) for r in got.results] == [("R2", "failed"), ("R99", "skipped")] and got.issues.first()["row"] == 3
    assert validate(spark, [], study).results == []


def test_absent_columns_and_tables_and_narrowed_variables(spark, study):
    rules = [
        rule("A1", {"name": "NOWHERE", "operator": "equal_to", "value": 1}, Scope={"Domains": {"Include": ["AE"]}}),
        rule("A2", {"name": "X", "operator": "equal_to", "value": 1}, Scope={"Domains": {"Include": ["ZZ"]}}),
        rule("A3", {"any": [{"name": "AEVAL", "operator": "greater_than", "value": 8}, {"name": "AESEQ", "operator": "equal_to", "value": 1}]}, Scope={"Domains": {"Include": ["AE"]}}),
    ]
    got = validate(spark, rules, study, absent={"A1": "column", "A2": "table"}, narrowed=["A3"])
    rows = sorted((r["rule_id"], r["dataset"], r["row"] or 0, r["variables"]) for r in got.issues.collect())
    assert rows == [("A1", "AE", 0, ["NOWHERE"]), ("A2", "ZZ", 0, []), ("A3", "AE", 1, ["AESEQ"]), ("A3", "AE", 2, ["AEVAL"]), ("A3", "AE", 3, ["AESEQ"]), ("A3", "AE", 4, ["AESEQ"])]
    plain = validate(spark, rules, study)
    assert {(r.rule_id, r.skip_reason) for r in plain.results if r.status == "skipped"} == {("A1", "missing_column"), ("A2", "no_dataset")}


def test_command_line(tmp_path):
    (tmp_path / "ae.csv").write_text("USUBJID,AESEV\ns1,MILD\ns2,BAD\n")
    (tmp_path / "r.json").write_text(json.dumps({"Core": {"Id": "C1"}, "Rule Type": "Record Data", "Check": {"name": "AESEV", "operator": "is_not_contained_by", "value": ["MILD"]}, "Outcome": {"Message": "m"}}))
    args = ["validate", "--rules", str(tmp_path / "r.json"), "--data", str(tmp_path / "ae.csv"), "--output", str(tmp_path / "out"), "--format", "json", "csv", "log"]
    assert main(args) == 0 and main([*args, "--fail-on-issues"]) == 1 and main([*args, "--include", "C1", "--exclude", "C1"]) == 2
    assert json.loads((tmp_path / "out/report.json").read_text())["summary"]["failed"] == 1


def test_scores(spark):
    shape = "rule_id string, dataset string, row int, variables array<string>, usubjid string, seq string"
    found = spark.createDataFrame([("A", "AE", 1, ["X", "Y"], "s1", "1"), ("B", "AE", 1, ["X"], "s1", "1"), ("C", "AE", 2, ["X"], None, None), ("E", "AE", 1, ["X"], None, None)], shape)
    wanted = spark.createDataFrame([("A", "ae", 1, ["y", "x"], "S1", "1"), ("B", "AE", 1, ["Z"], "s1", "1"), ("C", "AE", 1, ["X"], None, None), ("D", "AE", 1, ["X"], None, None)], shape)
    cases = spark.createDataFrame([(r, r != "G") for r in "ABCDEFG"], "rule_id string, ran boolean")
    got = {r["rule_id"]: r["bucket"] for r in score.score(found, wanted, cases).collect()}
    assert got == {"A": "match", "B": "match_relaxed", "C": "both_differ", "D": "missing", "E": "no_expectation", "F": "empty_match", "G": "not_run"}
    board = score.scoreboard(score.score(found, wanted, cases))
    assert sum(r["rules"] for r in board.collect()) == 7
    assert score.changes(score.score(found, wanted), score.score(wanted, wanted)).count() > 0


def test_catalogs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Rule ID,Domain,Message,Condition,Target,Type\nX1,AE,severity must be known term,AESEV == 'MILD' @or AESEV == 'SEVERE',AESEV,value\nX2,DM,sex must be filled in,SEX != '',SEX,value\nX3,LB,%Domain% odd macro,%Variable% == 1,LBX,value\nX4,ZZ,nothing alike,,Q,\nX5,QQ,unmatched thing,QQV == 'A',QQV,value\n")
    (tmp_path / "b.csv").write_text("id,domain,message,target,type\nX1,AE,other words entirely,AESEV,value\nY2,DM,sex must be filled in,SEX,value\n")
    a, b = catalog.read_catalog(spark, str(tmp_path / "a.csv")), catalog.read_catalog(spark, str(tmp_path / "b.csv"))
    mapped = catalog.map_rules(a, b)
    got = {r["rule_id"]: (r["other_id"], r["score"]) for r in mapped.collect()}
    assert got["X1"][0] == "X1" and got["X1"][1] >= 0.9 and got["X2"][0] == "Y2" and "X4" not in got
    found = {r["rule_id"]: r["kind"] for r in catalog.classify(a, mapped).collect()}
    assert found == {"X1": "native", "X2": "native", "X3": "skeleton", "X4": "manual", "X5": "automatic"}
    assert {r["macro"] for r in catalog.macros(a).collect()} == {"%Variable%"}
    made = catalog.generate("X1", "AE", "m", "AESEV == 'MILD' @or AESEV == 'SEVERE'", "SDTMIG", "3.4")
    assert parse_rule(made).domains == {"Include": ["AE"]} and made["Check"]["all"][0]["all"][0]["operator"] == "not_equal_to"
    assert catalog.convert_condition("SEX != ''") == {"name": "SEX", "operator": "is_empty"} and catalog.convert_condition("free text here") is None
    counted = catalog.operators(spark.createDataFrame([("A", '{"operator": "exists"}')], "rule_id string, condition string"))
    assert counted.first()["operator"] == "exists"
