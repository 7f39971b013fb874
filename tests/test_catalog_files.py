"""Catalogs from XML configurations, trees and archives of rule files; drafts written by rule; classes of cases."""

import json
import zipfile

import pytest

from attestra.catalog import rules
from attestra.cli import main
from attestra.harness import score

CONFIG = """<Config name="C" version="1"><Standard Name="SDTM-IG" version="3.4"><Rules>
<Rule id="SD1" domain="AE; CM" type="Match" target="aesev" Message="CG0123: severity is known"><Test>AESEV == 'MILD'</Test><When>AESEV != ''</When></Rule>
<ValidationRule><ID>SD2</ID><Domains><Domain>DM</Domain><Domain>LB</Domain></Domains><Description>say more</Description></ValidationRule>
<Rule message="no id"/></Rules></Standard></Config>"""


def test_configuration(spark, tmp_path):
    (tmp_path / "c.xml").write_text(CONFIG)
    got = {r["rule_id"]: r for r in rules.read_config(spark, str(tmp_path / "c.xml")).collect()}
    assert set(got) == {"SD1", "SD2"} and got["SD1"]["domain"] == "AE|CM" and got["SD1"]["target"] == "AESEV" and got["SD1"]["standard"] == "SDTM-IG" and got["SD1"]["shared_ids"] == "CG0123"
    assert got["SD1"]["condition"] == "WHEN AESEV != '' TEST AESEV == 'MILD'" and got["SD2"]["domain"] == "DM|LB" and got["SD2"]["description"] == "say more"
    (tmp_path / "bad.xml").write_text("<!DOCTYPE x><x/>")
    with pytest.raises(ValueError):
        rules.read_config(spark, str(tmp_path / "bad.xml"))


def test_rule_files(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.json").write_text(json.dumps([{"Core": {"Id": "A"}}, {"Core": {"Id": "B"}}]))
    (tmp_path / "in/deep/c.yml").write_text("Core:\n  Id: C\n  Flag: Y\n")
    (tmp_path / "in/broken.json").write_text("{")
    with zipfile.ZipFile(tmp_path / "in/z.zip", "w") as archive:
        archive.writestr("x/d.yaml", "Core: {Id: D}")
        archive.writestr("notes.txt", "no rule")
    rows = rules.read_rule_files(spark, str(tmp_path / "in")).collect()
    found = {json.loads(r["rule"])["Core"]["Id"]: r["path"].rpartition("/")[2] for r in rows if r["rule"]}
    assert found == {"A": "a.json", "B": "a.json", "C": "c.yml", "D": "d.yaml"} and [r["path"].rpartition("/")[2] for r in rows if r["error"]] == ["broken.json"]
    drafts = spark.createDataFrame([("A", '{"x": 1}'), ("B", '{"x": 2}')], "rule_id string, rule string")
    done = rules.export_rules(drafts, str(tmp_path / "out"), spark.createDataFrame([("B",), ("B",)], "rule_id string"))
    assert {r["rule_id"]: r["exported"] for r in done.collect()} == {"A": False, "B": True} and [p.name for p in (tmp_path / "out").glob("rule_id=*")] == ["rule_id=B"]


def test_command_line(spark, tmp_path):
    (tmp_path / "c.xml").write_text(CONFIG)
    (tmp_path / "o.csv").write_text("id,domain,message,target,standard\nY1,AE,severity is known,AESEV,SDTM-IG\n")
    assert main(["map", "--catalog", str(tmp_path / "c.xml"), "--other", str(tmp_path / "o.csv"), "--output", str(tmp_path / "map")]) == 0
    got = {r["rule_id"]: (r["other_id"], r["kind"]) for r in spark.read.csv(str(tmp_path / "map"), header=True).collect()}
    assert got["SD1"][0] == "Y1" and got["SD2"] == (None, "manual")
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/a.json").write_text('{"Core": {"Id": "A"}}')
    assert main(["gather", "--rules", str(tmp_path / "rules"), "--output", str(tmp_path / "all")]) == 0 and spark.read.parquet(str(tmp_path / "all")).count() == 1


def test_classes_of_cases(spark):
    shape = "rule_id string, case_id string, n_expected long, n_found long, skipped boolean, n_described long, n_matched long, want string"
    rows = [
        ("A", "1", 1, 1, False, 1, 1, "PASS"), ("A", "2", 1, 0, False, 1, 0, "NEGATIVE_DID_NOT_TRIGGER"), ("A", "3", 0, 2, False, 0, 0, "POSITIVE_TRIGGERED_UNEXPECTEDLY"), ("B", "1", None, 1, False, 0, 0, "EXPECTED_OUTPUT_MISSING"), ("B", "2", 1, None, False, 1, 0, "ACTUAL_OUTPUT_MISSING"),
        ("B", "3", 1, 0, True, 1, 0, "ACTUAL_SKIPPED_BY_CORE"), ("B", "4", 1, 2, True, 1, 0, "ACTUAL_MIXED_SKIPPED_AND_ISSUES"), ("C", "1", 3, 2, False, 3, 1, "ISSUE_COUNT_MISMATCH"), ("C", "2", 2, 2, False, 2, 1, "STRUCTURAL_MISMATCH"), ("C", "3", 3, 4, False, 1, 1, "PARTIAL_STRUCTURAL_CHECK"),
    ]
    cases = score.classified(spark.createDataFrame(rows, shape))
    assert cases.where("class <> want OR class IS NULL").count() == 0 and score.class_counts(cases).count() == len(rows)
    assert not score.gate(cases) and score.gate(cases.where("class = 'PASS'")) and not score.gate(cases.limit(0)) and score.gate(cases.where("class IN ('PASS', 'ACTUAL_SKIPPED_BY_CORE')"), allow_skipped=True)
