"""Hooks on issues, row rules on a stream, protocol documents."""

import json

import pytest

from attestra.model import ORD, Dataset, RuleError
from attestra.plans import post
from attestra.plans.rules import parse_rule
from attestra.sources import protocol
from attestra.streaming.rules import stream_issues


def test_hooks(spark):
    issues = spark.createDataFrame([("R", "AE", "AE", 3, ["A", "B"], "m", "s", "1"), ("R", "AE", "AE", 2, ["A"], "m", "s", "2")], "rule_id string, dataset string, domain string, row int, variables array<string>, message string, usubjid string, seq string")
    run = lambda *steps: post.from_manifest({"R": list(steps)})["R"](issues).select(issues.columns).collect()
    assert len(run("one_per_variable")) == 3 and len(run(["repeated", 3])) == 6 and sorted(r["row"] for r in run(["shifted", 1])) == [3, 4]
    assert [r["row"] for r in run("first_row_only")] == [2] and run("once_for_dataset")[0]["row"] is None and len(run("once_for_dataset")) == 1
    assert {tuple(r["variables"]) for r in run(["with_variable", "C"], ["without_variable", "A"])} == {("B", "C"), ("C",)} and run("without_locators")[0]["seq"] is None
    with pytest.raises(ValueError):
        post.from_manifest({"R": ["odd"]})


def test_overlaps(spark):
    rows = [(1, "s", "2024-01-01", "2024-01-10"), (2, "s", "2024-01-05", "2024-01-06"), (3, "s", "2024-02-01", ""), (4, "t", "2024-01-01", "2024-01-02"), (5, "s", "2024-01-12", "2024-01-20"), (6, "s", "2024-03-01", "2024-03-02")]
    ds = Dataset("CM", spark.createDataFrame(rows, f"{ORD} long, U string, A string, B string"))
    assert sorted(r[ORD] for r in post.overlapping(ds, ["U"], "A", "B").df.collect()) == [1, 2, 3, 6]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("s1", "BAD", 1), ("s2", "OK", 2)], "USUBJID string, T string, AESEQ int").write.parquet(f"{tmp_path}/in")
    rule = parse_rule({"Core": {"Id": "R"}, "Rule Type": "Record Data", "Check": {"name": "T", "operator": "is_not_contained_by", "value": ["OK"]}, "Outcome": {"Message": "m"}})
    stream = spark.readStream.schema("USUBJID string, T string, AESEQ int").parquet(f"{tmp_path}/in")
    query = stream_issues("AE", stream, [rule]).writeStream.format("memory").queryName("found").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("found").collect()
    assert [(r["rule_id"], r["usubjid"], r["seq"], json.loads(r["record"])["T"]) for r in got] == [("R", "s1", "1", "BAD")]
    other = parse_rule({"Core": {"Id": "R"}, "Rule Type": "Record Data", "Check": {"name": "T", "operator": "is_not_unique_set", "value": ["T"]}, "Outcome": {"Message": "m"}})
    with pytest.raises(RuleError):
        stream_issues("AE", stream, [other])


def test_protocol(spark, tmp_path):
    thing = lambda kind, id, **more: {"instanceType": kind, "id": id, **more}
    study = {"study": thing("Study", "S 1", name="x", parts=[
        thing("Activity", "A1", name="same", childIds=["A2", "A9"]), thing("Activity", "A2", name="same", childIds=[]), thing("Duration", "D1"), thing("Duration", "D2", text="two weeks", quantity={"value": 1}, durationWillVary=False),
        thing("Range", "R1", minValue={"value": 5, "unit": "kg"}, maxValue={"value": 3}), thing("StudyCell", "C1", armId="X", epochId="Y"), thing("StudyCell", "C2", armId="X", epochId="Y"), thing("EligibilityCriterionItem", "I1"),
        thing("EligibilityCriterionItem", "I2"), thing("EligibilityCriterion", "E1", criterionItemId="I1"), thing("Address", "A1", city="Bern"), thing("PersonName", "P1", text="")])}
    (tmp_path / "a.json").write_text(json.dumps(study))
    (tmp_path / "b.json").write_text("not json")
    rows = protocol.objects(protocol.read_documents(spark, str(tmp_path)))
    assert rows.count() == 13
    tables = {t.name: {r["id"]: r for r in t.df.collect()} for t in protocol.entities(spark, rows)}
    assert tables["Study"]["S 1"]["usdm_id_contains_space"] and not tables["Activity"]["A2"]["usdm_id_contains_space"]
    assert tables["Activity"]["A1"]["activity_child_id_invalid"] and not tables["Activity"]["A2"]["activity_child_id_invalid"]
    assert tables["Activity"]["A1"]["usdm_duplicate_id"] and tables["Activity"]["A1"]["usdm_duplicate_name_for_class"] and not tables["Duration"]["D1"]["usdm_duplicate_id"]
    assert tables["Duration"]["D1"]["duration_missing_text_and_quantity"] and not tables["Duration"]["D2"]["duration_missing_text_and_quantity"]
    assert tables["Range"]["R1"]["range_min_not_less_than_max"] and tables["Range"]["R1"]["range_unit_xor"] and tables["StudyCell"]["C1"]["study_cell_arm_epoch_duplicate"]
    assert tables["EligibilityCriterionItem"]["I2"]["eligibility_criterion_item_unused"] and not tables["EligibilityCriterionItem"]["I1"]["eligibility_criterion_item_unused"]
    assert tables["EligibilityCriterion"]["E1"]["eligibility_criterion_unused"] and not tables["Address"]["A1"]["address_all_blank"] and tables["PersonName"]["P1"]["person_name_missing_text_and_family_name"]


def test_library_operations(spark):
    from attestra.operators.operations import Context, apply

    library = {"AE": {"columns": ["STUDYID", "--SEQ"], "required": ["--SEQ"], "expected": ["--TERM"], "timing": ["--DTC"], "model": ["--X"]}}
    ae = Dataset("AE", spark.createDataFrame([(1, "AE"), (2, "LB"), (3, None)], f"{ORD} long, RDOMAIN string"), "AE")
    context = Context([ae], library=library)
    one = lambda **s: [r["v"] for r in apply(ae, {"id": "v", **s}, context).df.orderBy(ORD).collect()]
    assert one(operator="required_variables")[0] == "AESEQ" and one(operator="get_column_order_from_library")[0] == "STUDYID|AESEQ" and one(operator="expected_variables")[0] == "AETERM"
    assert one(operator="get_model_filtered_variables", key_value="Timing")[0] == "AEDTC" and one(operator="domain_is_custom") == [False] * 3
    assert one(operator="get_parent_model_column_order") == ["['STUDYID', '--SEQ']", "", ""] and one(operator="distinct", value_is_reference=True) == ["RDOMAIN", "", ""]


def test_relations_and_splits(spark):
    from attestra.model import Leaf, Values
    from attestra.operators import joins
    from attestra.operators.conditions import violations

    ae = Dataset("AE", spark.createDataFrame([(1, "s1", 1), (2, "s1", 2)], f"{ORD} long, USUBJID string, AESEQ long"), "AE")
    rel = Dataset("RELREC", spark.createDataFrame([(1, "AE", "s1", "AESEQ", "2"), (2, "AE", "s1", "AESEQ", "9"), (3, "AE", "s2", "", ""), (4, "AE", "s1", "", ""), (5, "XX", "s1", "AESEQ", "1"), (6, "AE", None, "AESEQ", "1")], f"{ORD} long, RDOMAIN string, USUBJID string, IDVAR string, IDVARVAL string"))
    assert [r["__found"] for r in joins.related_rows(rel, [ae]).df.orderBy(ORD).collect()] == [True, False, False, True, False, True]
    parts = [Dataset(n, spark.createDataFrame([(1, "s1", k)], f"{ORD} long, USUBJID string, QSSEQ long"), "QS") for n, k in (("QSA", 1), ("QSB", 1), ("QSC", 2))]
    whole = joins.union_of_splits(parts, "QS")
    got = violations(whole, Leaf("QSSEQ", "is_not_unique_set", Values(("USUBJID",)))).where("__mask").select("__table").collect()
    assert sorted(r[0] for r in got) == ["QSA", "QSB"]


def test_cases(spark, tmp_path):
    from attestra.harness import cases

    rule = {"Core": {"Id": "R-1"}, "Rule Type": "Record Data", "Check": {"name": "T", "operator": "equal_to", "value": "BAD", "value_is_literal": True}, "Outcome": {"Message": "m"}}
    for kind, rows, results in (("negative", "T\nBAD\nOK\n", "rule_id,dataset,domain,row,variables,message,error_count,usubjid,seq\nR-1,AE,AE,1,T,m,1,,\n"), ("positive", "T\nOK\n", None)):
        at = tmp_path / "Published/R-1" / kind / "01"
        (at / "data").mkdir(parents=True)
        (at / "data/ae.csv").write_text(rows)
        (at.parent.parent / "rule.json").write_text(json.dumps(rule))
        if results:
            (at / "results").mkdir()
            (at / "results/results.csv").write_text(results)
    scores = cases.run_scored(spark, tmp_path)
    assert {r["rule_id"].lower().split("/")[2]: r["bucket"] for r in scores.collect()} == {"negative": "match", "positive": "empty_match"}
    assert list(cases.gate(scores, scores)) == [] and "| match | 1 | 50.00% |" in cases.markdown(scores)
    with pytest.raises(ValueError):
        cases.run_scored(spark, tmp_path / "none")


def test_drafted_cases_score(spark, tmp_path):
    from attestra.catalog import fixtures
    from attestra.catalog.rules import generate
    from attestra.harness import cases

    drafts = [generate("X1", "AE", "m", "AESEV == 'MILD' @or AESEV == 'SEVERE'"), generate("X2", "AE", "m", "AETERM != ''"), generate("X3", "AE", "m", "AEVAL >= 3 @and AEFLAG == 'Y'")]
    made = [fixtures.write_cases(d, tmp_path) for d in drafts]
    assert made == [False, True, True]  # no one cell differs from two values by these rules of thumb
    assert fixtures.check_tree(tmp_path) == []
    got = {r["rule_id"].lower(): r["bucket"] for r in cases.run_scored(spark, tmp_path).collect()}
    assert got == {"draft/x2/negative/01": "match", "draft/x2/positive/01": "empty_match", "draft/x3/negative/01": "match", "draft/x3/positive/01": "empty_match"}
    (tmp_path / "Draft/X2/rule.json").unlink()
    assert fixtures.check_tree(tmp_path) == ["X2: no rule"]


def test_protocol_products(spark, tmp_path):
    thing = lambda kind, id, **more: {"instanceType": kind, "id": id, **more}
    study = {"products": [thing("AdministrableProduct", "P1", sourcing={"code": "x"}), thing("AdministrableProduct", "P2", sourcing={"code": "x"})], "devices": [thing("MedicalDevice", "M1", embeddedProductId="P1"), thing("MedicalDevice", "M2", embeddedProductId="P2")],
        "given": [thing("Administration", "A1", dose={"id": "d"}, medicalDeviceId="M1"), thing("Administration", "A2", dose={"id": "d"}, route={"id": "r"}, frequency={"id": "f"}, administrableProductId="P2", medicalDeviceId="M2"), thing("Administration", "A3", route={"id": "r"}, administrableProductId="")],
        "amendment": {"primaryReason": thing("StudyAmendmentReason", "R1", code={"code": "C48660"}), "secondaryReasons": [thing("StudyAmendmentReason", "R2", code={"code": "C48660"}), thing("StudyAmendmentReason", "R3", code={"code": "C1"})]},
        "roles": [thing("ProductOrganizationRole", "O1", appliesToIds=["P1", "P9"]), thing("ProductOrganizationRole", "O2")]}
    (tmp_path / "a.json").write_text(json.dumps({"study": study}))
    rows = protocol.objects(protocol.read_documents(spark, str(tmp_path)))
    got = {r["id"]: r.asDict() for t in protocol.entities(spark, rows) for r in t.df.collect()}
    assert got["P1"]["administrable_product_embedded_only_sourcing"] and not got["P2"]["administrable_product_embedded_only_sourcing"]
    assert [got[i]["administration_dose_route_xor"] for i in ("A1", "A2", "A3")] == [True, False, True] and [got[i]["administration_dose_product_xor"] for i in ("A1", "A2", "A3")] == [False, False, False]
    assert [got[i]["administration_duplicate_embedded_product"] for i in ("A1", "A2", "A3")] == [False, True, False] and got["A1"]["administration_dose_without_frequency"]
    assert got["R1"]["primary_reason_not_applicable"] and [got[i]["secondary_reason_matches_primary"] for i in ("R1", "R2", "R3")] == [False, True, False] and not got["R2"]["primary_reason_not_applicable"]
    assert got["O1"]["product_role_invalid_target"] and not got["O1"]["product_role_missing_valid_target"] and got["O2"]["product_role_missing_valid_target"]
