"""Rule files, expression texts, selection and scope."""

import json

from dataclasses import replace

import pytest

from attestra.model import All, AnyOf, ColumnRef, Dataset, Leaf, Literal, Not, RuleError, Values
from attestra.plans.rules import load_rules, parse_condition, parse_expression, parse_rule, read_yaml, snake
from attestra.plans.selection import for_standard, in_scope, select_rules, unsupported

RULE = {
    "Core": {"Id": "R-1", "Status": "Draft"}, "Authorities": [{"Standards": [{"Name": "SDTMIG", "Version": "3.4"}]}], "Scope": {"Domains": {"Include": ["AE", "SUPP--"]}, "Classes": {"Include": ["EVENTS"]}},
    "Sensitivity": "Record", "Rule Type": "Record Data", "Operations": [{"name": "filter", "where": {"name": "A", "operator": "equal_to", "value": "B"}}],
    "Check": {"all": [{"name": "A", "operator": "Equal To", "value": "B"}, {"not": {"name": "A", "operator": "is_contained_by", "value": ["x"]}}]}, "Outcome": {"Message": "m", "Output Variables": ["A"]},
}


def test_metadata_and_executable_shapes(tmp_path):
    rule = parse_rule(RULE)
    assert rule.id == "R-1" and rule.conditions == All((Leaf("A", "equal_to", ColumnRef("B")), Not(Leaf("A", "is_contained_by", Values(("x",))))))
    assert rule.standards == (("SDTMIG", "3.4", ""),) and rule.output_variables == ("A",) and rule.sensitivity == "record"
    other = parse_rule({"core_id": "R-2", "conditions": {"name": "A", "operator": "exists"}, "actions": [{"name": "x", "params": {"message": "m"}}]})
    assert other.message == "m" and other.conditions == Leaf("A", "exists")
    (tmp_path / "b.json").write_text(json.dumps([RULE]))
    (tmp_path / "a.yaml").write_text("Core: {Id: R-0}\nCheck: {name: A, operator: equal_to, value: Y, value_is_literal: true}\nOutcome: {Message: no}\n")
    assert [r.id for r in load_rules([tmp_path])] == ["R-0", "R-1"]
    for bad in ({}, {"Core": {}, "Check": {}, "Outcome": {}}, {"Core": {"Id": "x"}, "Check": {"name": "A"}, "Outcome": {}}):
        with pytest.raises(RuleError):
            parse_rule(bad)


def test_yaml_keeps_yes_and_no():
    assert read_yaml("[Y, N, yes, no, on, true, 2024-01-01, 3]") == ["Y", "N", "yes", "no", "on", True, "2024-01-01", 3]


def test_values():
    assert parse_condition({"name": "A", "operator": "contains", "value": "B"}).comparator == Literal("B")
    assert parse_condition({"name": "A", "operator": "contains", "value": "$B"}).comparator == ColumnRef("B")
    assert parse_condition({"name": "A", "operator": "equal_to", "value": "B", "value_is_literal": True}).comparator == Literal("B")
    assert parse_condition({"target": "A", "operator": "prefix_equal_to", "value": "B", "prefix": 2}).options == {"prefix": 2}
    assert snake("Is Not-ContainedBy") == "is_not_contained_by"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("A", Leaf("A", "exists")),
        ('A = "x" and B != 2', All((Leaf("A", "equal_to", Literal("x")), Leaf("B", "not_equal_to", Literal(2))))),
        ("A > B or !(C)", AnyOf((Leaf("A", "greater_than", ColumnRef("B")), Not(Leaf("C", "exists"))))),
        ('A in ["x", "y"]', Leaf("A", "is_contained_by", Values(("x", "y")))),
        ('A not in ["x"]', Leaf("A", "is_not_contained_by", Values(("x",)))),
        ('$not($exists(A))', Not(Leaf("A", "exists"))),
        ("$exists(A) = false", Leaf("A", "not_exists")),
        ('$contains(["x"], A)', Leaf("A", "is_contained_by", Values(("x",)))),
        ('$contains(A, "x")', Leaf("A", "contains", Literal("x"))),
        ("$match(A, /^x/i)", Leaf("A", "matches_regex", Literal("(?i)^x"))),
        ('$uppercase(A) = "X"', Leaf("A", "equal_to_case_insensitive", Literal("X"))),
        ('$substring(A, 2, 1) = "x"', Leaf("A", "matches_regex", Literal("(?s)^.{2}x"))),
        ("$length(A) > 3", Leaf("A", "matches_regex", Literal("(?s)^.{4,}$"))),
        ("$length(A) = 0", Leaf("A", "is_empty")),
        ('A = $trim(" x ")', Leaf("A", "equal_to", Literal("x"))),
        ('3 < A', Leaf("A", "greater_than", Literal(3))),
        ('$a := B; A = $a', Leaf("A", "equal_to", ColumnRef("B"))),
    ],
)
def test_expressions(source, want):
    assert parse_expression(source) == want


@pytest.mark.parametrize("source", ["A ~> $f()", "{A}", "A @ B", "$sum(A) > 1", "A = ", "(A", "A B"])
def test_unsupported_expressions(source):
    with pytest.raises(RuleError):
        parse_expression(source)


def test_selection(spark):
    rules = [parse_rule(RULE), parse_rule({**RULE, "Core": {"Id": "R-2"}, "Authorities": [], "Rule Type": "Odd"})]
    chosen, missing = select_rules(rules, include=["R-2", "R-9"])
    assert [r.id for r in chosen] == ["R-2"] and missing[0].skip_reason == "rule_not_found"
    assert [r.id for r in select_rules(rules, exclude=["R-2"])[0]] == ["R-1"]
    with pytest.raises(ValueError):
        select_rules(rules, ["R-1"], ["R-2"])
    kept, outside = for_standard(rules, "ADaMIG")
    assert kept == [] and [r.skip_reason for r in outside] == ["outside_standard"] * 2 and for_standard(rules, "ADaMIG", asked_for=False) == ([], [])
    assert [r.id for r in for_standard(rules, "sdtmig", "3-4")[0]] == ["R-1"]
    of = lambda name, version, part="": replace(rules[0], standards=((name, version, part),))
    some = [of("SENDIG-DART", "1.1"), of("SENDIG", "2.0"), of("TIG", "1.0", "SDTM"), of("TIG", "1.0", "SEND"), of("SDTMIG", ""), of("USDM", "3.0")]
    assert for_standard(some, "SENDIG", "3.1")[0] == some[:1] and for_standard(some, "SENDIG")[0] == some[:2]
    assert for_standard(some, "SDTMIG", "3.4")[0] == [some[2]] and for_standard(some, "SDTMIG")[0] == [some[2], some[4]] and for_standard(some, "USDM", "4.0")[0] == some[5:]
    assert unsupported(rules[1]) == "unsupported_rule_type" and unsupported(rules[0]) == ""
    df = spark.range(1)
    named = lambda n, d: Dataset(n, df, d)
    classes = lambda domain, **scope: in_scope(replace(rules[0], domains={}, classes=scope), named(domain, domain))
    assert classes("ML", Include=["Interventions"]) and classes("FA", Include=["FINDINGS"]) and classes("FA", Include=["Findings-About"]) and not classes("LB", Include=["FINDINGS ABOUT"])
    assert classes("BE", Include=["EVENTS"]) and classes("DM", Include=["SPECIAL_PURPOSE"]) and not classes("FA", Exclude=["Findings"]) and classes("SUPPAE", Include=["EVENTS"])
    assert in_scope(rules[0], named("AE", "AE")) and not in_scope(rules[0], named("LB", "LB")) and in_scope(rules[0], named("SUPPAE", "SUPPAE"))  # of no known class
