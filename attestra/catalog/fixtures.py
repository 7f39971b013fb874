"""Small cases for draft rules: a table that meets the rule, one that violates it, and the issues expected."""

from __future__ import annotations

import csv
import json
from pathlib import Path
from typing import Any

from attestra.model import All, AnyOf, ColumnRef, Condition, Leaf, Literal, Not, Values
from attestra.plans.rules import parse_rule

FILLER = "VALUE"


def _value(leaf: Leaf) -> Any:
    c = leaf.comparator
    return c.values[0] if isinstance(c, Values) and c.values else c.value if isinstance(c, Literal) else c.name if isinstance(c, ColumnRef) else None


def _other(value: Any) -> Any:
    return value + 1 if isinstance(value, int | float) and not isinstance(value, bool) else f"{value}X"


#: By operator: a cell on which it is true, and one on which it is false, for the value it compares with.
CELLS = {
    "equal_to": (lambda v: v, _other), "not_equal_to": (_other, lambda v: v), "equal_to_case_insensitive": (lambda v: str(v).lower(), _other), "not_equal_to_case_insensitive": (_other, lambda v: v),
    "is_empty": (lambda v: "", lambda v: FILLER), "is_not_empty": (lambda v: FILLER, lambda v: ""), "exists": (lambda v: FILLER, lambda v: None),
    "is_contained_by": (lambda v: v, _other), "is_not_contained_by": (_other, lambda v: v), "contains": (lambda v: f"a{v}b", lambda v: ""), "does_not_contain": (lambda v: "", lambda v: f"a{v}b"),
    "greater_than": (lambda v: v + 1, lambda v: v), "greater_than_or_equal_to": (lambda v: v, lambda v: v - 1), "less_than": (lambda v: v - 1, lambda v: v), "less_than_or_equal_to": (lambda v: v, lambda v: v + 1),
    "starts_with": (lambda v: f"{v}a", lambda v: "-"), "ends_with": (lambda v: f"a{v}", lambda v: "-"), "longer_than": (lambda v: "a" * (int(v) + 1), lambda v: "a"),
}


def row_for(condition: Condition, wanted: bool) -> dict[str, Any] | None:
    """Cells on which the condition is as wanted; None where an operator has no ready cells or cells contradict."""
    if isinstance(condition, Not):
        return row_for(condition.part, not wanted)
    if isinstance(condition, All | AnyOf):
        every = isinstance(condition, All) == wanted
        rows = [row_for(p, wanted) for p in condition.parts]
        if not every:
            return next((r for r in rows if r is not None), None)
        out: dict[str, Any] = {}
        for r in rows:
            if r is None or any(k in out and out[k] != v for k, v in r.items()):
                return None
            out |= r
        return out
    if condition.operator not in CELLS or (isinstance(condition.comparator, ColumnRef) and condition.operator not in ("is_empty", "is_not_empty")):
        return None
    value = _value(condition)
    if condition.operator in ("greater_than", "less_than", "greater_than_or_equal_to", "less_than_or_equal_to") and not isinstance(value, int | float):
        return None
    return {condition.target: CELLS[condition.operator][0 if wanted else 1](value)}


def write_cases(raw: dict[str, Any], root: str | Path, scope: str = "Draft") -> bool:
    """Writes the rule with a positive and a negative case; False, and nothing written, where no rows can be made."""
    rule = parse_rule(raw)
    rows = {kind: row_for(rule.conditions, kind == "negative") for kind in ("positive", "negative")}
    if None in rows.values():
        return False
    domain = next(iter((rule.domains.get("Include") if rule.domains else None) or ["AE"]))
    at = Path(root) / scope / rule.id
    names = list(dict.fromkeys(k for r in rows.values() for k in r))
    for kind, row in rows.items():
        data = at / kind / "01" / "data"
        data.mkdir(parents=True, exist_ok=True)
        with (data / f"{domain.lower()}.csv").open("w", newline="") as out:
            writer = csv.DictWriter(out, ["USUBJID", *names])
            writer.writeheader()
            writer.writerow({"USUBJID": "S1", **{n: row.get(n, FILLER) for n in names}})
        if kind == "negative":
            (at / kind / "01" / "results").mkdir(exist_ok=True)
            shown = "|".join(dict.fromkeys(leaf_names(rule.conditions)))
            (at / kind / "01" / "results" / "results.csv").write_text(f"rule_id,dataset,domain,row,variables,message,error_count,usubjid,seq\n{rule.id},{domain},{domain},1,{shown},,1,S1,\n")
    (at / "rule.json").write_text(json.dumps(raw, indent=2))
    return True


def leaf_names(condition: Condition) -> list[str]:
    if isinstance(condition, Leaf):
        return [condition.target]
    return [n for p in ([condition.part] if isinstance(condition, Not) else condition.parts) for n in leaf_names(p)]


def check_tree(root: str | Path) -> list[str]:
    """What is wrong with a tree of drafted rules and cases."""
    wrong = []
    for at in sorted(p for p in Path(root).glob("*/*") if p.is_dir()):
        if not (at / "rule.json").exists():
            wrong.append(f"{at.name}: no rule")
            continue
        if parse_rule(json.loads((at / "rule.json").read_text())).id != at.name:
            wrong.append(f"{at.name}: the rule has another id")
        wrong += [f"{at.name}: no {kind} case" for kind in ("positive", "negative") if not list((at / kind).glob("*/data/*.csv"))]
    return wrong
