"""Rules from JSON or YAML, and the expression texts that conditions may be written in."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from attestra.model import All, AnyOf, ColumnRef, Condition, Leaf, Literal, Not, NoValue, Rule, RuleError, Values

# Operators whose text value names a column.
COLUMN_VALUE = {
    "equal_to", "not_equal_to", "equal_to_case_insensitive", "not_equal_to_case_insensitive", "less_than", "less_than_or_equal_to", "greater_than", "greater_than_or_equal_to",
    "date_equal_to", "date_not_equal_to", "date_less_than", "date_less_than_or_equal_to", "date_greater_than", "date_greater_than_or_equal_to",
    "prefix_not_equal_to", "prefix_is_not_contained_by", "suffix_is_not_contained_by", "is_not_unique_relationship",
}
#: Operators whose value names columns in any case.
NAMES_COLUMNS = {"empty_within_except_last_row", "does_not_have_next_corresponding_record", "is_not_unique_set", "is_unique_set", "is_inconsistent_across_dataset"}
RULE_TYPES = {"record data": "record_data", "dataset metadata check": "dataset_metadata", "dataset metadata": "dataset_metadata", "variable metadata check": "variable_metadata", "variable metadata": "variable_metadata", "domain presence check": "domain_presence", "domain presence": "domain_presence", "value level metadata check": "value_metadata", "value level metadata": "value_metadata", "json schema check": "json_schema", "jsonata": "jsonata"}


def snake(name: str) -> str:
    """``Equal To``, ``equalTo`` and ``equal-to`` as ``equal_to``."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip())
    return re.sub(r"[\s\-_]+", "_", spaced).lower()


def parse_condition(value: Any) -> Condition:
    if isinstance(value, str):
        return parse_expression(value)
    if not isinstance(value, dict):
        raise RuleError("a condition is a text or a mapping", "invalid_rule")
    for key, kind in (("all", All), ("any", AnyOf)):
        if key in value:
            if not isinstance(value[key], list):
                raise RuleError(f"{key} takes a list", "invalid_rule")
            return kind(tuple(parse_condition(v) for v in value[key]))
    if "not" in value:
        inner = value["not"]
        return Not(All(tuple(parse_condition(v) for v in inner)) if isinstance(inner, list) else parse_condition(inner))
    if not isinstance(value.get("operator"), str):
        raise RuleError("a condition needs an operator", "invalid_rule")
    operator = snake(value["operator"])
    options = {k: v for k, v in value.items() if k not in ("name", "target", "operator", "value", "value_is_literal")}
    target = next((value[k] for k in ("name", "target") if isinstance(value.get(k), str)), "")
    return Leaf(target.strip().removeprefix("$") if target.startswith("$") else target, operator, comparator(value, operator), options)


def comparator(value: dict[str, Any], operator: str) -> Any:
    if "value" not in value or value["value"] is None:
        return NoValue()
    said = value["value"]
    if value.get("value_is_literal") is True:
        return Values(tuple(said)) if isinstance(said, list) else Literal(said)
    if isinstance(said, str) and said.lstrip().startswith("$"):
        return ColumnRef(said.strip().removeprefix("$"))
    if isinstance(said, str) and operator in COLUMN_VALUE | NAMES_COLUMNS:
        return ColumnRef(said)
    return Values(tuple(said)) if isinstance(said, list) else Literal(said)


# expressions

TOKEN = re.compile(r"\s*(?:(?P<number>-?\d+(?:\.\d+)?(?![\w.]))|(?P<text>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<pattern>/(?:[^/\\\n]|\\.)+/[a-z]*)|(?P<op>>=|<=|!=|&&|\|\||[=<>!(),\[\]])|(?P<word>\$?[A-Za-z_`][\w.`-]*))")
COMPARISONS = {"=": "equal_to", "!=": "not_equal_to", ">": "greater_than", ">=": "greater_than_or_equal_to", "<": "less_than", "<=": "less_than_or_equal_to"}
FLIPPED = {"=": "=", "!=": "!=", ">": "<", ">=": "<=", "<": ">", "<=": ">="}


class _Call(tuple):
    """A function call that only a comparison or a negation around it gives a meaning."""


class Expression:
    def __init__(self, source: str):
        self.source, self.tokens, self.at = source, [], 0
        if re.search(r"[{}@\n]|~>", source):
            raise RuleError(f"unsupported expression: {source}", "unsupported_operator")
        end = 0
        while source[end:].strip():
            m = TOKEN.match(source, end)
            if not m:
                raise RuleError(f"unsupported expression: {source}", "unsupported_operator")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            end = m.end()

    def peek(self) -> tuple[str | None, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "")

    def take(self, *wanted: str) -> str | None:
        if self.peek()[1] in wanted and self.peek()[0] in ("op", "word"):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if self.take(wanted) is None:
            raise RuleError(f"expected {wanted}: {self.source}", "unsupported_operator")

    def whole(self) -> Condition:
        out = self.either()
        if self.peek()[0] is not None:
            raise RuleError(f"unsupported expression: {self.source}", "unsupported_operator")
        return out

    def either(self) -> Condition:
        parts = [self.both()]
        while self.take("or", "||"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else AnyOf(tuple(parts))

    def both(self) -> Condition:
        parts = [self.one()]
        while self.take("and", "&&"):
            parts.append(self.one())
        return parts[0] if len(parts) == 1 else All(tuple(parts))

    def one(self) -> Condition:
        if self.take("!"):
            return Not(self.one())
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        left = self.operand()
        sign = self.take(*COMPARISONS)
        if sign:
            return self.compared(left, sign, self.operand())
        negative = bool(self.take("not"))
        if self.take("in"):
            return Leaf(self.column(left), "is_not_contained_by" if negative else "is_contained_by", self.value(self.operand()))
        if isinstance(left, Leaf | Not | All | AnyOf):
            return left
        if isinstance(left, ColumnRef):
            return Leaf(left.name, "exists")
        raise RuleError(f"unsupported expression: {self.source}", "unsupported_operator")

    def operand(self) -> Any:
        kind, said = self.peek()
        self.at += 1
        if kind == "number":
            return Literal(float(said) if "." in said else int(said))
        if kind == "text":
            return Literal(re.sub(r"\\(.)", r"\1", said[1:-1]))
        if kind == "pattern":
            body, _, flags = said[1:].rpartition("/")
            return Literal(f"(?{flags}){body}" if flags else body)
        if said == "[":
            values = []
            while not self.take("]"):
                values.append(self.operand())
                self.take(",")
            return Values(tuple(v.value for v in values))
        if kind == "word" and said.startswith("$") and self.peek()[1] == "(":
            return self.called(said[1:])
        if kind == "word":
            return Literal({"true": True, "false": False}[said]) if said in ("true", "false") else Literal(None) if said == "null" else ColumnRef(said.strip("`").removeprefix("$"))
        raise RuleError(f"unsupported expression: {self.source}", "unsupported_operator")

    def called(self, name: str) -> Any:
        self.need("(")
        if name in ("not", "boolean"):
            inner = self.either()
            self.need(")")
            return Not(inner) if name == "not" else inner
        args = []
        while not self.take(")"):
            args.append(self.operand())
            self.take(",")
        if name == "exists":
            return Leaf(self.column(args[0]), "exists")
        if name == "contains":
            return Leaf(self.column(args[1]), "is_contained_by", args[0]) if isinstance(args[0], Values) else Leaf(self.column(args[0]), "contains", args[1])
        if name == "match":
            return Leaf(self.column(args[0]), "matches_regex", args[1])
        if name in ("trim", "string", "number") and isinstance(args[0], Literal):
            said = str(args[0].value)
            return Literal(said.strip() if name == "trim" else float(said) if name == "number" else said)
        if name in ("uppercase", "lowercase", "length", "substring"):
            return _Call((name, *args))
        raise RuleError(f"unsupported function ${name}", "unsupported_operator")

    def compared(self, left: Any, sign: str, right: Any) -> Condition:
        if isinstance(left, Literal) and not isinstance(right, Literal):
            return self.compared(right, FLIPPED[sign], left)
        if isinstance(left, Leaf):  # $exists(x) = true
            yes = (right.value is True) == (sign == "=")
            return left if yes else Leaf(left.target, "not_exists" if left.operator == "exists" else left.operator)
        if isinstance(left, _Call):
            return self.measured(left, sign, right)
        if isinstance(right, _Call) and right[0] in ("uppercase", "lowercase"):
            right = right[1]
        return Leaf(self.column(left), COMPARISONS[sign], self.value(right))

    def measured(self, call: _Call, sign: str, right: Any) -> Condition:
        name, target = call[0], self.column(call[1])
        if name in ("uppercase", "lowercase") and sign in ("=", "!="):
            other = right[1] if isinstance(right, _Call) else right
            return Leaf(target, COMPARISONS[sign] + "_case_insensitive", self.value(other))
        if name == "substring" and sign in ("=", "!=") and isinstance(right, Literal):
            begin = call[2].value
            found = Leaf(target, "matches_regex", Literal(f"(?s)^.{{{begin}}}{re.escape(str(right.value))}" + ("" if len(call) > 3 else "$")))
            return found if sign == "=" else Not(found)
        if name == "length" and isinstance(right, Literal):
            n = int(right.value)
            at_least = lambda k: Leaf(target, "matches_regex", Literal(f"(?s)^.{{{k},}}$"))
            if sign == "=":
                return Leaf(target, "is_empty") if n == 0 else Leaf(target, "matches_regex", Literal(f"(?s)^.{{{n}}}$"))
            if sign == "!=":
                return Leaf(target, "is_not_empty") if n == 0 else Not(Leaf(target, "matches_regex", Literal(f"(?s)^.{{{n}}}$")))
            return {">": at_least(n + 1), ">=": at_least(n), "<": Not(at_least(n)), "<=": Not(at_least(n + 1))}[sign]
        raise RuleError(f"unsupported comparison of ${name}", "unsupported_operator")

    def column(self, operand: Any) -> str:
        if not isinstance(operand, ColumnRef):
            raise RuleError(f"expected a column: {self.source}", "unsupported_operator")
        return operand.name

    @staticmethod
    def value(operand: Any) -> Any:
        return operand


def parse_expression(source: str) -> Condition:
    """``$a := x; rest`` names a part; the rest is one condition."""
    *bindings, body = source.split(";")
    for binding in bindings:
        m = re.fullmatch(r"\s*\$(\w+)\s*:=\s*(.+?)\s*", binding, re.S)
        if not m:
            raise RuleError(f"unsupported expression: {source}", "unsupported_operator")
        body = re.sub(rf"\${m[1]}\b", lambda _, said=m[2]: f"({said})" if re.search(r"\s(?:and|or)\s|[=<>]", said) else said, body)
    return Expression(body.strip()).whole()


# rules


def _texts(value: Any) -> tuple[str, ...]:
    if isinstance(value, str):
        return (value,)
    return tuple(str(v) for v in value) if isinstance(value, list) else ()


def _standards(authorities: Any) -> tuple[tuple[str, str, str], ...]:
    out = []
    for authority in authorities if isinstance(authorities, list) else []:
        for standard in authority.get("Standards") or []:
            out.append((str(standard.get("Name") or ""), str(standard.get("Version") or ""), str(standard.get("Substandard") or "")))
    return tuple(out)


def parse_rule(raw: dict[str, Any]) -> Rule:
    """A rule in its metadata shape (Core, Check, Outcome) or its executable shape (core_id, conditions, actions)."""
    if not isinstance(raw, dict):
        raise RuleError("a rule is a mapping", "invalid_rule")
    if {"core_id", "conditions", "actions"} <= set(raw):
        action = raw["actions"][0] if raw["actions"] else {}
        return Rule(
            str(raw["core_id"]), parse_condition(raw["conditions"]), str((action.get("params") or action).get("message", "")), RULE_TYPES.get(str(raw.get("rule_type", "Record Data")).replace("_", " ").lower(), "unsupported"),
            str(raw.get("sensitivity") or "record").lower(), tuple(raw.get("operations") or ()), tuple(raw.get("datasets") or ()), raw.get("domains") or {}, raw.get("classes") or {}, raw.get("entities") or {},
            tuple((str(s.get("name") or ""), str(s.get("version") or ""), str(s.get("substandard") or s.get("Substandard") or "")) for s in raw.get("standards") or ()), _texts(raw.get("output_variables")), str(raw.get("status") or ""),
        )
    missing = [k for k in ("Core", "Check", "Outcome") if k not in raw]
    if missing or not (raw["Core"] or {}).get("Id"):
        raise RuleError(f"the rule lacks {', '.join(missing) or 'Core.Id'}", "invalid_rule")
    scope, outcome = raw.get("Scope") or {}, raw["Outcome"] or {}
    return Rule(
        str(raw["Core"]["Id"]), parse_condition(raw["Check"]), str(outcome.get("Message", "")), RULE_TYPES.get(str(raw.get("Rule Type", "")).strip().lower(), "unsupported"), str(raw.get("Sensitivity") or "record").strip().lower(),
        tuple({snake(k) if k.istitle() else k: v for k, v in o.items()} for o in raw.get("Operations") or ()), tuple(raw.get("Match Datasets") or ()), scope.get("Domains") or {}, scope.get("Classes") or {}, scope.get("Entities") or {},
        _standards(raw.get("Authorities")), _texts(outcome.get("Output Variables")), str(raw["Core"].get("Status") or ""), str(raw.get("Description") or ""), str(raw.get("Executability") or ""), str(scope.get("Use Case") or ""),
    )


def load_rules(paths: Iterable[str | Path]) -> list[Rule]:
    """Rules of JSON and YAML files; folders are read in name order, files that hold a list give each."""
    out: list[Rule] = []
    for path in map(Path, paths):
        if path.is_dir():
            out += load_rules(sorted(p for p in path.iterdir() if p.suffix.lower() in (".json", ".yaml", ".yml")))
            continue
        raw = json.loads(path.read_text("utf-8")) if path.suffix.lower() == ".json" else read_yaml(path.read_text("utf-8"))
        out += [parse_rule(r) for r in (raw if isinstance(raw, list) else [raw])]
    return out


def yaml_errors() -> tuple[type[Exception], ...]:
    """What a YAML text that can't be read raises."""
    try:
        import yaml
    except ImportError:
        return ()
    return (yaml.YAMLError,)


def read_yaml(source: str) -> Any:
    """YAML in which Y, N, yes, no, on and off stay texts."""
    try:
        import yaml
    except ImportError as error:  # an extra that may not be installed
        raise RuleError("YAML rules need PyYAML", "invalid_rule") from error

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {k: [(tag, pattern) for tag, pattern in v if tag not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    return yaml.load(source, Loader)
