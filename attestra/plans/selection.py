"""Which rules run, and on which tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from attestra.model import Dataset, Result, Rule, leaves
from attestra.operators.conditions import ALIASES, OPERATORS

# Classes of domains.
CLASSES = {
    "INTERVENTIONS": "CM EC EX ML PR SU",
    "EVENTS": "AE CE DS DV MH",
    "FINDINGS": "CV DD EG FT IE IS LB MB MI MS PC PP QS RE RP SC SS TR TU UR VS",
    "FINDINGS ABOUT": "FA SR",
    "SPECIAL PURPOSE": "CO DM SE SV",
    "TRIAL DESIGN": "TA TD TE TI TM TS TV",
    "RELATIONSHIP": "RELREC SUPP SUPPQUAL",
}
CLASS_OF = {d: c for c, names in CLASSES.items() for d in names.split()}
# Standards that take the rules of others, of a part of another, and of other versions.
ALSO_NAMED = {"SENDIG": ("SENDIG-DART", "SENDIG-GENETOX")}
ALSO_PARTS = {"SDTMIG": (("TIG", "SDTM"),)}
ALSO_VERSIONS = {
    ("USDM", "4.0"): ("3.0",),
    ("SDTMIG", "3.3"): ("3.4",),
    ("SDTMIG", "3.4"): ("1.0",),
    ("SENDIG", "3.0"): ("1.0", "1.1", "1.2", "3.0", "3.1", "3.1.1"),
    ("SENDIG", "3.1"): ("1.0", "1.1", "1.2", "3.0", "3.1", "3.1.1"),
}
RUNNABLE = {"record_data", "dataset_metadata", "variable_metadata", "domain_presence", "value_metadata", "json_schema", "jsonata"}


def select_rules(rules: Sequence[Rule], include: Iterable[str] = (), exclude: Iterable[str] = ()) -> tuple[list[Rule], list[Result]]:
    """Rules by id, and a skipped result for each wanted id that is not there."""
    include, exclude = list(include), set(exclude)
    if include and exclude:
        raise ValueError("ids can be included or excluded, not both")
    if not include:
        return [r for r in rules if r.id not in exclude], []
    known = {r.id for r in rules}
    missing = [Result(i, "", "skipped", f"rule {i} was not found", skip_reason="rule_not_found") for i in dict.fromkeys(include) if i not in known]
    return [r for r in rules if r.id in set(include)], missing


def _takes(name: str, part: str, wanted: str) -> bool:
    return name == wanted or name in ALSO_NAMED.get(wanted, ()) or (name, part) in ALSO_PARTS.get(wanted, ())


def for_standard(rules: Sequence[Rule], standard: str | None, version: str | None = None, asked_for: bool = True) -> tuple[list[Rule], list[Result]]:
    """Rules that name the standard, or one it takes rules of, in the version or one that goes with it.

    The others are skipped; they give a result only if they were ``asked_for`` by id.
    """
    if not standard:
        return list(rules), []
    wanted, plain = standard.upper(), lambda v: v.strip().lower().lstrip("v").replace("-", ".")
    versions = {plain(version), *ALSO_VERSIONS.get((wanted, plain(version)), ())} if version else None
    kept, skipped = [], []
    for rule in rules:
        if any(_takes(name.upper(), part.upper(), wanted) and (versions is None or plain(v) in versions) for name, v, part in rule.standards):
            kept.append(rule)
        elif asked_for:
            skipped.append(Result(rule.id, "", "skipped", f"not a rule of {standard} {version or ''}".strip(), skip_reason="outside_standard"))
    return kept, skipped


def unsupported(rule: Rule) -> str:
    """The reason for which the rule can't run, or nothing."""
    if rule.rule_type not in RUNNABLE:
        return "unsupported_rule_type"
    if rule.sensitivity not in ("record", "dataset", "group"):
        return "unsupported_sensitivity"
    if any(ALIASES.get(leaf.operator, leaf.operator) not in OPERATORS for leaf in leaves(rule.conditions)):
        return "unsupported_operator"
    return ""


def _matches(pattern: str, name: str) -> bool:
    pattern, name = pattern.upper(), name.upper()
    if pattern == "ALL":
        return True
    if "--" in pattern:
        head, _, tail = pattern.partition("--")
        return name.startswith(head) and name.endswith(tail) and len(name) >= len(head) + len(tail)
    return pattern == name


def _within(scope: dict | Sequence[str], names: Sequence[str]) -> bool:
    included = scope.get("Include") or scope.get("include") or [] if isinstance(scope, dict) else list(scope)
    excluded = scope.get("Exclude") or scope.get("exclude") or [] if isinstance(scope, dict) else []
    hit = lambda patterns: any(_matches(p, n) for p in patterns for n in names)
    return (not included or hit(included)) and not hit(excluded)


def class_of(ds: Dataset) -> str | None:
    return CLASS_OF.get((ds.domain or ds.name).upper())


def _in_classes(scope: dict | Sequence[str], known: str) -> bool:
    """Class names are compared without spaces, underscores and hyphens; findings take findings about too."""
    plain = lambda name: re.sub(r"[ _-]", "", str(name)).upper()
    names = [plain(known), *(["FINDINGS"] if known == "FINDINGS ABOUT" else [])]
    listed = lambda key: [plain(x) for x in (scope.get(key) or scope.get(key.lower()) or [])] if isinstance(scope, dict) else [plain(x) for x in scope] if key == "Include" else []
    included, excluded = listed("Include"), listed("Exclude")
    return not any(x in names for x in excluded) and (not included or "ALL" in included or any(x in names for x in included))


def in_scope(rule: Rule, ds: Dataset) -> bool:
    """Whether the rule looks at the table; a table of unknown class is in every class."""
    names = [n for n in dict.fromkeys((ds.domain, ds.name)) if n]
    if rule.domains and not _within(rule.domains, names):
        return False
    known = class_of(ds)
    if rule.classes and known is not None and not _in_classes(rule.classes, known):
        return False
    return not rule.entities or _within(rule.entities, names)
