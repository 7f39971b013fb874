"""Tables with their metadata, rules, conditions and results."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

#: Hidden column that keeps the order of a table's rows.
ORD = "__ord"
#: Column that carries the row of the source through joins, where a rule wants it.
SOURCE_ROW = "__source_row"


class RuleError(ValueError):
    """A rule that can't be read or run; ``reason`` is the skip reason it gives."""

    def __init__(self, message: str, reason: str = "evaluation_error"):
        super().__init__(message)
        self.reason = reason


class MissingColumn(RuleError):
    def __init__(self, column: str):
        super().__init__(f"no column {column}", "missing_column")
        self.column = column


@dataclass(frozen=True)
class Variable:
    name: str
    label: str = ""
    type: str = ""
    length: int | None = None
    extra: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Dataset:
    """A table, its order column and what is known of it besides its rows."""

    name: str
    df: DataFrame
    domain: str | None = None
    label: str = ""
    filename: str = ""
    source_format: str = ""
    variables: tuple[Variable, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    def with_df(self, df: DataFrame) -> Dataset:
        return replace(self, df=df)

    def column(self, name: str, exact: bool = False) -> str | None:
        """The table's own spelling of ``name``: exact, else the first that differs in ASCII case only."""
        name = expand(name, self.domain)
        if name in self.columns:
            return name
        if exact:
            return None
        return next((c for c in self.columns if c.isascii() and name.isascii() and c.lower() == name.lower()), None)


def expand(name: str, domain: str | None) -> str:
    """``--XX`` names the domain's own variable."""
    return f"{(domain or '')}{name[2:]}" if name.startswith("--") and domain else name


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class ColumnRef:
    name: str


@dataclass(frozen=True)
class Values:
    values: tuple[Any, ...]


@dataclass(frozen=True)
class NoValue:
    pass


@dataclass(frozen=True)
class Terms:
    """A list of any length, as a table with the column ``term``."""

    df: DataFrame


@dataclass(frozen=True)
class Leaf:
    target: str
    operator: str
    comparator: Literal | ColumnRef | Values | NoValue | Terms = NoValue()
    options: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class All:
    parts: tuple[Any, ...]


@dataclass(frozen=True)
class AnyOf:
    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Not:
    part: Any


Condition = Leaf | All | AnyOf | Not


def leaves(condition: Condition) -> list[Leaf]:
    if isinstance(condition, Leaf):
        return [condition]
    if isinstance(condition, Not):
        return leaves(condition.part)
    return [leaf for part in condition.parts for leaf in leaves(part)]


@dataclass(frozen=True)
class Rule:
    id: str
    conditions: Condition
    message: str = ""
    rule_type: str = "record_data"
    sensitivity: str = "record"
    operations: tuple[dict[str, Any], ...] = ()
    match_datasets: tuple[dict[str, Any], ...] = ()
    domains: dict[str, Any] = field(default_factory=dict)
    classes: dict[str, Any] = field(default_factory=dict)
    entities: dict[str, Any] = field(default_factory=dict)
    standards: tuple[tuple[str, str, str], ...] = ()  # name, version, part
    output_variables: tuple[str, ...] = ()
    status: str = ""
    description: str = ""
    executability: str = ""
    use_case: str = ""


@dataclass
class Result:
    """One rule on one table; ``issues`` is a lazy DataFrame or None where nothing ran."""

    rule_id: str
    dataset: str
    status: str  # passed, failed or skipped
    message: str = ""
    issues: DataFrame | None = None
    error_count: int = 0
    skip_reason: str = ""
    provenance: str = "native"
