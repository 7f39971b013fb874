"""Scalars whose kind is known when a plan is made: null, bool, num or str.

All comparisons are two-valued: null equals null and nothing else, and no comparison gives null.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A finite number as text: optional sign, digits with an optional point, optional exponent.
# Fixed value: Unicode's white space.
WHITE_SPACE = " \t\n\u000b\u000c\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class Scalar:
    col: Column
    kind: str


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def of_column(df: DataFrame, name: str) -> Scalar:
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return Scalar(quoted(name), "bool")
    if isinstance(kind, (T.NumericType, T.DecimalType)):
        return Scalar(quoted(name).cast("double"), "num")
    if isinstance(kind, T.NullType):
        return Scalar(F.lit(None).cast("string"), "null")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return Scalar(F.date_format(quoted(name), "yyyy-MM-dd'T'HH:mm:ss"), "str")
    return Scalar(quoted(name).cast("string"), "str")


def of_value(value: Any) -> Scalar:
    if value is None:
        return Scalar(F.lit(None).cast("string"), "null")
    if isinstance(value, bool):
        return Scalar(F.lit(value), "bool")
    if isinstance(value, int | float):
        return Scalar(F.lit(float(value)), "num")
    return Scalar(F.lit(str(value)), "str")


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def strip(c: Column) -> Column:
    """Without leading and trailing white space, Unicode's included."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def number_text(c: Column) -> Column:
    """A double as the shortest plain text: 1, 1.5, never 1.0 or an exponent for whole numbers below 1e15."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(F.isnan(c), F.lit("NaN")).when(whole, F.when(c == 0, F.lit("0")).otherwise(c.cast("bigint").cast("string"))).otherwise(F.regexp_replace(c.cast("string"), r"\.0$", ""))


def text(s: Scalar, null: str | None = "null") -> Column:
    """The scalar as text; a null gives ``null`` (None: stays null)."""
    if s.kind == "num":
        out = number_text(s.col)
    elif s.kind == "bool":
        out = s.col.cast("string")
    else:
        out = s.col
    return out if null is None else F.coalesce(out, F.lit(null))


def number(s: Scalar) -> Column:
    """The scalar as a finite number, else null; text counts if all of it is one."""
    if s.kind == "num":
        return F.when(F.abs(s.col) < float("inf"), s.col)
    if s.kind == "str":
        plain = strip(s.col)
        value = F.when(plain.rlike(NUMBER), plain.try_cast("double"))
        return F.when(F.abs(value) < float("inf"), value)
    return F.lit(None).cast("double")


def is_empty(s: Scalar) -> Column:
    return (s.col.isNull() | (s.col == "")) if s.kind in ("str", "null") else s.col.isNull()


def parts(c: Column) -> Column:
    """The parts of an ``a|b`` text, stripped."""
    return F.transform(F.split(c, r"\|"), strip)


def as_list(s: Scalar) -> Column:
    """List texts: the parts of ``a|b`` without empty ones, nothing for blank text, else the value itself."""
    whole = text(s)
    if s.kind not in ("str", "null"):
        return F.array(whole)
    blank = two_valued(strip(s.col) == "")
    many = two_valued(s.col.contains("|"))
    return F.when(many, F.filter(parts(s.col), lambda p: p != "")).when(blank, F.array().cast("array<string>")).otherwise(F.array(whole))


def _same(a: Scalar, b: Scalar, fold: bool) -> Column:
    if "null" in (a.kind, b.kind):
        return a.col.isNull() & b.col.isNull()
    both_null = a.col.isNull() & b.col.isNull()
    if a.kind == b.kind:
        left, right = (ascii_lower(a.col), ascii_lower(b.col)) if fold and a.kind == "str" else (a.col, b.col)
        return both_null | two_valued(left == right)
    if {a.kind, b.kind} == {"bool", "str"}:
        flag, word = (a.col, b.col) if a.kind == "bool" else (b.col, a.col)
        said = ascii_lower(strip(word))
        return both_null | two_valued(F.when(said == "true", flag).when(said == "false", ~flag).otherwise(False))
    return both_null


def equal(a: Scalar, b: Scalar, fold: bool = False, loose: bool = False) -> Column:
    """Equality; ``fold`` ignores ASCII case, ``loose`` lets number-like text equal numbers."""
    same = _same(a, b, fold)
    if not loose:
        return same
    left, right = number(a), number(b)
    return F.when(left.isNotNull() & right.isNotNull(), left == right).otherwise(same)


def within(a: Scalar, b: Scalar, fold: bool = False, loose: bool = False) -> Column:
    """Equality, or membership where ``b`` is an ``a|b`` text; a member equals as text too."""
    same = equal(a, b, fold, loose)
    if b.kind != "str":
        return same
    if a.kind == "str":
        left = ascii_lower(a.col) if fold else a.col
        member = F.exists(parts(ascii_lower(b.col) if fold else b.col), lambda p: p == left)
        if loose:
            member = member | F.exists(parts(b.col), lambda p: equal(a, Scalar(p, "str"), fold, True))
    elif a.kind == "null":
        member = F.lit(False)
    else:
        member = F.exists(parts(b.col), lambda p: equal(a, Scalar(p, "str"), fold, loose))
    return same | two_valued(b.col.contains("|") & member)


def compare(a: Scalar, b: Scalar, operator: str) -> Column:
    """Order as numbers if both are number-like, as text if both are text, else false."""
    ops = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    left, right = number(a), number(b)
    as_text = ops[operator](a.col, b.col) if a.kind == b.kind == "str" else F.lit(False)
    return two_valued(F.when(left.isNotNull() & right.isNotNull(), ops[operator](left, right)).otherwise(as_text))
