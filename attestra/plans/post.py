"""What a rule may do with its issues before they are counted: small functions of the issues DataFrame.

A manifest maps rule ids to names of hooks with their arguments; it is the user's, and empty by default.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.functions import scalars
from attestra.functions.scalars import quoted
from attestra.model import ORD, Dataset


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def one_per_variable(issues: DataFrame) -> DataFrame:
    return issues.withColumn("variables", F.explode(F.transform("variables", lambda v: F.array(v))))


def without_locators(issues: DataFrame) -> DataFrame:
    return issues.withColumns({"row": _null("long"), "usubjid": _null("string"), "seq": _null("string")})


def once_for_dataset(issues: DataFrame) -> DataFrame:
    """One issue without a place for each rule and table that has any."""
    first = issues.groupBy("rule_id", "dataset", "domain").agg(F.min_by("variables", "row").alias("variables"), F.min("message").alias("message"))
    return first.select("rule_id", "dataset", "domain", _null("long").alias("row"), "variables", "message", _null("string").alias("usubjid"), _null("string").alias("seq"))


def first_row_only(issues: DataFrame) -> DataFrame:
    rows = F.struct(*[F.col(c) for c in ("domain", "row", "variables", "message", "usubjid", "seq")])
    return issues.groupBy("rule_id", "dataset").agg(F.min_by(rows, "row").alias("r")).select("rule_id", "dataset", "r.*")


def repeated(issues: DataFrame, times: int) -> DataFrame:
    return issues.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(int(times))))).drop("__k")


def fixed_variables(issues: DataFrame, *names: str) -> DataFrame:
    """One issue for each of ``names``, in place of the variables found."""
    return issues.withColumn("variables", F.explode(F.array(*[F.array(F.lit(n)) for n in names])))


def at_row(issues: DataFrame, row: int) -> DataFrame:
    return issues.withColumn("row", F.lit(int(row)).cast("long"))


def shifted(issues: DataFrame, by: int) -> DataFrame:
    return issues.withColumn("row", F.col("row") + int(by))


def with_variable(issues: DataFrame, name: str) -> DataFrame:
    return issues.withColumn("variables", F.array_union("variables", F.array(F.lit(name))))


def without_variable(issues: DataFrame, name: str) -> DataFrame:
    return issues.withColumn("variables", F.array_remove("variables", name))


HOOKS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (one_per_variable, without_locators, once_for_dataset, first_row_only, fixed_variables, at_row, repeated, shifted, with_variable, without_variable)}


def from_manifest(manifest: dict[str, Sequence[Any]]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Hooks for ``validate``: by rule id, a list of names or of [name, argument, ...]."""

    def chain(steps: Sequence[Any]) -> Callable[[DataFrame], DataFrame]:
        named = [(s, ()) if isinstance(s, str) else (s[0], tuple(s[1:])) for s in steps]
        for name, _ in named:
            if name not in HOOKS:
                raise ValueError(f"unknown hook {name}")
        return lambda issues: reduce(lambda df, step: HOOKS[step[0]](df, *step[1]), named, issues)

    return {rule: chain(steps) for rule, steps in manifest.items()}


def overlapping(ds: Dataset, keys: Sequence[str], start: str, end: str) -> Dataset:
    """Rows whose interval meets another's of the same key: sorted by start, an interval meets one before it or after it.

    Starts and ends are texts that sort as dates; an empty end is open. The latest end before a row and
    the earliest start after it tell, so no pairs are made.
    """
    key = [F.coalesce(scalars.text(scalars.of_column(ds.df, ds.column(k)), None), F.lit("")) for k in keys]
    first, last = quoted(start), F.coalesce(F.when(quoted(end) != "", quoted(end)), F.lit("9999"))
    w = Window.partitionBy(*key).orderBy(first, ORD)
    df = ds.df.where(first.isNotNull()).withColumns({"__latest": F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1)), "__next": F.lead(first).over(w)})
    meets = F.coalesce(F.col("__latest") >= first, F.lit(False)) | F.coalesce(F.col("__next") <= last, F.lit(False))
    return ds.with_df(df.where(meets).drop("__latest", "__next"))


def conflicting(ds: Dataset, keys: Sequence[str], column: str) -> Dataset:
    """Rows whose group has another value of ``column`` too; empty values count as none. Groups are summed before the shuffle."""
    names = [f"__p{i}" for i in range(len(keys))]
    keyed = ds.df.withColumns({n: F.coalesce(scalars.text(scalars.of_column(ds.df, ds.column(k)), None), F.lit("")) for n, k in zip(names, keys, strict=True)})
    shown = F.nullif(scalars.text(scalars.of_column(ds.df, ds.column(column)), None), F.lit(""))
    groups = keyed.groupBy(*names).agg(F.min(shown).alias("__low"), F.max(shown).alias("__high")).where("__low < __high").select(*names)
    return ds.with_df(keyed.join(groups, names, "left_semi").drop(*names))
