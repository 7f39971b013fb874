"""Equi-joins of tables: null keys never match, text never equals a number, left order is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions import scalars
from attestra.functions.scalars import quoted
from attestra.model import ORD, Dataset, MissingColumn

KINDS = {"left_join": "left", "join": "left", "dataset_join": "left", "merge": "left", "lookup": "left", "match_dataset": "left", "match_datasets": "left", "inner_join": "inner", "semi_join": "left_semi", "anti_join": "left_anti"}


def keys_of(left: Dataset, right: Dataset, left_by: Sequence[str], right_by: Sequence[str]) -> tuple[Column, list[str]]:
    """The join condition over the right side's renamed keys, and the right side's key columns."""
    condition, names = F.lit(True), []
    for i, (a, b) in enumerate(zip(left_by, right_by, strict=True)):
        mine, theirs = left.column(a), right.column(b)
        if mine is None or theirs is None:
            raise MissingColumn(a if mine is None else b)
        x, y = scalars.of_column(left.df, mine), scalars.of_column(right.df, theirs)
        condition = condition & ((x.col == F.col(f"__r{i}")) if x.kind == y.kind else F.lit(False))
        names.append(theirs)
    return condition, names


def join(left: Dataset, right: Dataset, how: str, left_by: Sequence[str], right_by: Sequence[str] | None = None, prefix: str | None = None) -> Dataset:
    """Left, inner, semi or anti join.

    Columns of the right side get ``prefix`` (its name and a point, if none is given); its keys go if
    there is a prefix. Without one (the empty text) a name that the left side has gets ``_right``,
    ``_right_2`` and so on. Rows follow the left side's order, then the right side's.
    """
    how, right_by = KINDS.get(how, how), right_by or left_by
    prefix = f"{right.name}." if prefix is None else prefix
    condition, keys = keys_of(left, right, left_by, right_by)
    typed = [scalars.of_column(right.df, k).col.alias(f"__r{i}") for i, k in enumerate(keys)]
    if how in ("left_semi", "left_anti"):
        return left.with_df(left.df.join(right.df.select(*typed), condition, how))
    taken, shown = set(left.columns), []
    for c in right.columns:
        if c in keys and prefix:
            continue
        name, k = f"{prefix}{c}", 1
        while name in taken:
            name, k = f"{prefix}{c}_right" + (f"_{k}" if k > 1 else ""), k + 1
        taken.add(name)
        shown.append(quoted(c).alias(name))
    other = right.df.select(*typed, *shown, F.col(ORD).alias("__right_ord"))
    both = left.df.withColumnRenamed(ORD, "__left_ord").join(other, condition, how).drop(*[f"__r{i}" for i in range(len(keys))])
    order = F.struct(F.col("__left_ord").alias("left"), F.col("__right_ord").alias("right"))  # a struct sorts by its parts, so no row has to be numbered
    return left.with_df(both.withColumn(ORD, order).drop("__left_ord", "__right_ord"))


def match_all(left: Dataset, others: Sequence[tuple[Dataset, Sequence[str]]]) -> Dataset:
    """Left joins of several tables in turn; without keys, by the columns both sides have."""
    for other, keys in others:
        by = list(keys) or [c for c in left.columns if other.column(c) is not None]
        left = join(left, other, "left", by)
    return left


def supplemental(parent: Dataset, supp: Dataset, subject: str = "USUBJID") -> Dataset:
    """Rows of a supplemental-qualifier table with their parent rows.

    IDVAR names the parent's column and IDVARVAL its value, so the parent's named columns become rows
    of (subject, name, value); a blank IDVAR means every row of the subject.
    """
    named = [r[0] for r in supp.df.select("IDVAR").distinct().collect() if r[0] and parent.column(r[0])]  # names of columns
    stacked = F.array(*[F.struct(F.lit(n).alias("v"), scalars.text(scalars.of_column(parent.df, parent.column(n)), None).alias("x")) for n in named], F.struct(F.lit("").alias("v"), F.lit("").alias("x")))
    rows = parent.df.select(quoted(subject).alias("__s"), F.explode(stacked).alias("k"), *[quoted(c).alias(f"{parent.name}.{c}") for c in parent.columns if c != subject])
    same = (quoted(subject) == F.col("__s")) & (F.coalesce("IDVAR", F.lit("")) == F.col("k.v")) & (F.coalesce(F.col("IDVARVAL").cast("string"), F.lit("")) == F.col("k.x"))
    return supp.with_df(supp.df.join(rows, same, "left").drop("__s", "k"))


def related_rows(relations: Dataset, tables: Sequence[Dataset], subject: str = "USUBJID") -> Dataset:
    """Rows of a relation table (RDOMAIN, subject, IDVAR, IDVARVAL) with __found: whether a row of the named table has that value.

    The columns that relations name in a table are stacked to (table, subject, name, value) and joined
    once; a blank IDVAR asks for any row of the subject, a blank subject for any subject's.
    """
    named = {(r[0] or "").upper(): [] for r in relations.df.select("RDOMAIN").distinct().collect()}
    for domain, name in relations.df.select("RDOMAIN", "IDVAR").distinct().collect():  # names of tables and columns
        if name:
            named[(domain or "").upper()].append(name)
    stacked = None
    for table in tables:
        domain = (table.domain or table.name).upper()
        if domain not in named:
            continue
        columns = [F.struct(F.lit(n).alias("v"), scalars.text(scalars.of_column(table.df, table.column(n)), None).alias("x")) for n in named[domain] if table.column(n)]
        key = F.coalesce(quoted(table.column(subject)).cast("string"), F.lit("")) if table.column(subject) else F.lit("")
        values = F.array(*columns, F.struct(F.lit("").alias("v"), F.lit("").alias("x")))
        rows = table.df.select(F.lit(domain).alias("__d"), F.array_distinct(F.array(key, F.lit(""))).alias("s"), F.explode(values).alias("k")).select("__d", "k", F.explode("s").alias("__s"))
        rows = rows.select("__d", "__s", F.col("k.v").alias("__v"), F.coalesce("k.x", F.lit("")).alias("__x")).distinct()
        stacked = rows if stacked is None else stacked.unionByName(rows)
    if stacked is None:
        return relations.with_df(relations.df.withColumn("__found", F.lit(False)))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    same = (F.upper(plain("RDOMAIN")) == F.col("__d")) & (plain(subject) == F.col("__s")) & (plain("IDVAR") == F.col("__v")) & (plain("IDVARVAL") == F.col("__x"))
    return relations.with_df(relations.df.join(stacked, same, "left").withColumn("__found", F.col("__d").isNotNull()).drop("__d", "__s", "__v", "__x"))


def union_of_splits(tables: Sequence[Dataset], domain: str) -> Dataset:
    """The parts of a domain that is split over several tables as one table, with __table and rows in table order."""
    split = [t for t in tables if (t.domain or t.name).upper() == domain.upper()]
    if not split:
        raise MissingColumn(domain)
    out = None
    for i, t in enumerate(split):
        df = t.df.withColumns({ORD: F.struct(F.lit(i).alias("part"), F.col(ORD).alias("row")), "__table": F.lit(t.name)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return split[0].with_df(out)
