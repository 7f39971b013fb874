"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

SPAN = 1 << 62


def labelled_sample(rows: DataFrame, label: str, per_label: int, by: tuple[str, ...] = ("doc_id", "text")) -> list[Row]:
    """About ``per_label`` rows of each label at most (all, where there are fewer), chosen by a hash of the columns ``by``.

    The share of each label that is wanted follows from its count, so one scan without a shuffle of
    texts finds the rows; the hash order then bounds them. The choice doesn't depend on partitions.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row for each label
    if not counts:
        return []
    mark = F.shiftrightunsigned(F.xxhash64(*by), 2)
    limit = F.lit(0).cast("long")
    for value, n in counts.items():
        share = min(1.0, 1.25 * per_label / n)
        limit = F.when(F.col(label) == value, F.lit(int(share * (SPAN - 1)))).otherwise(limit)
    chosen = rows.withColumns({"__mark": mark, "__limit": limit}).where("__mark <= __limit")
    return chosen.orderBy("__mark", "doc_id").limit(2 * per_label * len(counts)).drop("__mark", "__limit").collect()
