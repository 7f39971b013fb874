"""Connected components of an edge table by alternating star contractions.

Each round replaces edges by edges to smaller neighbours (large star, then small star). Minima are
partial aggregates and the joins are plain equi-joins, so a node with very many neighbours is neither
collected nor held in one task's memory. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that has an edge; component is the smallest id that can be reached.

    ``edges`` has two long columns, a and b, without nulls. Loops and repeated edges are allowed; a
    node that has loops only is not returned. No edges give no rows.
    """
    now = materialize(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        now = materialize(_small_star(_large_star(now)).distinct(), "star")
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(stars.select("component", "component").toDF("id", "component").distinct())
