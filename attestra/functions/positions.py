"""1-based positions of rows in a total order, without one task that sees every row."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``; a local session without one gets a folder of its own. They go when the application ends."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="attestra-"))
    path = sc._jvm.org.apache.hadoop.fs.Path(sc._jsc.sc().getCheckpointDir().get())
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)


def scratch(spark: SparkSession) -> str:
    """A new folder among the checkpoints, which go when the application ends."""
    _use_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` evaluated once, its rows written to the checkpoint folder."""
    _use_checkpoints(df.sparkSession)
    return df.checkpoint()


def with_position(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Adds ``name``: the row's place in ``order`` (which should leave no ties), from 1.

    Rows are range-partitioned and sorted; a row's place in its partition, plus the rows of the
    partitions before it, is its position. Only one count for each partition meets in one place.
    The placed rows are checkpointed, as two plans of the same exchange need not give the same partitions.
    """
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    joined = placed.withColumn("__part", part).join(F.broadcast(before), "__part")  # one row for each partition
    return joined.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1).drop("__id", "__part", "__before")
