"""Row numbers over large ordered sets, whole or per key, without one task seeing a whole key."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.session import cut_lineage


def ordered_index(df: DataFrame, keys: list[str], order: list[Column], name: str = "ord") -> DataFrame:
    """Add a 1-based row number per key, in ``order``.

    One range shuffle sorts by key and order, so a hot key spreads over many partitions. The sorted rows are
    checkpointed: partition ids then stay what they are when a task runs again. Each (partition, key) run is
    numbered on its own; runs of a key that spans partitions get the count of the rows before them. Only the first and
    last key of a partition can span partitions, so that table grows with the partitions, not the rows, and is safe to
    broadcast.
    """
    ordering = [F.col(k) for k in keys] + order
    runs = cut_lineage(
        df.repartitionByRange(*ordering)
        .sortWithinPartitions(*ordering)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    run = keys + ["_part"]
    if keys:
        ends = runs.groupBy("_part").agg(F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi"))
        edge = ends.select(F.explode(F.array("lo", "hi")).alias("k")).select("k.*").distinct()
        # null keys are keys too
        at_edge = reduce(and_, [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys])
        border = runs.alias("r").join(F.broadcast(edge).alias("e"), at_edge, "left_semi").groupBy(*run).agg(F.count("*").alias("_n"))
        before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    else:
        border = runs.groupBy("_part").agg(F.count("*").alias("_n"))
        before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = border.select(*run, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy(*run).orderBy("_row")
    same_run = reduce(and_, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in run])
    return (
        runs.withColumn("_in_run", F.row_number().over(within))
        .alias("r").join(F.broadcast(carry).alias("c"), same_run, "left").select("r.*", "c._before")
        .withColumn(name, (F.col("_in_run") + F.coalesce("_before", F.lit(0))).cast("long"))
        .drop("_part", "_row", "_in_run", "_before")
    )


def assign_seq(df: DataFrame, order: list[Column], name: str = "seq") -> DataFrame:
    """Add a unique increasing integer in ``order`` (with gaps); fixed once by the checkpoint."""
    return cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    )
