"""Sharding by longest processing time: groups that must stay together go, largest first, to the least-loaded shard.

The heap sees a bounded number of units. A group of at least a ``UNITS``-th of a shard is a unit of its own (there cannot be more than
shards x UNITS); smaller groups, sorted by size, are cut by their running total into units of about that many bytes. Law: bytes.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.plans.ordered import ordered_index
from attesta.session import cut_lineage

SHARDS = 40
UNITS = 512
ROW_BYTES = 16


def longest_first(sizes: list[int], shards: int) -> list[int]:
    """The shard of each unit: largest first, to the least-loaded shard, the lowest number on ties."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for unit in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard = heapq.heappop(heap)
        out[unit] = shard
        heapq.heappush(heap, (load + sizes[unit], shard))
    return out


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before each, in ``order``: one range shuffle, sums in partitions, and a carry of one row a partition."""
    sorted_ = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    carry = sorted_.groupBy("_part").agg(F.sum(value).alias("_sum"))
    carry = carry.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_carry"))
    within = F.coalesce(F.sum(value).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sorted_.withColumn(name, within).join(F.broadcast(carry), "_part").withColumn(name, F.col(name) + F.col("_carry")).drop("_part", "_carry")


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per row: id, ``size``, ``text_crc32``, ``law`` (bytes), ``shard``, ``slot`` (gapless from 0 in the order of id), ``grown_shard`` (null).

    ``size`` is the UTF-8 bytes of the text plus 16; a null text has no bytes and a null checksum, and all null texts are one group. Equal texts stay
    together, however large their group; repeated rows too. An empty table gives no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = cut_lineage(
        docs.select(
            F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("key"),
        )
    )
    groups = cut_lineage(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    unit_bytes = max(1, total // (shards * UNITS))
    large = groups.where(F.col("bytes") >= unit_bytes)
    small = groups.where(F.col("bytes") < unit_bytes).select("key", "bytes", (-F.col("bytes")).alias("down"))
    small = cut_lineage(running_total(small, ["down", "key"], "bytes", "before").select("key", "bytes", F.floor(F.col("before") / unit_bytes).alias("unit")))
    # at most 2 * shards * UNITS + 1 rows come to the driver
    units = large.select("key", F.lit(None).cast("long").alias("unit"), "bytes").unionByName(small.groupBy("unit").agg(F.sum("bytes").alias("bytes")).select(F.lit(None).cast("binary").alias("key"), "unit", "bytes"))
    table = units.orderBy(F.desc("bytes"), "unit", "key").toArrow().to_pydict()
    chosen = longest_first(table["bytes"], shards)
    placed = spark.createDataFrame([(None if k is None else bytearray(k), u, s) for k, u, s in zip(table["key"], table["unit"], chosen, strict=True)], "key binary, unit long, shard int")
    # groups of their own are few and may hold any share of the rows: their shards go to the rows; only rows of small groups are shuffled
    large_shards = placed.where("key IS NOT NULL").select("key", F.col("shard").alias("large_shard"))
    met = rows.join(F.broadcast(large_shards), "key", "left")
    cut = small.join(F.broadcast(placed.where("unit IS NOT NULL").select("unit", "shard")), "unit").select("key", "shard")
    columns = ["id", "size", "text_crc32"]
    sharded = met.where("large_shard IS NULL").join(cut, "key").select(*columns, "shard").unionByName(met.where("large_shard IS NOT NULL").select(*columns, F.col("large_shard").alias("shard")))
    slotted = ordered_index(sharded, ["shard"], [F.col("id"), F.col("text_crc32"), F.col("size")], "slot")
    return slotted.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
