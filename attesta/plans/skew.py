"""Joins that stay even when one key holds a large share of the rows.

How far a key is spread follows from its own rows, and no key is left out: the keys to spread are a table that is joined like any other, so
Spark ships it whole or shuffles it by its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.plans.sqlrun import run_sql
from attesta.session import cut_lineage

ROWS_PER_TASK = 100_000  # rows of one key that one task takes in a lookup
BLOCK = 5_000            # rows of one key on each side of a cell of pairs


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, weight: str, spread: str, rows_per_task: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``lookup`` (one row per key; ``weight`` = rows of that key).

    Rows of a key are spread over as many tasks as its weight asks for by a hash of ``spread``, and meet copies of its one lookup row.
    """
    rows_per_task = rows_per_task or ROWS_PER_TASK
    salts = F.ceil(F.col("_n") / rows_per_task).cast("int")
    large = cut_lineage(lookup.select(F.col(key), F.col(weight).cast("long").alias("_n")).where(F.col("_n") > rows_per_task))
    left = rows.join(large, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), salts), F.lit(0)).cast("int")).drop("_n")
    copies = F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)
    right = lookup.join(large, key, "left").withColumn("_salt", F.explode(copies)).drop("_n")
    return left.join(right, [key, "_salt"]).drop("_salt")


def split_pairs(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Give both sides of a many-to-many equi join two cell columns that spread large keys.

    The rows of a key on either side form blocks of about ``block``. A row goes to its own block on one axis and to every
    block on the other, so each pair of rows meets in exactly one cell, and a cell has about block x block pairs. Join on
    (key, _ci, _cj). Keys with no more pairs than that have one cell.
    """
    block = block or BLOCK
    counts = run_sql(
        f"""
        SELECT {key}, sum(l) AS nl, sum(r) AS nr FROM (SELECT {key}, 1L AS l, 0L AS r FROM @left UNION ALL SELECT {key}, 0L, 1L FROM @right)
        GROUP BY {key} HAVING sum(l) * sum(r) > {block * block}L
        """,
        left=left, right=right,
    )
    large = cut_lineage(counts.selectExpr(key, f"cast(ceil(nl / {block}) AS INT) AS _bl", f"cast(ceil(nr / {block}) AS INT) AS _br"))

    def cells(df: DataFrame, row_id: str, own: str, own_blocks: str, every: str, every_blocks: str) -> DataFrame:
        return df.join(large, key, "left").selectExpr(
            "*", f"cast(pmod(xxhash64({row_id}), coalesce({own_blocks}, 1)) AS INT) AS {own}", f"explode(sequence(0, coalesce({every_blocks}, 1) - 1)) AS {every}"
        ).drop("_bl", "_br")

    return cells(left, left_id, "_ci", "_bl", "_cj", "_br"), cells(right, right_id, "_cj", "_br", "_ci", "_bl")
