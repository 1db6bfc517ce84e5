"""Near-duplicate vectors by tiles of int8 products with error bounds.

1. Vectors with the same components are one node with a number of copies. A vector that is null, empty, zero, or holds null or non-finite components
   is no node. Nodes are numbered per dimension and dealt to blocks of ``BLOCK`` vectors.
2. A block is a set of arrays in the shared folder that workers map: unit vectors in double precision, the same rounded to int8 with a scale for each
   vector, and the length of what rounding left over. Tasks get pairs of blocks (a number and a range of numbers), no vectors, so nothing of the
   quadratic part is shuffled.
3. A tile multiplies the int8 values of two blocks. With x = x' + e and y = y' + f (primes are the rounded vectors), x.y differs from x'.y' by at most |x'| |f| + |e| |y|. Pairs
   whose sum of product and bound stays under the threshold are no links, all others are computed again in double precision.
4. A tile passes on how many links each vector has, and one link to the first vector of each connected part; pairs are never listed.

The product of int8 values runs in floating point, where it is exact: sums of up to 1040 products stay below 2^24, longer vectors are cut into such parts.
Work grows with the square of the distinct vectors of a dimension, as a comparison of all with all must; every tile is a task of its own.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.files import shared_folder
from attesta.llm.simhash import components
from attesta.plans.ordered import ordered_index
from attesta.plans.skew import salted_lookup
from attesta.session import cut_lineage

THRESHOLD = 0.95
BLOCK = 2048
#: Blocks that one row of tile work compares with the first one.
TILES_A_ROW = 8
MOST_TASKS = 20_000
#: Rounding of sums in double precision, added to the bound.
SLACK = 1e-9
_EXACT = 1040


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; they are first scaled by their largest component, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, the scale of each row, the length of the rounded row and the length of what rounding left over."""
    scale = np.abs(units).max(axis=1) / 127
    values = np.rint(units / scale[:, None]).astype(np.int8)
    rounded = values * scale[:, None]
    rest = units - rounded
    return values, scale, np.sqrt(np.einsum("ij,ij->i", rounded, rounded)), np.sqrt(np.einsum("ij,ij->i", rest, rest))


def int_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of int8 rows, exact."""
    out = np.zeros((len(a), len(b)), np.float32 if a.shape[1] <= _EXACT else np.float64)
    for k in range(0, a.shape[1], _EXACT):
        out += a[:, k : k + _EXACT].astype(np.float32) @ b[:, k : k + _EXACT].astype(np.float32).T
    return out


class Block:
    """The arrays of one block, mapped."""

    NAMES = ("unit", "value", "scale", "rounded", "rest", "node", "copies")

    def __init__(self, folder: str, dim: int, number: int):
        self.unit, self.value, self.scale, self.rounded, self.rest, self.node, self.copies = (np.load(f"{folder}/{dim}-{number}-{n}.npy", mmap_mode="r") for n in self.NAMES)


def tile_links(a: Block, b: Block, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the linked pairs of two blocks; of a block with itself those above the diagonal."""
    near = int_products(a.value, b.value) * a.scale[:, None] * b.scale[None, :]
    near += a.rounded[:, None] * b.rest[None, :]
    near += a.rest[:, None]  # unit vectors: |y| = 1
    left, right = np.nonzero(near >= threshold - SLACK)
    if same:
        above = left < right
        left, right = left[above], right[above]
    linked = np.zeros(len(left), bool)
    for k in range(0, len(left), 1 << 16):
        some = slice(k, k + (1 << 16))
        linked[some] = np.einsum("ij,ij->i", a.unit[left[some]], b.unit[right[some]]) >= threshold
    return left[linked], right[linked]


def part_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For numbers below ``n``, the smallest one reachable over the links."""
    labels = np.arange(n)
    while True:
        was = labels.copy()
        np.minimum.at(labels, left, labels[right])
        np.minimum.at(labels, right, labels[left])
        labels = labels[labels]
        if (labels == was).all():
            return labels


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id``, ``key`` (SHA-256 of the components; null for what is no node) and ``vector`` of rows (id, vector)."""
    for batch in batches:
        column = batch.column(1).cast(pa.list_(pa.float64()))
        offsets = column.offsets.to_numpy()
        values = column.values.fill_null(np.nan).to_numpy(zero_copy_only=False) + 0.0  # -0.0 becomes 0.0
        bad, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(values), values != 0))
        first, last = offsets[:-1], offsets[1:]
        good = (bad[first] == bad[last]) & (some[first] < some[last]) & column.is_valid().to_numpy(zero_copy_only=False)
        keys = [hashlib.sha256(values[a:b]).digest() if g else None for a, b, g in zip(first, last, good, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), column], ["id", "key", "vector"])


def _storing(folder: str):
    """Write the arrays of each block of rows (dim, block, node, copies, vector), sorted; files get their name when they are whole."""

    def write(dim: int, number: int, rows: pa.Table) -> pa.RecordBatch:
        units = unit_vectors(rows.column("vector").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(rows.num_rows, dim))
        arrays = (units, *quantised(units), rows.column("node").to_numpy(), rows.column("copies").to_numpy())
        for name, array in zip(Block.NAMES, arrays, strict=True):
            path = f"{folder}/{dim}-{number}-{name}.npy"
            with open(draft := f"{path}.{uuid.uuid4().hex}", "wb") as file:
                np.save(file, array)
            os.replace(draft, path)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([number], pa.int64())], ["dim", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now: tuple[int, int] | None = None
        for batch in batches:
            place = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            edge = [0, *[k for k in range(1, len(place)) if place[k] != place[k - 1]], len(place)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if a == b:
                    continue
                if now is not None and place[a] != now:
                    yield write(*now, pa.concat_tables(held))
                    held = []
                now = place[a]
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if now is not None:
            yield write(*now, pa.concat_tables(held))

    return run


def _tiling(folder: str, threshold: float):
    """``u``, ``v`` and ``n``: numbers of links (``v`` null) and links to the first vector of a part (``n`` null) of rows (dim, block, first, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, number, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = Block(folder, dim, number)
                for other in range(first, last + 1):
                    b = a if other == number else Block(folder, dim, other)
                    left, right = tile_links(a, b, threshold, other == number)
                    if not len(left):
                        continue
                    node = np.concatenate([a.node, b.node]) if b is not a else np.asarray(a.node)
                    shift = len(a.node) if b is not a else 0
                    n = np.bincount(left, b.copies[right], len(node)) + np.bincount(right + shift, a.copies[left], len(node))
                    root = part_roots(len(node), left, right + shift)
                    some, moved = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(node)))
                    u, v = np.concatenate([node[some], node[moved]]), np.concatenate([node[some], node[root[moved]]])
                    counts = np.concatenate([n[some].astype(np.int64), np.zeros(len(moved), np.int64)])
                    is_count = np.arange(len(u)) < len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=is_count), pa.array(counts, mask=~is_count)], ["u", "v", "n"])

    return run


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per row: id, ``n_links`` (other rows within the threshold), ``component_id`` (smallest id reachable over links, itself included), ``kept`` (its id is that).

    Vectors are compared by the cosine in double precision; those that are null, empty, zero, or hold null or non-finite components, and those of
    another dimension, link with nothing. Equal vectors, and repeated rows, link with each other. A row without an id links like any other, but is never kept; a
    component in which no row has an id has a null ``component_id``. An empty table gives no rows. Other columns are left out.
    """
    spark = table.sparkSession
    id_type = table.schema[id_col].dataType.simpleString()
    read = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).mapInArrow(_reading, f"id {id_type}, key binary, vector array<double>")
    rows = cut_lineage(read.select("id", "key"))
    nodes = read.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("vector").alias("vector"))
    numbered = ordered_index(nodes.withColumn("dim", F.size("vector")), ["dim"], [F.col("key")], "ord")
    numbered = cut_lineage(numbered.withColumns({"node": F.shiftleft(F.col("dim").cast("long"), 40) + F.col("ord"), "block": F.floor((F.col("ord") - 1) / block)}))
    folder = shared_folder(spark, "vectors")
    dealt = numbered.select("dim", "block", "node", "copies", "vector").repartition("dim", "block").sortWithinPartitions("dim", "block", "node")
    blocks = cut_lineage(dealt.mapInArrow(_storing(folder), "dim int, block long"))
    many = blocks.groupBy("dim").agg(F.max("block").alias("top"))
    work = blocks.join(many, "dim").select("dim", "block", F.explode(F.sequence("block", "top", F.lit(TILES_A_ROW).cast("long"))).alias("first"), "top")
    work = cut_lineage(work.select("dim", "block", "first", F.least(F.col("first") + TILES_A_ROW - 1, "top").alias("last")))
    tasks = max(1, min(work.count(), MOST_TASKS))  # rows are few bytes and much work: their size says nothing
    found = cut_lineage(work.repartition(tasks, "dim", "block", "first").mapInArrow(_tiling(folder, threshold), "u long, v long, n long"))
    count = found.where("n IS NOT NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    star = components(found.where("v IS NOT NULL").select("u", "v").distinct())
    rooted = numbered.select("node", "key", "copies", "least").join(star, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    judged = rooted.join(smallest, "root").join(count, "node", "left")
    judged = cut_lineage(judged.select("key", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"))
    placed = salted_lookup(rows.where("key IS NOT NULL"), judged, "key", "copies", "id").select("id", "n_links", "component_id")
    alone = rows.where("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return placed.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


#: The same in SQL for DuckDB: all pairs, so for small tables.
ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}
), reach AS (
  SELECT a AS r, b AS s FROM links UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.s = links.a
), least AS (
  SELECT v.r, least(v.vec_id, min(w.vec_id)) AS component_id FROM v LEFT JOIN reach ON v.r = reach.r LEFT JOIN v w ON w.r = reach.s GROUP BY v.r, v.vec_id
), counted AS (
  SELECT a AS r, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN least ON v.r = least.r LEFT JOIN counted ON v.r = counted.r
"""
