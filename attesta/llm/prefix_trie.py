"""The trie of conversation prefixes, with totals of every subtree by parallel tree contraction.

Conversations are rebuilt from the first turns of a shared one and their own. Turns become digests where they are read, so no text is
shuffled. A node is a set of conversations with equal first turns; it is named by two 64-bit hashes over (depth, digest), running along the
conversation, and by an induction over the depths the names are proven: all members of a node have one last digest and one node above.

Subtree totals are sums. A round of contraction rakes (leaves give their total to the node above and end) and compresses (nodes with a single child
whose random number beats those of the single-child nodes beside them are bridged: the node above takes their own sum, their child gets a new parent). The
number of rounds follows the logarithm of the nodes, however deep or wide the trie is. Bridged nodes get their totals in the opposite order, each from the child it
had. Rounds are written to the shared folder.

A conversation with a large share of all turns is spread over tasks: positions and running hashes come from sorts by range with a carry for each partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.plans.ordered import ordered_index
from attesta.plans.skew import salted_lookup
from attesta.session import cut_lineage

#: Every so many conversations share the first turns of one of them; at most SHARED - 1 turns.
FAMILY, SHARED = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Ids of conversations that are joined into one piece of text before a digest goes over them.
PIECE = 4096


def _digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the length of the role keeps role and text apart."""
    return F.unhex(F.sha2(F.concat_ws("", F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def shared_turns(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % SHARED).cast("int")


def rebuilt_turns(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, depth, digest, words) of the rebuilt conversations, and (conv, length) of all of them; a conversation may have no turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = table.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), _digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    placed = ordered_index(turns, ["conv"], [F.col("turn").asc_nulls_first(), F.col("digest")], "at").drop("turn")
    sizes = cut_lineage(turns.groupBy("conv").agg(F.count("*").alias("own")).withColumns({"shared": shared_turns(F.col("conv")), "base": F.col("conv") - F.col("conv") % FAMILY}))
    # the base of a family is one row, its members are at most 2 * FAMILY - 1
    known = sizes.alias("s").join(sizes.select(F.col("conv").alias("base"), F.col("own").alias("base_own")), "base", "left")
    known = cut_lineage(known.select("conv", "base", "own", "shared", F.least("shared", F.coalesce("base_own", F.lit(0))).alias("taken")))
    placed = cut_lineage(placed)
    first = placed.where(F.col("at") < SHARED).select(F.col("conv").alias("base"), "at", "digest", "words")
    given = known.where("taken > 0").join(first, "base").where("at <= taken").select("conv", F.col("at").alias("depth"), "digest", "words")
    later = salted_lookup(placed, known.select("conv", "own", "shared", "taken"), "conv", "own", "at").where("at > shared")
    rows = given.unionByName(later.select("conv", (F.col("at") - F.col("shared") + F.col("taken")).alias("depth"), "digest", "words"))
    return rows, known.select("conv", (F.col("taken") + F.greatest(F.col("own") - F.col("shared"), F.lit(0))).alias("length"))


def _running_names(rows: DataFrame) -> DataFrame:
    """``rows`` with ``name`` of the node at each turn and ``above``, the name before it (null at depth one)."""
    one = [F.xxhash64(F.lit(seed), "depth", "digest") for seed in (1, 2)]
    sorted_ = cut_lineage(
        rows.withColumns({"a": one[0], "b": one[1]}).repartitionByRange("conv", "depth").sortWithinPartitions("conv", "depth").withColumn("_part", F.spark_partition_id())
    )
    # only the first and the last conversation of a partition can span partitions: these tables grow with the partitions
    parts = sorted_.groupBy("_part").agg(F.min("conv").alias("low"), F.max("conv").alias("high"))
    edge = parts.select(F.explode(F.array("low", "high")).alias("conv")).distinct()
    before = W.partitionBy("conv").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = sorted_.join(F.broadcast(edge), "conv", "left_semi").groupBy("conv", "_part").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    carry = runs.select("conv", "_part", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "ab"])
    along = W.partitionBy("conv", "_part").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = sorted_.withColumns({"ra": F.bit_xor("a").over(along), "rb": F.bit_xor("b").over(along)}).join(F.broadcast(carry), ["conv", "_part"], "left")
    full = summed.withColumns({"ra": F.col("ra").bitwiseXOR(F.coalesce("a_before", F.lit(0))), "rb": F.col("rb").bitwiseXOR(F.coalesce("b_before", F.lit(0)))})

    def name(a: Column, b: Column, depth: Column) -> Column:
        return F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (a, b, depth)]))

    here = name(F.col("ra"), F.col("rb"), F.col("depth"))
    above = F.when(F.col("depth") > 1, name(F.col("ra").bitwiseXOR(F.col("a")), F.col("rb").bitwiseXOR(F.col("b")), F.col("depth") - 1))
    return full.select("conv", "depth", "digest", "words", here.alias("name"), above.alias("above"))


def trie_nodes(named: DataFrame) -> DataFrame:
    """(name, above, depth, conv, n_convs, words) of each node under the root, from the turns with the names of their nodes."""
    nodes = named.groupBy("name").agg(
        F.min("above").alias("above"), F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("words").alias("words"),
        F.min("digest").alias("d0"), F.max("digest").alias("d1"), F.max("above").alias("above1"),
    )
    proven = F.col("d0").eqNullSafe(F.col("d1")) & F.col("above").eqNullSafe(F.col("above1"))
    return cut_lineage(nodes.withColumn("_ok", F.when(proven, True).otherwise(F.raise_error(F.lit("two prefixes share 128 bits of hash")).cast("boolean"))).where("_ok").drop("d0", "d1", "above1", "_ok"))


def subtree_totals(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``node`` and for each of ``sums`` the total over its subtree. ``nodes``: node and parent (binary; the parent of a root is null), and longs to sum up."""
    alive = cut_lineage(nodes.select("node", "parent", *sums))
    rounds: list[DataFrame] = []
    done: list[DataFrame] = []
    number = 0
    while not alive.isEmpty():
        number += 1
        # rake: what the children of a node are, and what its leaves give; nobody names a leaf as its parent
        inner = alive.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
        marked = cut_lineage(alive.join(inner, "node", "left"))
        leaves = marked.where("kids IS NULL").select("node", "parent", *sums)
        done.append(leaves.select("node", *sums))
        below = marked.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            *[F.sum(F.when(F.col("kids").isNull(), F.col(c)).otherwise(0)).alias(f"_{c}") for c in sums],
            F.sum(F.when(F.col("kids").isNull(), 0).otherwise(1)).alias("rest"), F.min(F.when(F.col("kids").isNotNull(), F.col("node"))).alias("child"),
        )
        raked = marked.where("kids IS NOT NULL").join(below, "node")
        raked = cut_lineage(raked.select("node", "parent", "rest", "child", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums], F.xxhash64(F.lit(number), "node").alias("draw")))
        # compress: chains of nodes with one child left; each knows the one below, and is named by the one above
        chain = raked.where("rest = 1 AND parent IS NOT NULL").select("node", "parent", "child", "draw", *sums)
        under = chain.select(F.col("node").alias("child"), F.col("draw").alias("draw_under"))
        over = chain.select(F.col("child").alias("node"), F.col("draw").alias("draw_over"))
        beats = F.col("draw") > F.greatest(F.coalesce("draw_under", F.lit(-(1 << 63))), F.coalesce("draw_over", F.lit(-(1 << 63))))
        bridged = cut_lineage(chain.join(under, "child", "left").join(over, "node", "left").where(beats).select("node", "parent", "child", *sums))
        rounds.append(bridged.drop("parent"))
        given = bridged.groupBy(F.col("parent").alias("node")).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        moved = bridged.select(F.col("child").alias("node"), F.col("parent").alias("_parent"))
        left = raked.join(bridged.select("node"), "node", "left_anti").join(given, "node", "left").join(moved, "node", "left")
        alive = cut_lineage(left.select("node", F.coalesce("_parent", "parent").alias("parent"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums]))
    # a bridged node was alive before its child ended, so the totals of later rounds are enough
    later = None
    for ended, bridged in zip(reversed(done), reversed(rounds), strict=True):
        if later is not None:
            total = later.select(F.col("node").alias("child"), *[F.col(c).alias(f"_{c}") for c in sums])
            full = cut_lineage(bridged.join(total, "child").select("node", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums]))
            later = later.unionByName(full)
        later = ended if later is None else later.unionByName(ended)
    return later if later is not None else alive.drop("parent")


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (node, first, ids) of the sorted rows (node, conv): the ids joined by commas."""
    node, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["node", "first", "ids"])

    for batch in batches:
        nodes, first, texts = [], [], []
        for n, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (n != node or len(ids) == PIECE) and ids:
                nodes.append(node)
                first.append(ids[0])
                texts.append(",".join(map(str, ids)))
                ids = []
            node = n
            ids.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(first, pa.int64()), pa.array(texts, pa.string())], ["node", "first", "ids"])
    if ids:
        yield piece()


def _digesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, sorted; only its state is held."""
    node, state = None, None
    for batch in batches:
        out: list[tuple] = []
        for n, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if n != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256`` of the rows (node, conv): SHA-256 of the ids in decimal, ascending, joined by commas.

    The ids of a node with many copies are sorted and joined over many tasks; what one task reads for it are pieces of text, as a digest has to.
    """
    pieces = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_joining, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digesting, "node binary, ends_sha256 string")


def conversation_trie(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per node of the trie of rebuilt conversations: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null), ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` (totals of the subtree), ``ends_sha256`` (of the members that end here).

    Turns are ordered by turn (null first), then by a digest of role and text; null roles and texts are empty, repeated rows are turns like any other. Rows without a
    conversation are left out. A conversation c gets the first crc32(c) % 4 turns of conversation c - c % 20, then its own after as many. Texts are read whole; an
    empty text has no words. An empty table gives no rows, not even a root. Other columns are left out.
    """
    rows, lengths = rebuilt_turns(table, conv_col, turn_col, role_col, text_col)
    lengths = cut_lineage(lengths)
    named = cut_lineage(_running_names(rows))
    root = F.unhex(F.lit("00"))
    top = lengths.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0")
    top = top.select(root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv", "n_convs", F.lit(0).cast("long").alias("words"))
    tree = trie_nodes(named).select(F.col("name").alias("node"), F.coalesce("above", root).alias("parent"), "depth", "conv", "n_convs", "words").unionByName(top)
    children = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    tree = cut_lineage(tree.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    weighed = tree.select("node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(weighed, ["n_leaves", "saved_tokens"])
    above = tree.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"), "n_children")
    parents = salted_lookup(tree.where("parent IS NOT NULL").select("node", "parent"), above, "parent", "n_children", "node").select("node", "parent_conv_id")
    # the last turn of a conversation names the node it ends at; one without turns ends at the root
    ends = named.join(lengths.select("conv", F.col("length").alias("depth")), ["conv", "depth"]).select(F.col("name").alias("node"), "conv")
    digests = end_digests(ends.unionByName(lengths.where("length = 0").select(root.alias("node"), "conv")))
    whole = tree.join(totals, "node").join(parents, "node", "left").join(digests, "node", "left")
    ends_sha256 = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return whole.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends_sha256)


#: The same in SQL for DuckDB; every node is joined with all nodes above it, so for short conversations.
ORACLE = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, count(*) AS own,
    xor(list_reduce(flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(conv_id::VARCHAR, '')]),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x::BIGINT) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT), 4294967295) % {SHARED} AS h
  FROM t GROUP BY conv_id
), k AS (
  SELECT s.*, least(s.h, coalesce(b.own, 0)) AS taken FROM s LEFT JOIN s b ON b.conv_id = s.base
), r AS (
  SELECT k.conv_id, i AS d, digest, words FROM k JOIN t ON t.conv_id = k.base AND i <= h
  UNION ALL SELECT k.conv_id, i - h + taken, digest, words FROM k JOIN t ON t.conv_id = k.conv_id AND i > h
), p AS (
  SELECT conv_id, d, words, sha256(string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM k
), length AS (
  SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id
), n AS (
  SELECT node, p.d, min(p.conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE length.d = p.d), '')) AS ends_sha256
  FROM p JOIN length USING (conv_id) GROUP BY node, p.d
), e AS (
  SELECT n.node, p.node AS above, p.d FROM n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d
), c AS (
  SELECT e.above AS node, count(*) AS n_children FROM e JOIN n ON n.node = e.node AND n.d = e.d + 1 GROUP BY e.above
), totals AS (
  SELECT e.above AS node, count(*) FILTER (WHERE c.node IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM e JOIN n ON n.node = e.node LEFT JOIN c ON c.node = n.node GROUP BY e.above
)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN totals ON totals.node = n.node LEFT JOIN c ON c.node = n.node LEFT JOIN e ON e.node = n.node AND e.d = n.d - 1 LEFT JOIN n up ON up.node = e.above
"""
