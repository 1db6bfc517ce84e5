"""SimHash near-dedup: fingerprints that differ in few bits are linked, and linked rows get one component.

Fingerprints count the bits of the 64-bit hashes of word shingles. To find pairs within two differing bits, a fingerprint is
split into five blocks; any such pair agrees on three of them, so each fingerprint is filed under its ten triples of blocks (38
or 39 bits) and compared only with those filed beside it. A bucket emits no pairs: it is joined up in numpy and passes on
one link for each fingerprint that is not the root of its part. Small buckets compare all members; large ones sort once for each of the few hundred ways to
leave out two of the free bits, so that work follows the number of members. A bucket cannot hold more than 2^26 fingerprints.
Equal fingerprints are one node, however many rows have them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.anchors import keyed
from attesta.llm.text import LOWER, tiles, words
from attesta.session import cut_lineage

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SMALL_BUCKET = 1024
#: First bit and width of each block.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id``, ``text_hash`` and ``fingerprint`` of the rows of (id, text_hash, text)."""
    for rows, data, offsets in tiles(batches, "text"):
        data = LOWER[data]
        starts, ends, word_offsets = words(data, offsets)
        count = np.diff(word_offsets)
        n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
        # one space between all words, so that a shingle is a slice
        length = ends - starts + 1
        total = np.concatenate([[0], np.cumsum(length)])
        index = np.arange(total[-1]) + np.repeat(starts - total[:-1], length)
        line = np.append(data, np.uint8(32))[index]
        line[total[1:] - 1] = 32
        line = line.tobytes()
        first = np.repeat(word_offsets[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        last = np.minimum(first + SHINGLE, np.repeat(word_offsets[1:], n))
        digest, seed = xxhash.xxh64_intdigest, SEED
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(total[first].tolist(), (total[last] - 1).tolist(), strict=True)], np.uint64)
        prints = np.zeros(len(n), np.uint64)
        full = np.flatnonzero(n)
        if len(full):
            edge = np.concatenate([[0], np.cumsum(n[full])])
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes = np.add.reduceat(bits, edge[:-1], axis=0, dtype=np.int32)
            packed = np.packbits(votes * 2 > n[full][:, None], axis=1, bitorder="little")
            prints[full] = packed.view(np.uint64).ravel()
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(prints.view(np.int64))], ["id", "text_hash", "fingerprint"])


def _mask(blocks: tuple[int, ...]) -> int:
    return sum(((1 << BLOCKS[b][1]) - 1) << BLOCKS[b][0] for b in blocks)


TRIPLES = [_mask(t) for t in combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_BITS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_roots(prints: np.ndarray, mask: int, small: int = SMALL_BUCKET) -> np.ndarray:
    """For fingerprints that agree on ``mask``, the index of the smallest one reachable over links of at most two bits."""
    labels = np.arange(len(prints))
    if len(prints) <= small:
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= MAX_BITS
        while True:
            new = np.where(near, labels[None, :], len(prints)).min(axis=1)
            if (new == labels).all():
                return labels
            labels = new
    free = [b for b in range(64) if not mask >> b & 1]
    while True:
        was = labels
        for pair in combinations(free, MAX_BITS):
            _, group = np.unique(prints & ~np.uint64(sum(1 << b for b in pair)), return_inverse=True)
            least = np.full(group.max() + 1, len(prints))
            np.minimum.at(least, group, labels)
            labels = least[group]
        if (labels == was).all():
            return labels


def _linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside buckets; rows (triple, block, fingerprint) come sorted, a bucket may span batches."""
    rest: tuple[np.ndarray, ...] = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def links(triple, block, prints):
        new = np.flatnonzero((np.diff(triple, prepend=-1) != 0) | (np.diff(block, prepend=block[:1] - 1) != 0))
        size = np.diff(np.append(new, len(triple)))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        two = new[size == 2]
        close = np.bitwise_count((prints[two] ^ prints[two + 1]).view(np.uint64)) <= MAX_BITS
        left.append(prints[two + 1][close])
        right.append(prints[two][close])
        for at, n in zip(new[size > 2], size[size > 2], strict=True):
            some = prints[at : at + n]
            root = bucket_roots(some.view(np.uint64), TRIPLES[triple[at]])
            moved = np.flatnonzero(root != np.arange(n))
            left.append(some[moved])
            right.append(some[root[moved]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["u", "v"])

    for batch in batches:
        held = tuple(np.concatenate([a, c.to_numpy()]) for a, c in zip(rest, batch.columns, strict=True))
        if not len(held[0]):
            continue
        last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield links(*(h[:cut] for h in held))
        rest = tuple(h[cut:] for h in held)
    if len(rest[0]):
        yield links(*rest)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` between distinct fingerprints that join up everything within two bits; column ``fingerprint`` in."""
    filed = prints.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(_signed(m)) for m in TRIPLES])).alias("triple", "block"))
    filed = filed.select("triple", "block", "fingerprint").repartition("triple", "block").sortWithinPartitions("triple", "block", "fingerprint")
    return filed.mapInArrow(_linking, "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` of every node with a link; the root is the smallest node of the component.

    Alternating large and small stars (Kiveris et al. 2014): each round is two grouped minimums with joins, and the number of rounds follows the
    logarithm of the longest chain. Rounds are written to the shared folder.
    """
    edges = cut_lineage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(least, "u").select(F.greatest("v", "m").alias("a"), "m", "u")
        edges = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(edges.select("e.*").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _rooted(rows: DataFrame) -> DataFrame:
    """``id``, ``text_hash``, ``fingerprint`` and ``root`` (one fingerprint of the component) of rows from ``keyed``."""
    id_type = rows.schema["id"].dataType.simpleString()
    printed = cut_lineage(rows.mapInArrow(fingerprints, f"id {id_type}, text_hash long, fingerprint long"))
    star = components(fingerprint_links(printed.select("fingerprint").distinct()))
    rooted = printed.join(star, printed.fingerprint == star.node, "left")
    return rooted.select("id", "text_hash", "fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest id reachable over close fingerprints.

    Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; shingles of three words with repeats; a shorter text is one shingle, a text without
    words or a null text has fingerprint zero and is linked like any other. Repeated rows come out as often as they went in. A component in which
    no row has an id has a null ``component_id``. An empty table gives no rows. Other columns are left out.
    """
    rooted = _rooted(keyed(docs, id_col, text_col))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(smallest, "root").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rooted: Callable[[DataFrame], DataFrame] = _rooted) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest id (rows without an id last), then of the smallest text hash.

    ``rooted`` gives the ``root`` of each ``id`` and ``text_hash``: by close fingerprints, or that of ``resemblance``. Whole texts; null and empty texts are alike,
    so one of them stays. Of repeated rows one stays, an empty table stays empty.
    """
    others = F.struct(*[F.col(c) for c in docs.columns]).alias("whole")
    rows = keyed(docs, id_col, text_col, others)
    first = rooted(rows.drop("whole")).groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")).select("first.id", "first.text_hash")
    d, f = rows.select("id", "text_hash", "whole").alias("d"), first.alias("f")
    same = F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.text_hash") == F.col("f.text_hash"))
    one = d.join(f, same, "left_semi").dropDuplicates(["id", "text_hash"])
    return one.select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns])
