"""Suffix-array dedup: bytes covered by a string of a given length that occurs elsewhere are removed.

Method: the Burrows-Wheeler transforms of shards are merged by iterative interleave refinement (Holt and McMillan 2014; the
blocks that keep common prefixes follow Egidi and Manzini 2017). The alphabet is words of eight bytes: a suffix is read in steps of eight, so 25 passes
reach 200 bytes. After pass h suffixes stand in the order of their first h symbols, interleaved from all shards, and a
block boundary that first appears in pass h marks a common prefix of h - 1 symbols. A suffix alone in its block is final
and leaves the later passes. Blocks that are left after the last pass are the repeated intervals; suffixes of different
shards are never sorted against each other.

Spark brings together what can match (``anchors``): the pieces of one anchor are dealt over the shards of one merge.
A batch of merges has a bounded number of bytes. Anchors with more than ``HEAVY`` different pieces (a passage at which
very many texts meet) are cut into single strings, which Spark groups by two independent 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.anchors import byte_units, keyed, recurring, with_text
from attesta.llm.text import mix, prefix_sums, ragged, span_hashes, tiles
from attesta.session import cut_lineage

WINDOW = 200
GRAM = 32
SYMBOL = 8
SHARDS = 8
MERGE_BYTES = 1 << 19
HEAVY = 4096
_SECOND = mix(np.arange(1, 257, dtype=np.uint64) << np.uint64(32))


def _stable(values: np.ndarray) -> np.ndarray:
    """A stable order of small non-negative integers: two radix passes over 16 bits each."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if len(values) and values.max() > 0xFFFF:
        order = order[np.argsort((values >> 16)[order].astype(np.uint16), kind="stable")]
    return order


def shard_order(symbol: np.ndarray, positions: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffix array of one shard: its positions in the order of their suffixes, read symbol by symbol.

    ``symbol[p]`` is the rank of the eight bytes at p (0 where the text ends). Ranks double their reach in each round, and only ties are
    sorted again; ``end`` is where the text of each position ends, so that no suffix runs on into the next text.
    """
    order = positions[_stable(symbol[positions])]
    rank = np.zeros(len(symbol) + 1, np.int32)
    new = np.diff(symbol[order], prepend=-1) != 0
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    reach = SYMBOL
    while reach < WINDOW:
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        some = order[tied]
        there = some + reach
        following = np.where(there < end[some], rank[np.minimum(there, len(symbol))], 0)
        again = np.lexsort((following, rank[some]))
        order[tied] = some[again]
        key = following[again]
        start = rank[order[tied]]
        fresh = (np.diff(start, prepend=-1) != 0) | (np.diff(key, prepend=-1) != 0)
        rank[order[tied]] = tied[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] + 1
        new = np.diff(rank[order], prepend=-1) != 0
        reach *= 2
    return order


def merged_repeats(data: np.ndarray, offsets: np.ndarray, shard: np.ndarray, weight: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each byte of the pieces: does a string of ``window`` bytes that starts here occur twice or more (by weight)?"""
    n, passes = len(data), window // SYMBOL
    if window % SYMBOL:
        raise ValueError(f"the window must be a multiple of {SYMBOL} bytes")
    end = np.repeat(offsets[1:], np.diff(offsets))
    wide = np.zeros(n + SYMBOL, np.uint64)
    padded = np.concatenate([data, np.zeros(2 * SYMBOL, np.uint8)])
    for phase in range(SYMBOL):
        part = padded[phase : phase + (n + SYMBOL - phase) // SYMBOL * SYMBOL].view("<u8")
        wide[phase::SYMBOL][: len(part)] = part
    positions = np.arange(n)
    whole = positions + SYMBOL <= end
    symbol = np.zeros(n, np.int32)
    symbol[whole] = np.unique(wide[:n][whole], return_inverse=True)[1] + 1
    of = np.repeat(shard, np.diff(offsets))
    suffixes = np.concatenate([shard_order(symbol, positions[of == s], end) for s in range(int(shard.max()) + 1)])  # shard by shard
    row = np.empty(n, np.int64)
    row[suffixes] = np.arange(n)
    # the transform: the symbol before each suffix, and the row of the suffix that starts with it
    before = suffixes - SYMBOL
    transform, back = symbol[before], row[before]
    weights = np.repeat(weight, np.diff(offsets))
    # only suffixes that a string of the asked length ends at, shard after shard; a text's end is the row of its empty suffix
    stop = np.flatnonzero(positions + window <= end) + window
    last_symbol = stop - SYMBOL
    live = row[last_symbol]
    live.sort()
    block = np.zeros(len(live), np.int64)
    first = symbol[suffixes[live]]
    order = _stable(first)
    live, block = live[order], np.cumsum(np.diff(first[order], prepend=-1) != 0)
    for done in range(1, passes + 1):
        # blocks of one suffix with one occurrence are final
        sizes = np.bincount(block, weights=weights[suffixes[live]])
        keep = sizes[block] > 1
        live, block = live[keep], block[keep]
        if done == passes or not len(live):
            break
        last = transform[live]
        order = _stable(last)
        last, block = last[order], block[order]
        live = back[live[order]]
        block = np.cumsum((np.diff(last, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
    out = np.zeros(n, bool)
    out[suffixes[live]] = True
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def _merge_batch(rows: list[tuple], window: int) -> pa.RecordBatch:
    text = b"".join(r[3] for r in rows)
    offsets = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])])
    flags = merged_repeats(np.frombuffer(text, np.uint8), offsets, np.arange(len(rows)) % min(SHARDS, len(rows)), np.array([r[2] for r in rows], np.int64), window)
    start, length = _runs(flags)
    # a piece ends with window - 1 bytes at which no string of the piece starts, so runs never touch
    owner = np.searchsorted(offsets, start, side="right") - 1
    return pa.RecordBatch.from_arrays(
        [pa.array([rows[i][0] for i in owner], pa.int64()), pa.array([rows[i][1] for i in owner], pa.int64()), pa.array(start - offsets[owner]), pa.array(length)],
        ["anchor", "piece", "lo", "len"],
    )


def _merging(window: int):
    def merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= MERGE_BYTES and row[0] != held[-1][0]:
                    yield _merge_batch(held, window)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield _merge_batch(held, window)

    return merging


def _cutting(window: int, singly: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of the representatives of pieces, or two hashes of each string of them."""
        for rows, data, offsets in tiles(batches, "text"):
            lists = rows.column(rows.schema.get_field_index("found"))
            item = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at, n = item.field("at").to_numpy(), item.field("n").to_numpy()
            if singly:
                n = n.astype(np.int64)
                taken, lo = np.repeat(np.arange(len(n)), n), ragged(np.zeros(len(n), np.int64), n)
                start = (offsets[owner] + at)[taken] + lo
                hashes = [pa.array(span_hashes(prefix_sums(values), start, start + window).view(np.int64)) for values in (data, _SECOND[data])]
                names = ["anchor", "piece", "count"]
                yield pa.RecordBatch.from_arrays([item.field(c).take(pa.array(taken)) for c in names] + [pa.array(lo), *hashes], [*names, "lo", "h1", "h2"])
                continue
            length = n.astype(np.int64) + window - 1
            body = data[ragged(offsets[owner] + at, length)]
            text = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.py_buffer(body.tobytes())])
            yield pa.RecordBatch.from_arrays([item.field("anchor"), item.field("piece"), item.field("count"), text], ["anchor", "piece", "count", "text"])

    return cut


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """``id``, ``text_hash`` and ``spans`` (list of lo, len: where strings of ``window`` bytes start that occur elsewhere) per row with any.

    ``docs`` comes from ``keyed``.
    """
    found = cut_lineage(recurring(docs, byte_units, window, gram, heavy)[0])
    pieces = found.groupBy("anchor", "piece").agg(F.count("*").alias("count"), F.min(F.struct("id", "text_hash", "at", "n")).alias("r"))
    groups = pieces.groupBy("anchor").agg(F.count("*").alias("variants"))
    pieces = pieces.join(groups, "anchor").where("variants > 1 OR count > 1").select("anchor", "piece", "count", "variants", "r.*")
    # one text in all places: every string of the piece occurs as often as the piece
    same = pieces.where("variants = 1").select("anchor", "piece", F.lit(0).cast("long").alias("lo"), F.col("n").cast("long").alias("len"))
    wanted = pieces.where("variants > 1").groupBy("id", "text_hash").agg(
        *[F.collect_list(F.when(test, F.struct("anchor", "piece", "count", "at", "n"))).alias(name) for name, test in (("light", F.col("variants") <= heavy), ("heavy", F.col("variants") > heavy))]
    )
    texts = with_text(docs, wanted)
    light, single = (
        texts.where(F.size(name) > 0).select("text", F.col(name).alias("found")).mapInArrow(_cutting(window, name == "heavy"), f"anchor long, piece long, count long, {rest}")
        for name, rest in (("light", "text binary"), ("heavy", "lo long, h1 long, h2 long"))
    )
    merged = light.repartition("anchor").sortWithinPartitions("anchor", "piece").mapInArrow(_merging(window), "anchor long, piece long, lo long, len long")
    often = single.groupBy("h1", "h2").agg(F.sum("count").alias("n")).where("n > 1")
    singly = single.join(often, ["h1", "h2"], "left_semi").select("anchor", "piece", "lo", F.lit(1).cast("long").alias("len"))
    runs = same.unionByName(merged).unionByName(singly)
    return (
        found.join(runs, ["anchor", "piece"])
        .groupBy("id", "text_hash")
        .agg(F.collect_list(F.struct((F.col("at") + F.col("lo")).alias("lo"), "len")).alias("spans"))
    )


def _removing(window: int, keep_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tiles(batches, "text"):
            lists = rows.column(rows.schema.get_field_index("spans"))
            filled = lists.fill_null([]) if lists.null_count else lists
            item = filled.flatten()
            owner = np.repeat(np.arange(len(filled)), np.diff(filled.offsets.to_numpy()))
            change = np.zeros(len(data) + 1, np.int32)
            if len(item):
                lo = item.field("lo").to_numpy() + offsets[owner]
                np.add.at(change, lo, 1)
                np.add.at(change, lo + item.field("len").to_numpy() + window - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            begin[offsets[:-1][np.diff(offsets) > 0]] = gone[offsets[:-1][np.diff(offsets) > 0]]
            spans = np.concatenate([[0], np.cumsum(begin)])
            left = data[~gone].tobytes()
            cut = offsets - total[offsets]
            kept = [left[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            columns = [
                rows.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(spans[offsets])),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_text, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    return remove


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep_text: bool = False, heavy: int = HEAVY) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked, ``kept`` (binary; a cut may split a character).

    Every byte covered by a ``window``-byte string that also starts anywhere else in the table is removed, the same row included;
    strings are judged on the input. A null text reads as empty. A repeated row is an occurrence of its own. An empty table
    gives no rows. Only the id column is returned beside the named ones, under its own name.
    """
    rows = keyed(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    joined = with_text(rows, repeats(rows, window, gram, heavy)).select("id", "spans", "text")
    schema = f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return joined.mapInArrow(_removing(window, keep_text), schema).withColumnRenamed("id", id_col)
