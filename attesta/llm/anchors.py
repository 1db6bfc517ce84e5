"""Text that may recur, brought together by content-defined anchors.

Each window of a fixed number of units (bytes or words) owns the gram in it with the smallest hash. Equal windows own
equal anchors at equal places, so windows that occur twice meet under the hash of their anchor; no window is lost. A
*piece* is the text of all neighbouring windows with the same anchor. Equal pieces are counted together before anything
else sees them, so a passage in a third of all documents is one row with a count. What recurs is then decided exactly by
the operators (suffix_array, phrases).

``recurring`` reads the documents twice: first only to count anchor hashes, then for the pieces of those that were seen
more than once. The second pass drops what a Bloom filter of at most 16 MB rules out; beyond that size the filter lets
more rows through and nothing is lost, since pieces are counted exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.text import mix, prefix_sums, span_hashes, tiles, words
from attesta.session import cut_lineage

BLOCK = 1 << 17
#: Anchors are counted by so many leading bits of their hash; the Bloom filter takes its two places from these.
COUNTED_BITS = 40
BLOOM_SHIFTS = (0, 13)
BLOOM_MAX_BITS = 1 << 27
_LOW = np.uint64((1 << 20) - 1)
_GRAM = np.uint64(0xD1B54A32D192ED03)

Units = tuple[np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]


def byte_units(data: np.ndarray, offsets: np.ndarray, gram: int) -> Units:
    """Gram hashes at every byte, the byte offsets of the rows, and a hash of any byte span."""
    sums = prefix_sums(data)
    at = np.arange(max(0, len(data) - gram + 1))
    grams = np.zeros(len(data), np.uint64)
    if len(at):
        grams[: len(at)] = span_hashes(sums, at, at + gram)
    return grams, offsets, lambda a, b: span_hashes(sums, a, b)


def word_units(data: np.ndarray, offsets: np.ndarray, gram: int) -> Units:
    """The same with words as units; white space between words does not count."""
    starts, ends, rows = words(data, offsets)
    each = span_hashes(prefix_sums(data), starts, ends)
    grams = each.copy()
    for k in range(1, min(gram, len(each))):
        grams[:-k] = mix(grams[:-k] * _GRAM + each[k:])
    sums = prefix_sums(each)
    return grams, rows, lambda a, b: span_hashes(sums, a, b)


def own_anchors(grams: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: its unit, the first and the last window start, all as flat unit numbers.

    ``grams`` has a hash for each unit at which a gram starts (the value at the last units of a row does not matter),
    ``offsets`` the unit offsets of the rows. Windows cross no row.
    """
    width = window - gram + 1
    n = len(grams)
    full = np.diff(offsets) >= window
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, offsets[:-1][full], 1)
    np.add.at(change, offsets[1:][full] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(change[:-1]))
    found = [(np.zeros(0, np.int64),) * 3]
    while len(starts):
        low = starts[0]
        part = starts[: np.searchsorted(starts, low + BLOCK)]
        starts = starts[len(part) :]
        key = grams[low : part[-1] + width] & ~_LOW
        key |= np.arange(len(key), dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if width > step:
            key = np.minimum(key[: step - width], key[width - step :])
        anchor = (key[part - low] & _LOW).astype(np.int64) + low
        new = np.flatnonzero(np.diff(anchor, prepend=-1))
        found.append((anchor[new], part[new], part[np.append(new[1:], len(part)) - 1]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _lead(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - COUNTED_BITS)


def _counting(make: Callable, window: int, gram: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in tiles(batches, "text"):
            grams, rows, _ = make(data, offsets, gram)
            hashes, n = np.unique(_lead(grams[own_anchors(grams, rows, window, gram)[0]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return count


def _pieces(make: Callable, window: int, gram: int, bloom):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        mask = np.uint64(len(bits) * 64 - 1)
        for rows, data, offsets in tiles(batches, "text"):
            grams, unit_offsets, span = make(data, offsets, gram)
            anchor, first, last = own_anchors(grams, unit_offsets, window, gram)
            hashes = grams[anchor]
            keep = np.ones(len(hashes), bool)
            lead = _lead(hashes)
            for shift in BLOOM_SHIFTS:
                bit = (lead >> np.uint64(shift)) & mask
                keep &= (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            anchor, first, last, hashes = anchor[keep], first[keep], last[keep], hashes[keep]
            row = np.searchsorted(unit_offsets, first, side="right") - 1
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes.view(np.int64)), pa.array(span(first, last + window).view(np.int64)), rows.column(0).take(at), rows.column(1).take(at),
                    pa.array(first - unit_offsets[row]), pa.array((last - first + 1).astype(np.int32)),
                ],
                ["anchor", "piece", "id", "text_hash", "at", "n"],
            )

    return pieces


def bloom_words(keys: DataFrame, column: str, rows: int) -> np.ndarray:
    """A Bloom filter over a column of hashes as 64-bit words, two bits a key, built with a grouped bit_or."""
    bits = 1 << 16
    while bits < min(12 * rows, BLOOM_MAX_BITS):
        bits *= 2
    at = F.explode(F.array(*[F.shiftright(column, shift).bitwiseAND(bits - 1) for shift in BLOOM_SHIFTS]))
    words_ = keys.select(at.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
    table = words_.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``id``, ``text_hash``, ``text`` and ``more``: the id and a hash of the text name a row, so equal ids with other texts stay apart.

    Ids are as good as unique, so 32 bits tell the texts of one id apart; rows without an id need 64.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text_hash = F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.hash(text).cast("long"))
    return docs.select(F.col(id_col).alias("id"), text_hash.alias("text_hash"), text.alias("text"), *more)


def recurring(docs: DataFrame, make: Callable, window: int, gram: int, often: int) -> tuple[DataFrame, DataFrame]:
    """Occurrences (anchor, piece, id, text_hash, at, n) of all pieces whose anchor may occur elsewhere, and the anchors that occur more than ``often`` times.

    ``docs`` comes from ``keyed``. ``piece`` is a hash of the piece, ``at`` its first unit in the row, ``n`` its number of
    windows. The rows are not computed yet: a caller that reads them more than once cuts their lineage or shuffles them once. Anchors are counted by
    their leading ``COUNTED_BITS``; where two share these, a row too many passes or an anchor counts as frequent, which changes no result.
    """
    spark = docs.sparkSession
    id_type = docs.schema["id"].dataType.simpleString()
    counted = docs.select("text").mapInArrow(_counting(make, window, gram), "anchor long, n long")
    anchors = cut_lineage(counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"))
    bloom = spark.sparkContext.broadcast(bloom_words(anchors, "anchor", anchors.count()))
    rows = docs.mapInArrow(_pieces(make, window, gram, bloom), f"anchor long, piece long, id {id_type}, text_hash long, at long, n int")
    frequent = cut_lineage(anchors.where(F.col("n") > often).select(F.col("anchor").alias("lead")))
    return rows, frequent


def with_text(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """Join rows of ``docs`` with what was found for them (columns id, text_hash and lists of a bounded document)."""
    d, p = docs.alias("d"), pieces.alias("p")
    same = F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.text_hash") == F.col("p.text_hash"))
    return d.join(p, same, "left").select("d.*", *[F.col(f"p.{c}") for c in pieces.columns if c not in ("id", "text_hash")])
