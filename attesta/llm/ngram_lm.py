"""Interpolated modified Kneser-Ney language model (order two), counted in Spark and read by workers as memory-mapped sorted arrays.

1. Words are counted by their 64-bit hashes; sorted by hash they are the vocabulary, and the place in it is the number of a
   word. The end of a text is a word, its beginning only a context.
2. Pairs are counted as ``number << 32 | number``. Tasks count within batches before the shuffle, so a frequent pair is a few rows.
   Each bucket is a range of first words: its sorted pairs, and the context totals, are one set of arrays in the shared folder.
3. How many different words come before each word gives the lower order, which is interpolated with an equal share for each word and one unknown.

Buckets are written under a temporary name and renamed, so a task that runs again leaves the same files. A task holds one
bucket; the number of buckets follows the number of shuffle partitions.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.files import shared_folder
from attesta.llm.text import LOWER, prefix_sums, span_hashes, tiles, words
from attesta.session import cut_lineage

END = np.uint64(0x5D4E3A1F9B7C6082)
BUCKETS_PER_PARTITION = 4
COUNT_SCHEMA = "key long, n long"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows (lower-cased words, then one end) and the token offsets of the rows."""
    data = LOWER[data]
    starts, ends, word_offsets = words(data, offsets)
    edge = word_offsets + np.arange(len(word_offsets))
    out = np.empty(edge[-1], np.uint64)
    last = np.zeros(len(out), bool)
    last[edge[1:] - 1] = True
    out[last] = END
    out[~last] = span_hashes(prefix_sums(data), starts, ends)
    return out, edge


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key; ``keys`` ascend."""
    new = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ keys.dtype.type(1)))
    return keys[new], np.add.reduceat(n, new) if len(new) else n[:0]


def _counted(parts: list[np.ndarray]) -> pa.RecordBatch:
    keys, n = np.unique(np.concatenate(parts), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _counted([tokens(data, offsets)[0] for _, data, offsets in tiles([batch], "text")])


def _publish(path: str, array: np.ndarray) -> None:
    """Write under another name and rename: readers and repeated tasks see whole files only."""
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as file:
        np.save(file, array)
    os.replace(draft, path)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Keys and sums of each bucket of rows (bucket, key, n) sorted by bucket and key."""
    now, keys, counts = None, [], []
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if a == b:
                continue
            if now is not None and bucket[a] != now:
                yield now, *_summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [], []
            now = int(bucket[a])
            keys.append(batch.column(1).to_numpy()[a:b].view(np.uint64))
            counts.append(batch.column(2).to_numpy()[a:b])
    if now is not None:
        yield now, *_summed(np.concatenate(keys), np.concatenate(counts))


def _dealt(rows: DataFrame, bucket: Column) -> DataFrame:
    return rows.select(bucket.cast("int").alias("bucket"), "key", "n").repartition("bucket").sortWithinPartitions("bucket", "key")


class Vocabulary:
    """Word numbers and counts, looked up by hash in mapped arrays; a bucket holds the hashes with the same leading bits."""

    def __init__(self, folder: str, sizes: np.ndarray):
        self.folder, self.sizes = folder, sizes
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        self.shift = np.uint64(64 - int(len(sizes)).bit_length() + 1)
        self.open: dict[tuple[str, int], np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "open": {}}

    def array(self, kind: str, bucket: int) -> np.ndarray:
        if (kind, bucket) not in self.open:
            self.open[kind, bucket] = np.load(f"{self.folder}/{kind}-{bucket}.npy", mmap_mode="r")
        return self.open[kind, bucket]

    def __len__(self) -> int:
        return int(self.offset[-1])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1 if unknown) and counts of ascending distinct hashes."""
        number, count = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        edge = np.searchsorted(hashes >> self.shift, np.arange(len(self.sizes) + 1, dtype=np.uint64))
        for bucket in np.flatnonzero((np.diff(edge) > 0) & (self.sizes > 0)).tolist():
            here = slice(edge[bucket], edge[bucket + 1])
            keys = self.array("word", bucket)
            at = np.minimum(np.searchsorted(keys, hashes[here]), len(keys) - 1)
            hit = keys[at] == hashes[here]
            number[here] = np.where(hit, at + self.offset[bucket], -1)
            count[here] = np.where(hit, self.array("count", bucket)[at], 0)
        return number, count


def _bucket_count(docs: DataFrame) -> int:
    return 1 << (BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()


def build_vocabulary(texts: DataFrame, folder: str) -> tuple[Vocabulary, int]:
    """Count the words of ``texts`` (column text); the vocabulary and the number of tokens."""
    buckets = _bucket_count(texts)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, keys, n in _by_bucket(batches):
            _publish(f"{folder}/word-{bucket}.npy", keys)
            _publish(f"{folder}/count-{bucket}.npy", n)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(keys)]), pa.array([int(n.sum())])], ["bucket", "words", "tokens"])

    rows = _dealt(texts.select("text").mapInArrow(_count_words, COUNT_SCHEMA), F.shiftrightunsigned("key", 65 - buckets.bit_length()))
    # the key is unsigned: buckets order by the leading bits, and within a bucket the sign is the same for all
    sizes = np.zeros(buckets, np.int64)
    total = 0
    for row in rows.mapInArrow(write, "bucket int, words long, tokens long").collect():  # one row a bucket
        sizes[row.bucket] = row.words
        total += row.tokens
    return Vocabulary(folder, sizes), total


def _numbers(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number and count of each token, the number of the one before it (the beginning: one past the vocabulary), token offsets."""
    hashes, edge = tokens(data, offsets)
    unique, inverse = np.unique(hashes, return_inverse=True)
    number, count = vocabulary.find(unique)
    number = number[inverse]
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[edge[:-1]] = len(vocabulary)
    return number, count[inverse], before, edge


def _count_pairs(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, data, offsets in tiles([batch], "text"):
                number, _, before, _ = _numbers(vocabulary.value, data, offsets)
                parts.append(before.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64))
            if parts:
                yield _counted(parts)

    return run


def _range_bucket(number: Column, size: int, buckets: int) -> Column:
    return F.floor(number * F.lit(buckets) / F.lit(size))


def _range_edges(size: int, buckets: int) -> np.ndarray:
    """The first number of each bucket: the smallest x with floor(x * buckets / size) = bucket."""
    return -(-np.arange(buckets + 1) * size // buckets)


def _discounts(n: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more from how many have the counts 1 to 4 (Chen and Goodman 1999).

    Where a count is missing (tiny data), a discount falls back to a half, so that probabilities stay positive.
    """
    out = np.zeros(4)
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.0
    for k in range(3):
        d = k + 1 - (k + 2) * y * n[k + 1] / n[k] if y and n[k] else 0.5
        out[k + 1] = d if 0 < d < k + 1 else 0.5
    return out


class Model:
    """Scores tokens from mapped arrays."""

    def __init__(self, vocabulary: Vocabulary, tokens_: int, buckets: int, pairs: np.ndarray, lower: np.ndarray, total: int):
        self.vocabulary, self.tokens, self.buckets = vocabulary, tokens_, buckets
        self.size = len(vocabulary) + 1
        self.edges = _range_edges(self.size, buckets)
        self.discount, self.lower_discount, self.total = _discounts(pairs), _discounts(lower[:4]), total
        many = np.array([lower[0], lower[1], lower[4]])
        self.lower_rest = float(self.lower_discount[1:] @ many) / total / self.size if total else 1 / self.size

    def _gather(self, kind: str, numbers: np.ndarray, width: int) -> np.ndarray:
        """Rows of a dense array cut into ranges of numbers; -1 gives zeros."""
        out = np.zeros((len(numbers), width) if width else len(numbers), np.int64)
        unique, inverse = np.unique(numbers, return_inverse=True)
        found = np.zeros((len(unique), width) if width else len(unique), np.int64)
        edge = np.searchsorted(unique, self.edges)
        for bucket in np.flatnonzero(np.diff(edge)).tolist():
            if os.path.exists(f"{self.vocabulary.folder}/{kind}-{bucket}.npy"):
                here = slice(edge[bucket], edge[bucket + 1])
                found[here] = self.vocabulary.array(kind, bucket)[unique[here] - self.edges[bucket]]
        out[:] = found[inverse]
        return out

    def _pairs(self, before: np.ndarray, number: np.ndarray) -> np.ndarray:
        """How often each pair was seen."""
        keys, inverse = np.unique(np.maximum(before, 0).astype(np.uint64) << np.uint64(32) | np.maximum(number, 0).astype(np.uint64), return_inverse=True)
        found = np.zeros(len(keys), np.int64)
        edge = np.searchsorted(keys, self.edges.astype(np.uint64) << np.uint64(32))
        for bucket in np.flatnonzero(np.diff(edge)).tolist():
            if os.path.exists(f"{self.vocabulary.folder}/pair-{bucket}.npy"):
                here = slice(edge[bucket], edge[bucket + 1])
                table = self.vocabulary.array("pair", bucket)
                at = np.minimum(np.searchsorted(table, keys[here]), len(table) - 1)
                found[here] = np.where(table[at] == keys[here], self.vocabulary.array("paired", bucket)[at], 0)
        return np.where((before >= 0) & (number >= 0), found[inverse], 0)

    def probabilities(self, before: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The probability of each word after the one before it; unknown words (-1) share one place."""
        ways = self._gather("ways", number, 0)
        low = np.maximum(ways - self.lower_discount[np.minimum(ways, 3)], 0) / max(self.total, 1) + self.lower_rest
        context = self._gather("context", before, 4)
        total = context[:, 0]
        seen = self._pairs(before, number)
        rest = context[:, 1:] @ self.discount[1:]
        high = (np.maximum(seen - self.discount[np.minimum(seen, 3)], 0) + rest * low) / np.maximum(total, 1)
        return np.where(total > 0, high, low)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per row: tokens, known tokens, log10 of the base model and of this one."""
        number, count, before, edge = _numbers(self.vocabulary, data, offsets)
        base = np.log10((count + 1) / (self.tokens + len(self.vocabulary) + 1))
        own = np.log10(self.probabilities(before, number))
        first = edge[:-1]
        return np.diff(edge), np.add.reduceat(count > 0, first, dtype=np.int64), np.add.reduceat(base, first), np.add.reduceat(own, first)


def train(texts: DataFrame) -> Model:
    """Count ``texts`` (column text, no nulls) and leave the arrays in the shared folder."""
    spark = texts.sparkSession
    folder = shared_folder(spark, "ngrams")
    vocabulary, n_tokens = build_vocabulary(texts, folder)
    if len(vocabulary) >= 1 << 32:
        raise ValueError("word numbers have 32 bits")
    size, buckets = len(vocabulary) + 1, min(_bucket_count(texts), len(vocabulary) + 1)
    edges = _range_edges(size, buckets)

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follow = []
        stats = np.zeros(4, np.int64)
        for bucket, keys, n in _by_bucket(batches):
            _publish(f"{folder}/pair-{bucket}.npy", keys)
            _publish(f"{folder}/paired-{bucket}.npy", n.astype(np.uint32) if n.max() < 1 << 32 else n)
            context = np.zeros((edges[bucket + 1] - edges[bucket], 4), np.int64)
            of = (keys >> np.uint64(32)).astype(np.int64) - edges[bucket]
            np.add.at(context[:, 0], of, n)
            np.add.at(context, (of, np.minimum(n, 3)), 1)
            _publish(f"{folder}/context-{bucket}.npy", context)
            stats += np.bincount(np.minimum(n, 5), minlength=6)[1:5]
            follow.append(np.stack(np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)).astype(np.int64))
            if len(follow) == BUCKETS_PER_PARTITION:
                follow = [_merged(follow)]
        number, n = _merged(follow) if follow else (np.zeros(0, np.int64),) * 2
        # negative keys carry the counts of counts
        yield pa.RecordBatch.from_arrays([pa.array(np.append(number, [-1, -2, -3, -4])), pa.array(np.append(n, stats))], ["key", "n"])

    def write_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, keys, n in _by_bucket(batches):
            ways = np.zeros(edges[bucket + 1] - edges[bucket], np.int64)
            ways[keys.astype(np.int64) - edges[bucket]] = n
            _publish(f"{folder}/ways-{bucket}.npy", ways)
            stats = [*np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist(), int((n > 2).sum()), int(n.sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in stats], ["n1", "n2", "n3", "n4", "many", "total"])

    shared = spark.sparkContext.broadcast(vocabulary)
    pairs = _dealt(texts.select("text").mapInArrow(_count_pairs(shared), COUNT_SCHEMA), _range_bucket(F.shiftrightunsigned("key", 32), size, buckets))
    follow = cut_lineage(pairs.mapInArrow(write_pairs, COUNT_SCHEMA))
    pair_stats = {r.key: r.n for r in follow.where("key < 0").groupBy("key").agg(F.sum("n").alias("n")).collect()}  # four rows
    lower = _dealt(follow.where("key >= 0"), _range_bucket(F.col("key"), size, buckets)).mapInArrow(write_ways, "n1 long, n2 long, n3 long, n4 long, many long, total long")
    sums = lower.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in lower.columns]).first()
    return Model(vocabulary, n_tokens, buckets, np.array([pair_stats.get(-k, 0) for k in range(1, 5)]), np.array(sums[:5]), sums.total)


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return np.stack([keys, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)])


def held_out(id_column: Column) -> Column:
    """One id in seven, chosen by the checksum of the id as text; a null id counts as an empty one."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10 of the probability of the text).

    Learns from the whole texts of all rows that are not held out and scores all. Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased
    and one end per text; a null text reads as empty and is one end. Repeated rows count as often as they come. An empty table gives no rows. Other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    model = train(rows.where("NOT held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tiles(batches, "text"):
            n, known, base, own = model_.value.score(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n), pa.array(known), pa.array(np.full(len(n), model_.value.tokens)), pa.array(base), pa.array(own)],
                ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    model_ = shared
    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(score, schema).withColumnRenamed("id", id_col)
