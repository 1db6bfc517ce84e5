"""Collocations: frequent phrases scored by how much more often their words stand together than apart, per language.

1. Texts are lower-cased and cut into pieces and words; the words of a slice of text, with one space between them, are one byte array, whose prefix
   polynomials give the Rabin-Karp fingerprint of any phrase. The language goes into the fingerprint.
2. Tasks count fingerprints within a slice; the shuffle adds up the counts and keeps one pointer to an occurrence, (hash of the text, place). Words are
   counted first, then pairs of frequent words, then phrases of three words or more in which all pairs are frequent: a phrase is never more frequent
   than what it holds, so nothing is lost. The frequent fingerprints are sorted arrays in the shared folder that tasks map.
3. The text of frequent phrases alone is fetched through their pointers and mapped in the same way. One more pass over all texts compares every occurrence of a frequent
   fingerprint with that text, byte by byte; what differs is taken off and counted by its own text. Counts are exact, whatever collides.
4. Cuts, scores and containment are joins of the frequent phrases, in whole numbers.

A text longer than a slice is cut between pieces, which no phrase crosses.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.files import shared_folder
from attesta.llm.text import LOWER, flat, mix, prefix_sums, ragged, span_hashes
from attesta.session import cut_lineage

LONGEST = 5
LEAST = 100
TOP = 2000
#: A longer phrase with this percentage of the occurrences of a phrase inside it takes its place.
SHARE = 100
SLICE_BYTES = 1 << 21
#: First round of ranking: so many parts of a language give their best phrases to the second.
RANK_PARTS = 64
#: [.,;:!?\x0A-\x0D] end a piece; words are separated by these, space and tab.
ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[[10, 11, 12, 13, *b".,;:!?"]] = True
SEPARATES = ENDS_PIECE.copy()
SEPARATES[[9, 32]] = True
_LOWER_SQL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Slice:
    """Words of some rows or of a part of a long one: their bytes with single spaces, edges in these bytes, and how many words follow in the piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, base: int, lang: np.ndarray):
        inside = ~SEPARATES[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
        self.starts = np.flatnonzero(inside & (before | edge[:-1]))
        ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        n = len(self.starts)
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.base, self.rows, self.offsets, self.end = base, rows, offsets, base + len(data)
        length = ends - self.starts + 1
        self.total = np.concatenate([[0], np.cumsum(length)])
        line = np.append(LOWER[data], np.uint8(32))[ragged(self.starts, length)]
        line[self.total[1:] - 1] = 32
        self.line, self.sums = line, prefix_sums(line)
        # the number of the piece of each word; words to the end of its piece
        piece = np.cumsum(ENDS_PIECE[data])[self.starts] if n else np.zeros(0, np.int64)
        new = np.ones(n + 1, bool)
        new[1:n] = (np.diff(piece) != 0) | (np.diff(self.row) != 0)
        last = np.flatnonzero(new)
        self.left = np.repeat(last[1:], np.diff(last)) - np.arange(n) if n else np.zeros(0, np.int64)
        self.lang = lang[self.row] if n else np.zeros(0, np.uint64)

    def prints(self, at: np.ndarray, words: int) -> np.ndarray:
        """Fingerprints of the phrases of ``words`` words that start at the words ``at``."""
        return mix(span_hashes(self.sums, self.total[at], self.total[at + words] - 1) ^ self.lang[at])


def _lang_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each row's language, and the hash with which all words of a language are counted (the empty phrase)."""
    coded = column.dictionary_encode()
    each = np.array([xxhash.xxh64_intdigest(x or "", 7) for x in coded.dictionary.to_pylist()] or [0], np.uint64)
    each = each[coded.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, np.uint64)
    return each, mix(each ^ np.uint64(0x9D39247E33776D41))


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of about ``size`` bytes of rows (key, lang, text); a longer text is cut after the end of a piece."""
    data, offsets = flat(batch.column(2))
    lang, _ = _lang_hashes(batch.column(1))
    row = 0
    while row < batch.num_rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        part = data[offsets[row] : offsets[last]]
        if len(part) <= size or last > row + 1:
            yield Slice(part, offsets[row : last + 1] - offsets[row], np.arange(row, last), 0, lang[row:last])
        else:
            ends = np.flatnonzero(ENDS_PIECE[part]) + 1
            at = 0
            while at < len(part):
                k = np.searchsorted(ends, at + size)
                to = int(ends[k]) if k < len(ends) else len(part)
                yield Slice(part[at:to], np.array([0, to - at]), np.array([row]), at, lang[row : row + 1])
                at = to
        row = last


class Sorted:
    """Fingerprints, or what belongs to them, in mapped arrays; a bucket holds those with the same leading bits."""

    def __init__(self, folder: str, sizes: np.ndarray):
        self.folder, self.sizes = folder, sizes
        self.shift = np.uint64(65 - int(len(sizes)).bit_length())
        self.open: dict[tuple[str, int], np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "open": {}}

    def array(self, kind: str, bucket: int) -> np.ndarray:
        if (kind, bucket) not in self.open:
            self.open[kind, bucket] = np.load(f"{self.folder}/{kind}-{bucket}.npy", mmap_mode="r")
        return self.open[kind, bucket]

    def places(self, prints: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """For ascending fingerprints: bucket, their range, the places in the bucket and whether they are there."""
        edge = np.searchsorted(prints >> self.shift, np.arange(len(self.sizes) + 1, dtype=np.uint64)) if len(self.sizes) > 1 else np.array([0, len(prints)])
        for bucket in np.flatnonzero((np.diff(edge) > 0) & (self.sizes > 0)).tolist():
            here = slice(edge[bucket], edge[bucket + 1])
            keys = self.array("key", bucket)
            at = np.minimum(np.searchsorted(keys, prints[here]), len(keys) - 1)
            yield bucket, here, at, keys[at] == prints[here]

    def has(self, prints: np.ndarray) -> np.ndarray:
        """Whether each fingerprint is there, in any order and with repeats."""
        unique, inverse = np.unique(prints, return_inverse=True)
        found = np.zeros(len(unique), bool)
        for _, here, _, hit in self.places(unique):
            found[here] = hit
        return found[inverse]

    def texts(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ascending fingerprints: whether each is there, the bytes of their texts one after the other, and the edges in them (absent: empty)."""
        found, length = np.zeros(len(prints), bool), np.zeros(len(prints), np.int64)
        parts = []
        for bucket, here, at, hit in self.places(prints):
            edges, at = self.array("edge", bucket), at[hit]
            size = edges[at + 1] - edges[at]
            found[here] = hit
            length[np.arange(here.start, here.stop)[hit]] = size
            parts.append(np.asarray(self.array("text", bucket))[ragged(edges[at], size)])
        return found, np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(length)])


def _publish(path: str, array: np.ndarray) -> None:
    """Write under another name and rename: readers and repeated tasks see whole files only."""
    with open(draft := f"{path}.{uuid.uuid4().hex}", "wb") as file:
        np.save(file, array)
    os.replace(draft, path)


def mapped(table: DataFrame, texts: bool = False) -> Sorted:
    """Sorted arrays of the fingerprints (and texts) of ``table``: print, and phrase if asked for. A task holds one bucket; their number follows that of the partitions."""
    spark = table.sparkSession
    folder = shared_folder(spark, "phrases")
    buckets = 1 << (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    bits = buckets.bit_length() - 1

    def write(bucket: int, parts: list[pa.RecordBatch]) -> tuple[int, int]:
        rows = pa.Table.from_batches(parts)
        keys = rows.column("print").to_numpy().view(np.uint64)
        _publish(f"{folder}/key-{bucket}.npy", keys)
        if texts:
            data, edges = flat(rows.column("phrase").combine_chunks())
            _publish(f"{folder}/text-{bucket}.npy", data)
            _publish(f"{folder}/edge-{bucket}.npy", edges)
        return bucket, len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, [], []
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if now is not None and bucket[a] != now:
                    done.append(write(now, held))
                    held = []
                now = int(bucket[a])
                held.append(batch.slice(a, b - a))
        if now is not None:
            done.append(write(now, held))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.int64())], ["bucket", "n"])

    # prints are unsigned: within a bucket the sign is the same for all
    lead = F.shiftrightunsigned("print", 64 - bits) if bits else F.lit(0)
    dealt = table.select(lead.cast("int").alias("bucket"), "print", *(["phrase"] if texts else [])).repartition("bucket").sortWithinPartitions("bucket", "print")
    sizes = np.zeros(buckets, np.int64)
    for row in dealt.mapInArrow(run, "bucket int, n long").collect():  # one row a bucket
        sizes[row.bucket] = row.n
    return Sorted(folder, sizes)


def _counted(batch: pa.RecordBatch, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Counts of fingerprints, each with a row and a place: (print, row, place) parts, all of one slice."""
    prints, rows, places = (np.concatenate(x) for x in zip(*parts, strict=True))
    unique, first, n = np.unique(prints, return_index=True, return_counts=True)
    keys = batch.column(0).take(pa.array(rows[first]))
    return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(n.astype(np.int64)), keys, pa.array(places[first])], ["print", "n", "key", "place"])


def _pointers(part: Slice, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of a phrase is its first byte in the text times eight, plus its number of words."""
    row = part.row[at]
    return part.prints(at, words), part.rows[row], (part.base + part.starts[at] - part.offsets[row]) * 8 + words


def _counting_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, empty = _lang_hashes(batch.column(1))
        for part in slices(batch):
            at = np.arange(len(part.starts))
            if len(at):
                words = _pointers(part, at, 1)
                rows = words[1]
                yield _counted(batch, [words, (empty[rows], rows, np.zeros(len(rows), np.int64))])


def _counting_pairs(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                known = frequent.value.has(part.prints(np.arange(len(part.starts)), 1))
                at = np.flatnonzero(known[:-1] & known[1:] & (part.left[:-1] > 1))
                if len(at):
                    yield _counted(batch, [_pointers(part, at, 2)])

    return run


def _counting_phrases(frequent, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                pairs = np.flatnonzero(part.left > 1)
                at = pairs[frequent.value.has(part.prints(pairs, 2))]
                known = np.zeros(len(part.starts) + longest, bool)
                known[at] = True
                found = []
                for words in range(3, longest + 1):
                    at = at[known[at + words - 2] & (part.left[at] >= words)]
                    if len(at):
                        found.append(_pointers(part, at, words))
                if found:
                    yield _counted(batch, found)

    return run


def _fetching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``print``, ``lang``, ``phrase`` of the pointers of rows (key, lang, text, pointers); a pointer that another text with this key has made finds nothing here."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            wanted = one.column(3)[0].values
            prints, places = wanted.field(0).to_numpy().view(np.uint64), wanted.field(1).to_numpy()
            words, starts = places & 7, places >> 3
            out = [(p, "") for p in prints[(words == 0) & (prints == _lang_hashes(one.column(1))[1][0])]]
            for part in slices(one):
                for w in np.unique(words[words > 0]).tolist():
                    here = np.flatnonzero((words == w) & (starts >= part.base) & (starts < part.end))
                    at = np.searchsorted(part.starts, starts[here] - part.base)
                    fits = at < len(part.starts)
                    fits[fits] = (part.starts[at[fits]] == starts[here][fits] - part.base) & (part.left[at[fits]] >= w)
                    at, here = at[fits], here[fits]
                    same = part.prints(at, w) == prints[here]
                    out.extend((prints[k], part.line[part.total[a] : part.total[a + w] - 1].tobytes().decode()) for k, a in zip(here[same], at[same], strict=True))
            langs = one.column(1).take(pa.array(np.zeros(len(out), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array([x[0] for x in out], np.uint64).view(np.int64)), langs, pa.array([x[1] for x in out], pa.string())], ["print", "lang", "phrase"])


def _differing(frequent, longest: int):
    """(print, lang, phrase, n) of occurrences that have the fingerprint of a frequent phrase but another text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(1)
            for part in slices(batch):
                every, known = np.arange(len(part.starts)), np.zeros(0, bool)
                for words in range(1, longest + 1):
                    every = every[part.left[every] >= words]
                    if words > 1:  # the occurrences that were counted: all words, then all pairs in them are frequent
                        every = every[known[every] & known[every + 1]] if words == 2 else every[known[every + words - 2]]
                    at = every
                    unique, inverse = np.unique(part.prints(at, words), return_inverse=True)
                    found, text, edges = frequent.value.texts(unique)
                    hit = found[inverse]
                    at, inverse = at[hit], inverse[hit]
                    if words <= 2:
                        known = np.zeros(len(part.starts) + longest, bool)
                        known[at] = True
                    if words == 2:
                        every = at
                    for k in range(0, len(at), 1 << 17):
                        some, of = at[k : k + (1 << 17)], inverse[k : k + (1 << 17)]
                        size = part.total[some + words] - 1 - part.total[some]
                        differs = size != edges[of + 1] - edges[of]
                        even = np.flatnonzero(~differs)
                        wrong = part.line[ragged(part.total[some[even]], size[even])] != text[ragged(edges[of[even]], size[even])]
                        differs[even] = np.logical_or.reduceat(wrong, np.cumsum(size[even]) - size[even]) if len(even) else False
                        for a in some[differs]:
                            phrase = part.line[part.total[a] : part.total[a + words] - 1].tobytes().decode()
                            print_ = part.prints(np.array([a]), words).view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(print_), lang.slice(int(part.rows[part.row[a]]), 1), pa.array([phrase]), pa.array([1], pa.int64())], ["print", "lang", "phrase", "n"])

    return run


def _summed(rows: DataFrame, least: int) -> DataFrame:
    """Frequent fingerprints with their counts and a pointer; the empty phrase of a language always stays."""
    summed = rows.groupBy("print").agg(F.sum("n").alias("n"), F.min("key").alias("key"), F.min_by("place", "key").alias("place"))
    return cut_lineage(summed.where((F.col("n") >= least) | (F.col("place").bitwiseAND(7) == 0)))


def _broadcast(spark, table: Sorted):
    return spark.sparkContext.broadcast(table)  # a folder and one number a bucket


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``n`` of all phrases of at most ``longest`` words that occur ``least`` times or more; the empty phrase counts all words.

    Words are joined by one space. Null texts are empty, a null language is ``und``. Repeated rows count each time; an empty table gives no rows.
    """
    if not 2 <= longest <= 7:
        raise ValueError("phrases have at least two and at most seven words")
    spark = docs.sparkSession
    text, lang = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(F.xxhash64(lang, text).alias("key"), lang.alias("lang"), text.alias("text"))
    schema = "print long, n long, key long, place long"
    words = _summed(rows.mapInArrow(_counting_words, schema), least)
    pairs = _summed(rows.mapInArrow(_counting_pairs(_broadcast(spark, mapped(words))), schema), least)
    long = _summed(rows.mapInArrow(_counting_phrases(_broadcast(spark, mapped(pairs)), longest), schema), least) if longest > 2 else pairs.where("false")
    every = words.unionByName(pairs).unionByName(long)
    # a text holds no more pointers than phrases; the smallest hash wins, so pointers go to few texts
    pointers = cut_lineage(every.groupBy("key").agg(F.collect_list(F.struct("print", "place")).alias("pointers")))
    texts = rows.join(pointers.select("key"), "key", "left_semi").dropDuplicates(["key", "lang", "text"])
    fetched = texts.join(pointers, "key").select("key", "lang", "text", "pointers").mapInArrow(_fetching, "print long, lang string, phrase string").dropDuplicates(["print"])
    named = cut_lineage(every.select("print", "n", F.col("place").bitwiseAND(7).alias("words")).join(fetched, "print"))
    table = _broadcast(spark, mapped(named.where("words > 0"), texts=True))
    other = cut_lineage(rows.mapInArrow(_differing(table, longest), "print long, lang string, phrase string, n long"))
    off = other.groupBy("print").agg(F.sum("n").alias("off"))
    own = other.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).withColumn("words", F.size(F.split("phrase", " ")).cast("long"))
    exact = named.join(off, "print", "left").select("lang", "phrase", "words", (F.col("n") - F.coalesce("off", F.lit(0))).alias("n")).unionByName(own.select("lang", "phrase", "words", "n"))
    return exact.where((F.col("n") >= least) | (F.col("words") == 0))


def _whole(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def score_phrases(frequent: DataFrame, share: int = SHARE) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of the phrases of two words or more that no longer one replaces."""
    counts = frequent.where("words > 0").select("lang", "phrase", F.col("n").alias("f"))
    phrases = frequent.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    total = frequent.where("words = 0").select("lang", "n")
    # 1000 a n has at most 38 digits for corpora of under 10^16 words; the quotient is at most 10 n
    score = F.expr("(cast(1000 * a AS decimal(19,0)) * cast(n AS decimal(19,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(18,0)))")
    scored = cuts.join(total, "lang").select("lang", "phrase", F.struct(score.alias("score"), "k", "a", "l", "r", "n").alias("cut"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min("cut").alias("cut")).select("lang", "phrase", "cut.*")
    inside = phrases.where("words > 2").select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inside = inside.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
    inside = inside.select("lang", "a", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_whole(F.col("longer")) * 100 < _whole(F.col("a")) * share))
    return kept.select("lang", "phrase", "a", "l", "r", "n", "score")


def best_of_each(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language with their ``rank``; parts of a language give their first ``top`` to the last ranking."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    some = parts.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of the best phrases of each language.

    Texts are lower-cased (A-Z) and cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those into words ``[^\\x20\\x09]+``. ``a`` counts the phrase, ``n`` all words, ``l`` and ``r`` the parts
    of the cut with the smallest ``score`` = floor(1000 a n / (l r)), the first on ties. A phrase inside a longer one that is as frequent is left out. Equal scores are ordered by ``a``, then by the bytes of the
    phrase. Null and empty texts have no words, a null language is ``und``, repeated rows count each time, texts are read whole, an empty table gives no rows. Other columns are not read.
    """
    best = best_of_each(score_phrases(cut_lineage(frequent_phrases(docs, lang_col, text_col, longest, least))), top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = SHARE) -> str:
    """The same in SQL for DuckDB; all phrases are listed, so for small tables."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_LOWER_SQL}', '{_LOWER_SQL.lower()}') AS text FROM documents
), p AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)
), g AS (
  SELECT lang, m, w[i:i + m - 1] AS w FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, {longest + 1}) t(m))
), f AS MATERIALIZED (
  SELECT lang, m, w, array_to_string(w, ' ') AS phrase, count(*)::HUGEINT AS a FROM g GROUP BY lang, m, w HAVING count(*) >= {least}
), n AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang
), cuts AS (
  SELECT c.lang, c.phrase, c.m, k, c.a, x.a AS l, y.a AS r, n, 1000 * c.a * n // (x.a * y.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c JOIN f x ON x.lang = c.lang AND x.w = c.w[1:k] JOIN f y ON y.lang = c.lang AND y.w = c.w[k + 1:] JOIN n ON n.lang = c.lang
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, w[i:i + s - 1] AS w, max(a) AS longer FROM (SELECT lang, w, a, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM f WHERE m > 2)) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest LEFT JOIN (SELECT lang, array_to_string(w, ' ') AS phrase, longer FROM inside) USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {share} * a
QUALIFY rank <= {top}
"""
