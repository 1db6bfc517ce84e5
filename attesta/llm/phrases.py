"""Substring dedup on words: words covered by a phrase of a given length that also starts in an earlier document are removed.

Method: recurring passages are brought together by content-defined anchors (``anchors``), equal pieces of text counted
once. The anchors deal the pieces over shards; each shard confirms which phrases recur in two or more documents, compiles
them into an Aho-Corasick automaton, and streams its pieces, which together hold the text of all documents around every
anchor that was seen twice, through it to locate each occurrence. A word of the vocabulary of a shard is one character
of the automaton, so matches are whole words, compared exactly.

A shard holds whole groups of pieces up to a bounded number of words. The pieces of anchors that occur more than ``HEAVY`` times are salted by document,
and cut into single phrases that Spark groups by their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.anchors import COUNTED_BITS, keyed, recurring, with_text, word_units
from attesta.llm.text import ragged, tiles, words

WINDOW = 13
GRAM = 5
HEAVY = 4096
SALTS = 16
SHARD_WORDS = 1 << 17


def _cutting(window: int, singly: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of the representatives of pieces, or of each of their windows, joined by one space."""
        for rows, data, offsets in tiles(batches, "text"):
            lists = rows.column(rows.schema.get_field_index("found"))
            starts, ends, word_offsets = words(data, offsets)
            item = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            mine = item.field("heavy").to_numpy(zero_copy_only=False) == singly
            item, owner = item.filter(pa.array(mine)), owner[mine]
            at, n = word_offsets[owner] + item.field("at").to_numpy(), item.field("n").to_numpy().astype(np.int64)
            taken = np.arange(len(n))
            lo = np.zeros(len(n), np.int64)
            length = n + window - 1
            if singly:
                taken, lo = np.repeat(taken, n), ragged(np.zeros(len(n), np.int64), n)
                at, length = at[taken] + lo, np.full(len(taken), window)
            text = spaced(data, starts, ends, ragged(at, length), np.concatenate([[0], np.cumsum(length)]))
            names = ["anchor", "piece", "first", "several"]
            yield pa.RecordBatch.from_arrays([item.field(c).take(pa.array(taken)) for c in names] + [pa.array(lo), pa.array(text, pa.binary())], [*names, "lo", "text"])

    return cut


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chosen: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The chosen words of each row, joined by one space."""
    length = ends[chosen] - starts[chosen] + 1
    total = np.concatenate([[0], np.cumsum(length)])
    index = ragged(starts[chosen], length)
    body = np.append(data, np.uint8(32))[index]
    body[total[1:] - 1] = 32
    flat_ = body.tobytes()
    at = total[offsets]
    return [flat_[a : b - 1] if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def recurring_phrases(coded: list[str], first: list, several: list, window: int) -> ahocorasick.Automaton | None:
    """Phrases of ``window`` characters that occur in two or more documents, with the first document of each, as an automaton.

    ``several`` says whether a piece of text occurs in more documents than its first.
    """
    seen: dict[str, list] = {}
    for text, lo, more in zip(coded, first, several, strict=True):
        for k in range(len(text) - window + 1):
            phrase = text[k : k + window]
            known = seen.get(phrase)
            if known is None:
                seen[phrase] = [lo, more]
            else:
                known[1] |= more or lo != known[0]
                if lo is not None and (known[0] is None or lo < known[0]):
                    known[0] = lo
    automaton = ahocorasick.Automaton()
    for phrase, (lo, more) in seen.items():
        if lo is not None and more:
            automaton.add_word(phrase, lo)
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def _code(texts: list[bytes]) -> list[str]:
    """Each text with one character for a word; surrogates are no characters."""
    known: dict[bytes, str] = {}
    out = []
    for text in texts:
        each = text.split(b" ")
        for word in each:
            if word not in known:
                k = len(known) + 1
                known[word] = chr(k if k < 0xD800 else k + 0x800)
        out.append("".join([known[w] for w in each]))
    return out


def _scanning(window: int, id_type: pa.DataType):
    def shard(rows: list[tuple]) -> pa.RecordBatch:
        coded = _code([r[4] for r in rows])
        automaton = recurring_phrases(coded, [r[2] for r in rows], [r[3] for r in rows], window)
        out: tuple[list, ...] = ([], [], [], [], [])
        for row, text in zip(rows, coded, strict=True) if automaton else ():
            at, length, was = -1, 0, None
            for end, found in automaton.iter(text):
                start = end - window + 1
                if start == at + length and found == was:
                    length += 1
                    continue
                if length:
                    for column, value in zip(out, (row[0], row[1], at, length, was), strict=True):
                        column.append(value)
                at, length, was = start, 1, found
            if length:
                for column, value in zip(out, (row[0], row[1], at, length, was), strict=True):
                    column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), id_type)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["anchor", "piece", "lo", "len", "before"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD_WORDS and row[0] != held[-1][0]:
                    yield shard(held)
                    held, size = [], 0
                held.append(row)
                size += row[4].count(b" ") + 1
        if held:
            yield shard(held)

    return scan


def earlier_phrases(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """``id``, ``text_hash`` and ``spans`` (list of lo, len: starts of phrases that an earlier document has) per row with any."""
    if window - gram + 1 > 255:
        raise ValueError(f"a window has at most {254 + gram} words: the windows of a piece are counted in eight bits")
    id_field = docs.schema["id"]
    id_type = id_field.dataType.simpleString()
    found, frequent = recurring(docs, word_units, window, gram, heavy)
    found = found.select(F.shiftrightunsigned("anchor", 64 - COUNTED_BITS).alias("lead"), "anchor", "piece", "id", "text_hash", (F.shiftleft("at", 8) + F.col("n")).alias("place"))
    # one shuffle of the occurrences serves both to count pieces and to hand out what was found in them; frequent anchors are
    # salted. The filter says what the join below would otherwise say on one side only.
    salt = F.when(F.col("often").isNotNull(), F.pmod(F.hash("id", "text_hash"), F.lit(SALTS))).otherwise(-1).cast("int")
    dealt = (
        found.join(frequent.select("lead", F.lit(True).alias("often")), "lead", "left")
        .select("anchor", "piece", salt.alias("salt"), "id", "text_hash", "place")
        .where("anchor IS NOT NULL AND piece IS NOT NULL AND salt IS NOT NULL AND text_hash IS NOT NULL")
        .repartition("anchor", "piece", "salt")
    )
    # ids first: the least struct is the first document with one, and null only if there is none
    parts = dealt.groupBy("anchor", "piece", "salt").agg(
        F.max("id").alias("last"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "place")).alias("r"), F.max(F.col("id").isNull()).alias("nulls"), F.max("salt").alias("_salt")
    )
    rare = parts.where("_salt < 0").select("anchor", "piece", "last", "r", "nulls", F.lit(False).alias("heavy"))
    often = parts.where("_salt >= 0").groupBy("anchor", "piece").agg(F.max("last").alias("last"), F.min("r").alias("r"), F.max("nulls").alias("nulls"), F.lit(True).alias("heavy"))
    pieces = rare.unionByName(often)
    more = F.col("nulls") | F.coalesce(F.col("last") > F.col("r.id"), F.lit(False))
    item = F.struct("anchor", "piece", F.col("r.id").alias("first"), more.alias("several"), F.shiftright("r.place", 8).alias("at"), F.col("r.place").bitwiseAND(255).alias("n"), "heavy")
    wanted = pieces.groupBy(F.col("r.id").alias("id"), F.col("r.text_hash").alias("text_hash")).agg(F.collect_list(item).alias("found"))
    texts = with_text(docs, wanted).where("found IS NOT NULL").select("text", "found")
    schema = f"anchor long, piece long, first {id_type}, several boolean, lo long, text binary"
    from pyspark.sql.pandas.types import to_arrow_type

    scanned = (
        texts.mapInArrow(_cutting(window, False), schema).drop("lo").repartition("anchor").sortWithinPartitions("anchor", "piece")
        .mapInArrow(_scanning(window, to_arrow_type(id_field.dataType)), f"anchor long, piece long, lo long, len long, before {id_type}")
    )
    single = texts.mapInArrow(_cutting(window, True), schema)
    phrases = single.groupBy("text").agg(F.min("first").alias("before"))
    run = F.struct("lo", "len", "before")
    singly = single.join(phrases, "text").withColumn("len", F.lit(1).cast("long")).groupBy("anchor", "piece").agg(F.collect_list(run).alias("runs"))
    runs = scanned.select("anchor", "piece", F.lit(-1).alias("salt"), F.array(run).alias("runs"))
    runs = runs.unionByName(singly.select("anchor", "piece", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "runs"))
    return (
        dealt.join(runs, ["anchor", "piece", "salt"])
        .select("id", "text_hash", "place", F.inline("runs"))
        .where("before IS NOT NULL AND (id IS NULL OR before < id)")
        .groupBy("id", "text_hash")
        .agg(F.collect_list(F.struct((F.shiftright("place", 8) + F.col("lo")).alias("lo"), "len")).alias("spans"))
    )


def _removing(window: int, keep_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tiles(batches, "text"):
            starts, ends, word_offsets = words(data, offsets)
            lists = rows.column(rows.schema.get_field_index("spans"))
            filled = lists.fill_null([]) if lists.null_count else lists
            item = filled.flatten()
            owner = np.repeat(np.arange(len(filled)), np.diff(filled.offsets.to_numpy()))
            change = np.zeros(len(starts) + 1, np.int32)
            if len(item):
                lo = item.field("lo").to_numpy() + word_offsets[owner]
                np.add.at(change, lo, 1)
                np.add.at(change, lo + item.field("len").to_numpy() + window - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            kept = spaced(data, starts, ends, np.flatnonzero(~gone), word_offsets - total[word_offsets])
            columns = [
                rows.column(0), pa.array(np.diff(word_offsets)), pa.array(np.diff(total[word_offsets])),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary()).cast(pa.string())] * keep_text, ["id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text)

    return remove


def remove_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep_text: bool = False, heavy: int = HEAVY) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked, ``kept`` (words joined by one space).

    A word goes if a run of ``window`` words that covers it also starts in a row with a smaller id; phrases are judged on the input, words
    are ``[^\\x20\\x09-\\x0D]+`` and unchanged. Rows with equal ids do not shorten each other; a row without an id counts as later than
    all with one. A null text has no words, an empty table gives no rows. Other columns are left out.
    """
    rows = keyed(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    joined = with_text(rows, earlier_phrases(rows, window, gram, heavy)).select("id", "spans", "text")
    schema = f"id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return joined.mapInArrow(_removing(window, keep_text), schema).withColumnRenamed("id", id_col)
