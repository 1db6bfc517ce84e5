"""BPE encoding and decoding with a transducer lexicon for frequent words.

Words are runs between ASCII white space. Spark counts them over all texts; the most frequent ones (a bounded number) get their ids on the
driver and are compiled into a minimal acyclic automaton: common suffixes are shared, and adding up the counts along a
path gives the number of the word, which points to its ids. The automaton lies in the shared folder as sorted arrays that
every worker maps into memory. A task walks it for all new words at once, one byte a step; words that are not in it are merged exactly,
in numpy, each round merging the best pair of every word.

The scheme is the one of a tokenizer file with NFC, lower case, a word pattern, byte-level characters and an end-of-word
mark; other schemes are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm.files import map_arrays, save_arrays, shared_folder
from attesta.llm.text import ragged, tiles
from attesta.session import cut_lineage

LEXICON_WORDS = 1 << 18
KNOWN_WORDS = 1 << 19
LONGEST_LEXICON_WORD = 64
LONGEST_IN_STEP = 40
NO_RANK = np.int32(2**31 - 1)
#: Fixed value: the word pattern and the normalisation of the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follows from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merger:
    """Exact encoding of a run of text, from the vocabulary and merges of a tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or pattern != PATTERN or not model["end_of_word_suffix"] or spec["decoder"]:
            raise ValueError("this tokenizer file follows another scheme")
        self.ids = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): rank for rank, m in enumerate(model["merges"])}
        self.characters = byte_characters()
        self.words = regex.compile(PATTERN)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.size = 1 + max(self.ids.values())
        pairs = [(self.ids[a] * self.size + self.ids[b], rank, self.ids[a + b]) for (a, b), rank in self.ranks.items()]
        self.pair, self.pair_rank, self.pair_id = (np.array(x, t) for x, t in zip(zip(*sorted(pairs), strict=True), (np.int64, np.int32, np.int32), strict=True))
        self.first_ids = {c: self.ids[c] for c in self.characters}
        self.last_ids = {c: self.ids[c + self.end] for c in self.characters}
        whole = Tokenizer.from_str(json.dumps(spec))
        self.newer = (whole.normalizer, whole.pre_tokenizer)
        self.tokens = {**{i: t for t, i in self.ids.items()}, **{i: t for t, i in self.special.items()}}

    def merge(self, word: str) -> list[int]:
        """The ids of one word in byte-level characters: the pair of lowest rank, leftmost first, is merged until none is left."""
        parts = list(word)
        parts[-1] += self.end
        n, ranks = len(parts), self.ranks
        right, left = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = right[i]
            if j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (parts[a], parts[b]) in ranks:
                    heapq.heappush(queue, (ranks[parts[a], parts[b]], a, (parts[a], parts[b])))
        return [self.ids[p] for p in parts if p]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the merge of each pair of ids; negative ids have none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], NO_RANK), self.pair_id[at]

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """``merge`` for many words: those of one length are a matrix, and each round merges the best pair of every row, leftmost first."""
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if len(word) > LONGEST_IN_STEP:
                out[k] = self.merge(word)
            else:
                by_length.setdefault(len(word), []).append(k)
        first, last = self.first_ids, self.last_ids
        for length, members in by_length.items():
            ids = np.array([[*map(first.__getitem__, words[k][:-1]), last[words[k][-1]]] for k in members], np.int32)
            rows = np.array(members)
            column = np.arange(length)
            rank, into = self._rank(ids[:, :-1], ids[:, 1:])
            while len(rows):
                best = rank.argmin(axis=1) if length > 1 else np.zeros(len(rows), int)
                going = rank[np.arange(len(rows)), best] < NO_RANK if length > 1 else np.zeros(len(rows), bool)
                for k, found in zip(rows[~going].tolist(), ids[~going].tolist(), strict=True):
                    out[k] = found[: found.index(-1)] if found[-1] < 0 else found
                rows, ids, rank, into, best = rows[going], ids[going], rank[going], into[going], best[going]
                if not len(rows):
                    break
                at = np.arange(len(rows))
                ids[at, best] = into[at, best]
                # what stands to the right of the pair moves up by one
                source = np.minimum(column + (column > best[:, None]), length - 1)
                ids = np.take_along_axis(ids, source, axis=1)
                ids[:, -1] = -1
                source = source[:, : length - 1]
                source = np.minimum(source, length - 2)
                rank, into = np.take_along_axis(rank, source, axis=1), np.take_along_axis(into, source, axis=1)
                rank[:, -1] = NO_RANK
                for k in (best - 1, best):
                    inside = (k >= 0) & (k < length - 1)
                    row, k = at[inside], k[inside]
                    rank[row, k], into[row, k] = self._rank(ids[row, k], ids[row, k + 1])
        return out

    def encode_many(self, runs: list[str]) -> list[list[int]]:
        """The ids of each run of text; special tokens in it count as such."""
        words: dict[str, int] = {}
        parts: list[list[int]] = []
        for run in runs:
            mine: list[int] = []
            for part in self.specials.split(run) if self.specials and "<" in run else (run,):
                if part in self.special:
                    mine.append(-1 - self.special[part])
                elif part:
                    mine += [words.setdefault(w, len(words)) for w in self.split(part)]
            parts.append(mine)
        ids = self.merge_many(list(words))
        return [ids[mine[0]] if len(mine) == 1 and mine[0] >= 0 else [i for k in mine for i in (ids[k] if k >= 0 else (-1 - k,))] for mine in parts]

    def encode(self, run: str) -> list[int]:
        return self.encode_many([run])[0]

    def split(self, text: str) -> list[str]:
        """The words of the pattern in byte-level characters."""
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text):
            # characters newer than Python's tables: the tokenizers library has its own
            return [word for word, _ in self.newer[1].pre_tokenize_str(self.newer[0].normalize_str(text))]
        # each character is lower-cased by itself: no final sigma
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        characters = self.characters
        found = (text,) if text.isalpha() else self.words.findall(text)
        return [word if word.isascii() and word.isprintable() else "".join([characters[b] for b in word.encode()]) for word in found]


def compile_lexicon(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct ``words``.

    ``edge`` holds state * 256 + byte in ascending order, ``target`` the next state, ``before`` how many words of the state
    come before those of the edge, ``final`` whether a word ends in the state. State 0 is the start. The sum of ``before`` along a path, plus one for
    each final state that is passed, is the number of the word.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, dict[int, int]]] = []
    # the path of the last word: whether a word ends here, and the edges to finished states
    path: list[list] = [[False, {}]]
    labels: list[int] = []

    def finish(depth: int) -> None:
        while len(path) - 1 > depth:
            ends, edges = path.pop()
            key = (ends, tuple(edges.items()))
            state = register.get(key)
            if state is None:
                state = register[key] = len(states)
                states.append((ends, edges))
            path[-1][1][labels.pop()] = state

    for word in words:
        common = 0
        while common < min(len(word), len(labels)) and word[common] == labels[common]:
            common += 1
        finish(common)
        for b in word[common:]:
            labels.append(b)
            path.append([False, {}])
        path[-1][0] = True
    finish(0)
    start = len(states)
    states.append((path[0][0], path[0][1]))
    size = [0] * len(states)
    edge, target, before = [], [], []
    for state, (ends, edges) in enumerate(states):  # targets are finished before their sources
        passed = int(ends)
        for b, to in edges.items():
            edge.append((start - state) * 256 + b)
            target.append(start - to)
            before.append(passed)
            passed += size[to]
        size[state] = passed
    order = np.argsort(edge) if edge else np.zeros(0, int)
    return {
        "edge": np.array(edge, np.int64)[order], "target": np.array(target, np.int32)[order], "before": np.array(before, np.int32)[order],
        "final": np.array([ends for ends, _ in reversed(states)], bool),
    }


def walk(edge: np.ndarray, target: np.ndarray, before: np.ndarray, final: np.ndarray, words: list[bytes]) -> np.ndarray:
    """The number of each word, -1 where it is not in the automaton; all words take a step together."""
    n = len(words)
    length = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    offset = np.cumsum(length) - length
    number, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
    alive = np.arange(n) if len(edge) else np.zeros(0, np.int64)
    number[length > (LONGEST_LEXICON_WORD if len(edge) else -1)] = -1
    alive = alive[number[alive] >= 0]
    step = 0
    while len(alive):
        done = length[alive] == step
        number[alive[done & ~final[state[alive]]]] = -1
        alive = alive[~done]
        key = state[alive] * 256 + data[offset[alive] + step]
        at = np.minimum(np.searchsorted(edge, key), len(edge) - 1)
        hit = edge[at] == key
        number[alive[~hit]] = -1
        alive, at = alive[hit], at[hit]
        number[alive] += before[at]
        state[alive] = target[at]
        step += 1
    return number


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[bytes] = Counter()
        for rows, data, offsets in tiles([batch], "text"):
            # a row ends a word: white space between rows keeps them apart
            counts.update(b" ".join(data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)).split())
        counts = {w: n for w, n in counts.items() if len(w) <= LONGEST_LEXICON_WORD}
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def build_lexicon(texts: DataFrame, merger: Merger, size: int = LEXICON_WORDS) -> str:
    """Count the words of ``texts`` (column text), compile the most frequent ones, at most ``size``, return the folder of the arrays."""
    counted = texts.select("text").mapInArrow(_counting, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counted = cut_lineage(counted.withColumn("grade", F.floor(F.log2("n") * 8)))
    # grades of frequency, a few hundred rows: the lowest from which on all words fit
    grade, room = 1 << 30, size
    for row in counted.groupBy("grade").agg(F.count("*").alias("words")).orderBy(F.desc("grade")).collect():
        room -= row.words
        if room < 0:
            break
        grade = row.grade
    words = sorted(counted.where(F.col("grade") >= grade).select("word").toArrow().column("word").to_pylist())
    ids = merger.encode_many([w.decode() for w in words])
    folder = shared_folder(texts.sparkSession, "lexicon")
    arrays = compile_lexicon(words)
    save_arrays(folder, **arrays, ids=np.array([i for x in ids for i in x], np.uint32), ids_at=np.cumsum([0, *map(len, ids)]))
    return folder


class Encoder:
    """Encodes flat text in a task. Words that were seen stay known up to a bounded number."""

    def __init__(self, merger: Merger, folder: str):
        self.merger = merger
        self.automaton = map_arrays(folder, "edge", "target", "before", "final")
        self.ids, self.ids_at = map_arrays(folder, "ids", "ids_at")
        self.strings = {i: t.encode() + b" " for i, t in merger.tokens.items()}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.word_ids, self.word_text = [], []
        self.id_count = np.zeros(0, np.int64)
        self.text_size = np.zeros(0, np.int64)
        self.flat_ids, self.flat_text = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _learn(self, words: list[bytes]) -> None:
        numbers = walk(*self.automaton, words)
        others = np.flatnonzero(numbers < 0).tolist()
        merged = dict(zip(others, self.merger.encode_many([words[k].decode() for k in others]), strict=True))
        known, strings = self.known, self.strings
        ids, texts = [], []
        for k, (word, number) in enumerate(zip(words, numbers.tolist(), strict=True)):
            known[word] = len(known)
            mine = self.ids[self.ids_at[number] : self.ids_at[number + 1]].tolist() if number >= 0 else merged[k]
            ids.append(mine)
            texts.append(b"".join([strings[i] for i in mine]))
        self.id_count = np.append(self.id_count, [len(x) for x in ids])
        self.text_size = np.append(self.text_size, [len(x) for x in texts])
        self.flat_ids = np.append(self.flat_ids, np.array([i for x in ids for i in x], np.uint32))
        self.flat_text = np.append(self.flat_text, np.frombuffer(b"".join(texts), np.uint8))
        self.id_at = np.cumsum(self.id_count) - self.id_count
        self.text_at = np.cumsum(self.text_size) - self.text_size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
        """Ids of all rows with their offsets, and the decoded text (each token and a space) with its offsets."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        rows = [data[a:b].tobytes().split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        flat = [w for row in rows for w in row]
        new = list({*flat}.difference(self.known))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        edge = np.cumsum([0, *map(len, rows)])
        if not len(flat):
            return np.zeros(0, np.uint32), edge, b"", edge
        ids = self.flat_ids[ragged(self.id_at[at], self.id_count[at])]
        text = self.flat_text[ragged(self.text_at[at], self.text_size[at])].tobytes()
        id_edge = np.concatenate([[0], np.cumsum(self.id_count[at])])[edge]
        text_edge = np.concatenate([[0], np.cumsum(self.text_size[at])])[edge]
        return ids, id_edge, text, text_edge


def decode(ids: list[int], merger: Merger) -> str:
    """The tokens joined by one space, as the scheme has no decoder."""
    return " ".join(merger.tokens[i] for i in ids)


def _encoding(merger, folder: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merger.value, folder)
        for rows, data, offsets in tiles(batches, "text"):
            ids, id_edge, text, text_edge = encoder.encode(data, offsets)
            raw = ids.astype("<u4").tobytes()
            pairs = list(zip(id_edge[:-1].tolist(), id_edge[1:].tolist(), strict=True))
            decoded = [text[a : max(a, b - 1)] for a, b in zip(text_edge[:-1].tolist(), text_edge[1:].tolist(), strict=True)]
            columns = [rows.column(0), pa.array(np.diff(id_edge)), pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in pairs]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.ListArray.from_arrays(pa.array(id_edge.astype(np.int32)), pa.array(ids.astype(np.int64))), pa.array([x.decode() for x in decoded])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` (ids as little-endian 32-bit integers), ``decoded_sha256``; with ``keep`` also ``ids`` and ``decoded``.

    Whole texts; a null text reads as empty and has no tokens. Repeated rows come out as often as they went in, an empty table gives no
    rows. ``tokenizer_file`` is read by the driver. Other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    with open(tokenizer_file, encoding="utf-8") as file:
        merger = Merger(json.load(file))
    folder = build_lexicon(rows, merger, lexicon_words)
    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep
    return rows.mapInArrow(_encoding(spark.sparkContext.broadcast(merger), folder, keep), schema).withColumnRenamed("id", id_col)
