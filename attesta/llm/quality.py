"""Quality rules: gradient-boosted trees over document statistics.

Statistics of all documents are computed in one pass over the texts, in numpy, and written to the shared folder. The trees are fitted on
the driver from the statistics of at most ``SAMPLE_ROWS`` labelled documents, chosen by a hash of their id: histogram splits, Newton
steps for the logistic loss, and monotonic constraints (more symbols, repeats, doubled lines or capitals never raise a score).
Trees are flattened into numpy node arrays, through which all rows of a batch go down together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.text import mix, prefix_sums, rows_of, span_hashes, tiles, words
from attesta.session import cut_lineage

SAMPLE_ROWS = 20_000
MIN_WORDS = 50
REPEAT_PERCENT = 50
KEEP_FROM = 0.5
TREES, DEPTH, BINS, RATE, L2, MIN_ROWS = 80, 4, 64, 0.2, 1.0, 5
#: The symbols of the rule.
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Each statistic with the direction in which the score may move.
STATISTICS = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "bar_share": -1, "dup_line_share": -1, "repeat_share": -1, "capital_share": -1, "exclaim_share": -1,
    "distinct_share": 0, "top_word_share": -1, "digit_share": 0, "stop_share": 0, "line_words": 0, "markup_share": -1,
}


def _table(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(values, np.uint8)] = True
    return out


_IS = {
    "symbol": _table(SYMBOLS), "bar": _table(b"|"), "capital": _table(bytes(range(65, 91))), "letter": _table(bytes(range(65, 91)) + bytes(range(97, 123))),
    "exclaim": _table(b"!"), "digit": _table(b"0123456789"), "stop": _table(b".,;:?"), "markup": _table(b"<>{}[]"),
}


def counts_and_statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The five counts of each row, and its statistics as a matrix."""
    rows = len(offsets) - 1
    starts, ends, word_offsets = words(data, offsets)
    n_words = np.diff(word_offsets)

    def per_row(flags: np.ndarray, edge: np.ndarray = offsets) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return np.diff(total[edge])

    # white space has no continuation bytes, so the characters of words are first bytes outside white space
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = np.diff(np.concatenate([[0], np.cumsum(points[ends] - points[starts])])[word_offsets])
    count = {name: per_row(table[data]) for name, table in _IS.items()}
    sums = prefix_sums(data)
    feeds = np.flatnonzero(data == 10)
    line_start, line_end = np.sort(np.append(offsets[:-1], feeds + 1)), np.sort(np.append(offsets[1:], feeds))
    full = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[full], line_end[full]
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    salt = mix(np.arange(1, rows + 1, dtype=np.uint64))
    own_lines = np.unique(span_hashes(sums, line_start, line_end) ^ salt[line_row], return_index=True)[1]
    n_lines = np.bincount(line_row, minlength=rows)
    n_dup = n_lines - np.bincount(line_row[own_lines], minlength=rows)
    each = span_hashes(sums, starts, ends)
    word_row = rows_of(word_offsets)
    _, first, many = np.unique(mix(each ^ salt[word_row]), return_index=True, return_counts=True)
    distinct = np.bincount(word_row[first], minlength=rows)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, word_row[first], many)
    repeated = np.zeros(len(starts), bool)
    if len(starts) > 2:
        window = np.flatnonzero(word_row[2:] == word_row[:-2])
        grams = mix(mix(each[window] * np.uint64(3) + each[window + 1]) * np.uint64(5) + each[window + 2]) ^ salt[word_row[window]]
        _, inverse, many = np.unique(grams, return_inverse=True, return_counts=True)
        twice = window[many[inverse] > 1]
        for k in range(3):
            repeated[twice + k] = True
    n_repeat = per_row(repeated, word_offsets)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    matrix = np.stack(
        [
            np.log1p(n_words), word_chars / w, count["symbol"] / c, count["bar"] / w, n_dup / np.maximum(n_lines, 1), n_repeat / w, count["capital"] / np.maximum(count["letter"], 1),
            count["exclaim"] / w, distinct / w, top / w, count["digit"] / c, count["stop"] / w, n_words / np.maximum(n_lines, 1), count["markup"] / c,
        ],
        axis=1,
    )
    return [n_words, word_chars, count["symbol"], n_dup, n_repeat], matrix


@dataclass
class Trees:
    """Boosted trees as flat node arrays; a leaf points to itself."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        at_row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[at_row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def _best_split(binned, grad, hess, rows, direction, low, high):
    """The best split of the rows: gain, feature, bin, values of both sides; None if none gains."""
    best = None
    g_all, h_all = grad[rows].sum(), hess[rows].sum()
    for f in range(binned.shape[1]):
        bins = binned[rows, f]
        g = np.cumsum(np.bincount(bins, grad[rows], BINS))[:-1]
        h = np.cumsum(np.bincount(bins, hess[rows], BINS))[:-1]
        n = np.cumsum(np.bincount(bins, minlength=BINS))[:-1]
        left, right = np.clip(-g / (h + L2), low, high), np.clip(-(g_all - g) / (h_all - h + L2), low, high)
        gain = -(g * left + 0.5 * (h + L2) * left**2) - ((g_all - g) * right + 0.5 * (h_all - h + L2) * right**2)
        allowed = (n >= MIN_ROWS) & (len(rows) - n >= MIN_ROWS) & (direction[f] * (right - left) >= 0)
        gain = np.where(allowed, gain, -np.inf)
        k = int(gain.argmax())
        if np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
            best = (gain[k], f, k, left[k], right[k])
    own = np.clip(-g_all / (h_all + L2), low, high)
    return best if best and best[0] > -(g_all * own + 0.5 * (h_all + L2) * own**2) + 1e-9 else None


def fit(x: np.ndarray, y: np.ndarray, direction: list[int]) -> Trees:
    """Trees for the probability that ``y`` is 1. One class only, or no rows: a constant."""
    share = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if len(np.unique(y)) == 2:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        total = np.full(len(x), start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)

            def grow(rows, depth, low, high, value):
                me = len(nodes)
                nodes.append([0, np.inf, me, me, RATE * value])
                split = _best_split(binned, grad, hess, rows, direction, low, high) if depth < DEPTH and len(rows) >= 2 * MIN_ROWS else None  # noqa: B023
                if split:
                    _, f, k, a, b = split
                    goes = binned[rows, f] <= k
                    middle = (a + b) / 2
                    # a constrained split bounds what lies below it
                    bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[direction[f]]
                    nodes[me][:2] = [f, cuts[f][k] if k < len(cuts[f]) else np.inf]
                    nodes[me][2] = grow(rows[goes], depth + 1, *bounds[0], a)
                    nodes[me][3] = grow(rows[~goes], depth + 1, *bounds[1], b)
                else:
                    total[rows] += RATE * value  # noqa: B023
                return me

            roots.append(grow(np.arange(len(x)), 0, -8.0, 8.0, float(np.clip(-grad.sum() / (hess.sum() + L2), -8, 8))))
    columns = list(zip(*nodes, strict=True)) if nodes else [[0], [np.inf], [0], [0], [0.0]]
    return Trees(start, np.array(roots, int), np.array(columns[0], int), np.array(columns[1], float), np.array(columns[2], int), np.array(columns[3], int), np.array(columns[4], float))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in tiles(batches, "text"):
        counts, matrix = counts_and_statistics(data, offsets)
        yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, counts), *map(pa.array, matrix.T.copy())], ["id", *COUNTS, *STATISTICS])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the counts and the statistics of whole texts (a null text has no words)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in STATISTICS])
    return rows.mapInArrow(_statistics, schema)


def labelled_sample(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``sample_rows`` labelled documents, chosen by a hash of the id. Null labels and ids are left out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    # in the order of ids: sums over the sample are then the same in every run
    # the broadcast side has at most sample_rows rows; ids that name several rows are cut back to the bound
    table = statistics.join(F.broadcast(chosen), "id").select("id", "label", *STATISTICS).orderBy("id", "label", *STATISTICS).limit(sample_rows).toArrow()
    return np.stack([table.column(c).to_numpy() for c in STATISTICS], axis=1).reshape(-1, len(STATISTICS)), table.column("label").to_numpy()


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep_from: float = KEEP_FROM) -> DataFrame:
    """Per row: id, the counts, ``base_failed``, ``kept``, ``quality`` (the probability of a good label).

    ``base_failed``: fewer than 50 words, or more than half of the words in three-word windows that the text has twice or more. ``kept`` is false
    for those, else the verdict of the trees. Without labels of both classes the trees keep everything. A null text has no
    words. Repeated rows come out as often as they went in; an empty table gives no rows. Other columns are left out.
    """
    statistics = cut_lineage(document_statistics(docs, id_col, text_col))
    trees = fit(*labelled_sample(statistics, labels, id_col, label_col), list(STATISTICS.values()))
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    id_type = statistics.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in STATISTICS], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(COUNTS)], pa.array(shared.value.probability(x))], ["id", *COUNTS, "quality"])

    scored = statistics.mapInArrow(score, f"id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return scored.select(F.col("id").alias(id_col), *COUNTS, failed.alias("base_failed"), (~failed & (F.col("quality") >= keep_from)).alias("kept"), "quality")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns. Rows are judged where they are read: nothing is joined or shuffled.

    The trees are fitted from at most ``SAMPLE_ROWS`` labelled documents. Whole texts; a null or empty text has no words and goes. Repeated rows
    stay or go together, an empty table stays empty.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").withColumnRenamed("_id", id_col)
    trees = fit(*labelled_sample(cut_lineage(document_statistics(sample, id_col, "text")), labels, id_col, label_col), list(STATISTICS.values()))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tiles(batches, text_col):
            counts, matrix = counts_and_statistics(data, offsets)
            failed = (counts[0] < MIN_WORDS) | (100 * counts[4] > REPEAT_PERCENT * counts[0])
            yield rows.filter(pa.array(~failed & (shared.value.probability(matrix) >= keep_from)))

    return docs.mapInArrow(sift, docs.schema)
