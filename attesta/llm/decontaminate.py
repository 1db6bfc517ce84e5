"""Benchmark decontamination: documents that hold a test item, give or take an error budget of edits.

Pigeonhole: an item with a budget of k edits is split into k + 1 pieces; wherever the item occurs within the budget, at least one piece occurs
unchanged. One Aho-Corasick automaton finds all exact pieces in a text. Around a hit Myers' bit-parallel algorithm computes the edit
distance to the best substring, first for the two pieces that the hit is part of, with a budget of one, then for twice as many, up to the whole
item (Navarro and Baeza-Yates 2001): parts of p pieces have a budget of p - 1, and if the whole is within its budget, so is all
that stands above some exact piece. So chance hits cost a few dozen characters, and no occurrence is lost.

Texts and items are compared in lower case, with every run of other than letters and digits read as one space, and a space at both ends: an item that begins or
ends inside a word of the text pays an edit for it, so short items are not found in longer words. Items are taken in blocks of
bounded size (one pass over the documents each), so only a block is ever broadcast.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET_SHARE = 0.08
BLOCK_BYTES = 8 << 20
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """The words of a text with one space between and around them; empty if there are none."""
    words = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


_matchers: dict[str, Matcher] = {}


def matcher_of(key: str, items: list[tuple[object, str]], share: float) -> Matcher:
    """The matcher of a block of items, built once in a worker; a worker keeps the last one."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, share)
    return _matchers[key]


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """Start and end of budget + 1 nearly equal pieces."""
    edge = [length * k // (budget + 1) for k in range(budget + 2)]
    return list(zip(edge[:-1], edge[1:], strict=True))


def best_distance(item: str, text: str, stop: int, masks: dict[str, int] | None = None) -> int:
    """The smallest edit distance of ``item`` to any substring of ``text``, or stop + 1 if it is larger (Myers 1999)."""
    masks = masks if masks is not None else character_masks(item)
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        # a substring may begin anywhere: no carry comes in from the left
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
    return min(best, stop + 1)


def character_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for k, c in enumerate(item):
        masks[c] |= 1 << k
    return dict(masks)


def climbs(length: int, budget: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """Each piece (start, end) with the parts above it (start, end, budget), the whole item last."""
    leaves = pieces(length, budget)
    out = [(a, b, []) for a, b in leaves]

    def part(first: int, last: int) -> None:
        if last - first == 1:
            return
        middle = (first + last) // 2
        part(first, middle)
        part(middle, last)
        for leaf in out[first:last]:
            leaf[2].append((leaves[first][0], leaves[last - 1][1], last - first - 1))

    part(0, len(leaves))
    return out


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[object, str]], share: float):
        self.items = []
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        found: dict[str, list[tuple]] = defaultdict(list)
        for item_id, text in items:
            if text:
                budget = int(len(text) * share)
                for a, b, above in climbs(len(text), budget):
                    found[text[a:b]].append((len(self.items), a, above))
                self.items.append((item_id, text, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def _distance(self, number: int, part: tuple[int, int, int], text: str, start: int) -> int:
        """The distance of a part of an item to the text around where it should stand, if the item starts at ``start``."""
        a, b, budget = part
        item = self.items[number][1][a:b]
        masks = self.masks.get((number, a, b))
        if masks is None:
            masks = self.masks[number, a, b] = character_masks(item)
        return best_distance(item, text[max(0, start + a - budget) : start + b + budget], budget, masks)

    def distances(self, text: str) -> dict[int, int]:
        """The distance of each item that occurs in a normalised text."""
        out: dict[int, int] = {}
        tried = set()
        for end, (length, places) in self.automaton.iter(text) if self.items else ():
            for number, offset, above in places:
                start = end + 1 - length - offset
                if out.get(number) == 0 or (number, start) in tried:
                    continue
                found = 0
                for part in above:
                    found = self._distance(number, part, text, start)
                    if found > part[2]:
                        break
                else:
                    tried.add((number, start))
                    out[number] = min(found, out.get(number, found))
        return out


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", share: float = BUDGET_SHARE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row (id, item id, ``distance``) for each document and item that occurs in it within ``share`` of its length in edits.

    Whole texts; null or empty texts hold nothing, items without letters or digits are in nothing. Equal items are found each under
    its own id, repeated rows once each. Empty tables give no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tests = items.where(F.col(item_text_col).isNotNull()).select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    id_type, item_type = rows.schema["id"].dataType, tests.schema["item_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(item_type)

    def searching(block):
        key = uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(key, block.value, share)
            for batch in batches:
                at, item, distance = [], [], []
                for k, text in enumerate(batch.column(1)):
                    for number, d in matcher.distances(normal(text.as_py())).items():
                        at.append(k)
                        item.append(matcher.items[number][0])
                        distance.append(d)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, arrow), pa.array(distance, pa.int32())], ["id", "item_id", "distance"])

        return search

    found = None
    for shared in item_blocks(tests, block_bytes):
        part = rows.mapInArrow(searching(shared), f"id {id_type.simpleString()}, item_id {item_type.simpleString()}, distance int")
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("id").alias(id_col), F.col("item_id").alias(item_id_col), "distance")


def item_blocks(tests: DataFrame, block_bytes: int) -> Iterator:
    """Broadcast lists of (item_id, normalised text), each of about ``block_bytes``; at least one."""
    blocks = 1 + (tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    for k in range(blocks):
        block = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about block_bytes of text
        yield tests.sparkSession.sparkContext.broadcast([(r.item_id, normal(r.text)) for r in block])


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", share: float = BUDGET_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; each block of items sifts what the one before has left.

    Whole texts; rows with a null or empty text hold nothing and stay, as repeated rows do. Without items all rows stay, an empty table stays empty.
    """
    tests = items.where(F.col(item_text_col).isNotNull()).select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))

    def sifting(block):
        key = uuid.uuid4().hex

        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(key, block.value, share)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                yield batch.filter(pa.array([not matcher.distances(normal(t.as_py())) for t in texts], pa.bool_()))

        return sift

    for shared in item_blocks(tests, block_bytes):
        docs = docs.mapInArrow(sifting(shared), docs.schema)
    return docs
