"""Plain versions of the operators for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def repeated_bytes(texts: list[str | None], window: int) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + window] for d in data for k in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - window + 1):
            if seen[d[k : k + window]] > 1:
                gone[k : k + window] = b"\x01" * window
        spans = sum(1 for k in range(len(d)) if gone[k] and (not k or not gone[k - 1]))
        out.append((len(d), sum(gone), spans, sha(bytes(x for x, g in zip(d, gone, strict=True) if not g))))
    return out


def earlier_phrases(rows: list[tuple[int | None, str | None]], window: int) -> list[tuple]:
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            before = first.get(tuple(w[k : k + window]))
            if before is not None and (i is None or before < i):
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return out


def fingerprint(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    votes = Counter(b for g in grams for h in [xxhash.xxh64_intdigest(g, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in votes.items() if 2 * n > len(grams))


def near_components(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, f"{prints[k]:016x}", least.get(find(k)), find(k)) for k, (i, _) in enumerate(rows)]


def deduped_lines(rows: list[tuple[int | None, str | None]], window: int = 2) -> list[tuple]:
    cut = [(i, text, (text or "").split("\n")) for i, text in rows]
    first: dict[tuple, tuple] = {}
    for i, text, lines in cut:
        for no in range(len(lines) - window + 1):
            key, place = tuple(lines[no : no + window]), (i is not None, i or 0, no, text)
            if key not in first or place < first[key]:
                first[key] = place
    out = []
    for i, text, lines in cut:
        gone = {no + k for no in range(len(lines) - window + 1) if first[tuple(lines[no : no + window])] != (i is not None, i or 0, no, text) for k in range(window)}
        kept = "\n".join(x for no, x in enumerate(lines) if no not in gone)
        out.append((i, len(lines), len(gone), sha(kept.encode())))
    return out


def chunked_lines_removed(texts: list[str], modulus: int, window: int, least: int) -> list[set[int]]:
    """Numbers of the lines that boundaries at lines whose rolling hash is a multiple of ``modulus`` would remove; for the figures in the README."""
    seen, out = set(), []
    for text in texts:
        lines, gone, open_, h = text.split("\n"), set(), [], [0] * window
        for no, line in enumerate(lines):
            h.append(int(hashlib.md5(line.encode()).hexdigest()[:7], 16))
            open_.append(no)
            if sum(31**k * h[-1 - k] for k in range(window)) % modulus == 0 or no == len(lines) - 1:
                key = tuple(lines[k] for k in open_)
                if len(open_) >= least and key in seen:
                    gone.update(open_)
                seen.add(key)
                open_ = []
        out.append(gone)
    return out


def language_scores(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    split = [(zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, (t or "").encode().lower().split() + [None]) for i, t in rows]
    words, pairs, context = Counter(), Counter(), defaultdict(lambda: [0, 0, 0, 0])
    for held, w in split:
        if not held:
            words.update(w)
            pairs.update(zip(["<s>"] + w[:-1], w, strict=True))
    ways = Counter(y for _, y in pairs)
    for (x, _), n in pairs.items():
        context[x][0] += n
        context[x][min(n, 3)] += 1

    def discounts(values) -> list[float]:
        n = [sum(1 for v in values if v == k) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0
        out = [0.0]
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k] / n[k - 1] if y and n[k - 1] else 0.5
            out.append(d if 0 < d < k else 0.5)
        return out

    high, low, total, v, n = discounts(pairs.values()), discounts(ways.values()), sum(ways.values()), len(words), sum(words.values())
    rest = sum(low[min(c, 3)] for c in ways.values()) / total / (v + 1) if total else 1 / (v + 1)

    def p(x, y) -> float:
        lower = max(ways[y] - low[min(ways[y], 3)], 0) / max(total, 1) + rest
        if x not in context:
            return lower
        c, k = context[x], pairs[x, y]
        return (max(k - high[min(k, 3)], 0) + sum(high[j] * c[j] for j in (1, 2, 3)) * lower) / c[0]

    return [
        (held, len(w), sum(words[x] > 0 for x in w), n, sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(x, y)) for x, y in zip(["<s>"] + w[:-1], w, strict=True)))
        for held, w in split
    ]


def quality_counts(text: str | None) -> list[int]:
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {k + j for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)]


def substring_distance(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b))
        row = new
    return min(row)
