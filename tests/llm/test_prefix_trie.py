"""The trie of conversations against a plain version, contraction of deep and wide trees, digests over several pieces."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from attesta.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, name string, digest string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [(r, x) for *_, r, x in sorted(t)] for c, t in own.items()}
    members = defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        whole = turns.get(c - c % 20, [])[:h] + turns[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, len(whole)))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c, n in m if n == len(node))))
        up = min(members[node[:-1]])[0] if node else None
        out.append((min(m)[0], len(node), up, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = ["a b", "a  b", "", None, "one two three", "\t\n", "x" * 20_000]
    out = []
    for c in [*range(0, 130), 400, 401, 1 << 40]:
        for turn in range(rng.choice([0, 1, 2, 2, 3, 5, 9])):
            out.append((c, rng.choice([turn, turn, turn, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    out += [(60, k, "user", "same") for k in range(400)] + [(c, k, "user", "copy") for c in range(500, 560) for k in range(6)]  # long, and copies
    return out + [(None, 1, "user", "nobody"), (3, 1, "user", "again"), (3, 1, "user", "again")]


def test_against_plain_trie(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*r, "n", 1, "x", "d") for r in rows], SCHEMA).repartition(6)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    got = sorted(map(tuple, prefix_trie.conversation_trie(df).collect()), key=str)
    assert got == plain(rows)
    assert max(g[1] for g in got) > 390


def test_empty_tables(spark):
    for data in ([], [(None, 1, "user", "nobody", "n", 1, "x", "d")]):
        assert prefix_trie.conversation_trie(spark.createDataFrame(data, SCHEMA)).collect() == []


def test_contraction_of_chains_stars_and_random_trees(spark):
    rng = random.Random(9)
    edges = [(0, None)] + [(k, k - 1) for k in range(1, 300)] + [(k, 150) for k in range(300, 400)] + [(k, rng.randrange(k)) for k in range(400, 700)]
    value = {k: rng.randrange(1000) for k, _ in edges}
    total = dict(value)
    for k, up in sorted(edges, reverse=True):
        if up is not None:
            total[up] += total[k]
    name = lambda k: None if k is None else bytearray(str(k).encode())
    df = spark.createDataFrame([(name(k), name(up), value[k]) for k, up in edges], "node binary, parent binary, v long")
    got = {int(bytes(r.node)): r.v for r in prefix_trie.subtree_totals(df, ["v"]).collect()}
    assert got == total


def test_digest_pieces():
    import pyarrow as pa

    ids = list(range(20))
    batches = [pa.RecordBatch.from_arrays([pa.array([b"n"] * 10 + [b"m"] * 2, pa.binary()), pa.array(ids[:10] + [5, 6])], ["node", "conv"])]
    prefix_trie.PIECE, was = 3, prefix_trie.PIECE
    pieces = [r for b in prefix_trie._joining(iter(batches)) for r in b.to_pylist()]
    prefix_trie.PIECE = was
    assert [p["ids"] for p in pieces] == ["0,1,2", "3,4,5", "6,7,8", "9", "5,6"] and [p["first"] for p in pieces] == [0, 3, 6, 9, 5]
