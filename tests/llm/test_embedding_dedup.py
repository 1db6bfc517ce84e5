"""Vectors against all pairs in plain double precision, the error bound, and odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from attesta.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, node string, key int, id string, copies string, n string"


def plain(rows, threshold):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and not any(x is None or not math.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float64)
            a = a / np.abs(a).max()
            good[k] = a / math.sqrt(a @ a)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), links[k], str(c := least.get(find(k))), i is not None and i == c) for k, (i, _) in enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    vectors = [(c + rng.normal(size=24) * s).astype(np.float32) for c in centres for s in (0.0, 0.15, 0.2, 0.22, 0.25, 0.3)]
    out = [(k, v.tolist()) for k, v in enumerate(vectors)]
    out += [(900 + k, out[5][1]) for k in range(40)] + [(7, out[7][1]), (7, out[8][1]), (None, out[9][1]), (None, [1.0, 2.0, 3.0])]
    out += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [float("inf")] + [1.0] * 23), (1005, [None] + [1.0] * 23)]
    out += [(1006, [1e38] * 24), (1007, [1e-38] * 24), (1008, [-0.0] * 23 + [1.0]), (1009, [0.0] * 23 + [1.0]), (1010, [0.0] * 12 + [1.0])]
    out += [(2000 + k, (np.eye(24)[0] + np.eye(24)[1] * 0.29 * k).astype(np.float32).tolist()) for k in range(12)]  # a chain of links
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_against_all_pairs(spark, rows, block):
    df = spark.createDataFrame([(i, v, 1, "n", 1, "x", "c", "n") for i, v in rows], SCHEMA).repartition(5)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.near_vectors(df, block=block).collect())
    assert got == plain(rows, 0.95)
    assert len({g[2] for g in got}) < len(rows) / 2


def test_empty_table(spark):
    out = embedding_dedup.near_vectors(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.collect() == []


@pytest.mark.parametrize("dim", [3, 64, 1500])
def test_bound_covers_every_pair(dim):
    rng = np.random.default_rng(dim)
    units = embedding_dedup.unit_vectors(rng.normal(size=(80, dim)) ** 3)
    values, scale, rounded, rest = embedding_dedup.quantised(units)
    product = embedding_dedup.int_products(values, values)
    assert (product == values.astype(np.int64) @ values.astype(np.int64).T).all()
    near = product * scale[:, None] * scale[None, :]
    assert (np.abs(units @ units.T - near) <= rounded[:, None] * rest[None, :] + rest[:, None] + embedding_dedup.SLACK).all()
