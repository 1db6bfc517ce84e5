"""Text functions against plain Python, and row numbers over hot keys."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.functions.dates import parse_date
from attesta.plans.ordered import ordered_index


def one(spark, expr, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"x{i} string" for i in range(len(values))))
    return df.selectExpr(f"{expr} AS r").collect()[0][0]


def chunks_of(spark, md, n):
    return [(r["heading"], r["content"]) for r in one(spark, X.chunks("x0", n), md)]


def test_sections_and_chunks(spark):
    assert [h for h, _ in chunks_of(spark, "# A\nContent A\n# B\nText\n#### C\nx", 6000)] == ["A", "B", "C"]
    assert [h for h, _ in chunks_of(spark, "Before.\n\n# Section\nText", 6000)] == ["", "Section"]
    assert chunks_of(spark, "   \n ", 6000) == [] and chunks_of(spark, " plain ", 6000) == [("", " plain ")]
    long = "# L\n\n" + "a" * 2500 + "\n\n" + "b" * 2500
    got = chunks_of(spark, long, 3000)
    assert len(got) == 2 and {h for h, _ in got} == {"L"}


def loop_pack(content, limit):
    out, cur, n = [], [], 0
    for p in re.split(r"\n\n+", content):
        if n + len(p) + 2 > limit and cur:
            out.append("\n\n".join(cur))
            cur, n = [], 0
        cur.append(p)
        n += len(p) + 2
    return out + (["\n\n".join(cur)] if cur else [])


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_equals_loop(spark, seed):
    rng = random.Random(seed)
    texts = ["\n\n".join("w" * rng.randrange(1, 60) for _ in range(rng.randrange(1, 30))) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [list(r[0]) for r in df.selectExpr(f"{X.pack_paragraphs('t', 100)} AS r").collect()]
    assert got == [loop_pack(t, 100) for t in texts]


def test_boilerplate(spark):
    md = "Header\nFacts one.\nHeader\n Header \nPage 3 of 9\n- 4 -\n12\ntwice\ntwice\n"
    assert one(spark, X.strip_boilerplate("x0"), md) == "Facts one.\ntwice\ntwice\n"


def test_small_functions(spark):
    assert one(spark, X.slugify("x0"), "  Port Net/2! ") == "port-net2" and one(spark, X.slugify("x0"), "!!") == "unnamed"
    assert one(spark, X.pair_key("x0", "x1"), "B ", "a") == one(spark, X.pair_key("x0", "x1"), "A", "b") == "a|b"
    assert one(spark, X.fingerprint("x0", "x0", "x0"), " A\t") == "a|a|a"
    assert one(spark, X.token_overlap("x0", "x1"), "the quick brown fox", "the quick brown dog") == 0.75
    assert one(spark, X.objects_conflict("x0", "x1", 0.5), "the quick brown fox", "the quick brown dog") is False
    assert one(spark, X.objects_conflict("x0", "x1"), "100", "200") is True
    a = one(spark, X.stable_hash("x0"), "---\nlast_updated: 1\n---\nbody")
    assert a == one(spark, X.stable_hash("x0"), "---\nlast_updated: 2\nlast_projected: x\n---\nbody") != one(spark, X.stable_hash("x0"), "other")


def test_quality(spark):
    good = "# Title\n\n" + "word " * 200 + "\n- item one is here\n- item two is here\n"
    assert one(spark, X.quality_score("x0", "0"), "") == 0.0
    assert one(spark, X.quality_score("x0", "1"), good) > 0.3
    assert one(spark, X.quality_score("x0", "0"), "\x01" * 20 + " word " * 50) < 0.1
    assert one(spark, X.quality_score("x0", "0"), "a b\nc d\n" * 50) < one(spark, X.quality_score("x0", "0"), "a b c d e f g h i j " * 20)


def test_dates(spark):
    want = {
        "2024-01-02": "2024-01-02 00:00:00", "2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "2024-01-02T03:04:05+02:00": "2024-01-02 01:04:05",
        "NULL": "None", "n/a": "None", "soon": "None", "2024-13-01": "None",
    }
    assert {k: str(one(spark, parse_date("x0"), k)) for k in want} == want


def test_ordered_index_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}", rng.randrange(10**6), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v long, i long")
    got = {(r.k, r.i): r.ord for r in ordered_index(df, ["k"], [F.asc("v"), F.asc("i")]).collect()}
    want, seen = {}, {}
    for k, v, i in sorted(rows):
        seen[k] = seen.get(k, 0) + 1
        want[(k, i)] = seen[k]
    assert got == want
    whole = [r.ord for r in ordered_index(df, [], [F.asc("v"), F.asc("i")]).orderBy("v", "i").collect()]
    assert whole == list(range(1, 4001))
