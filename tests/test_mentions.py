"""Mentions against a plain double loop, and names behind one common beginning."""

import random
import time

from attesta.operators import search


def table(spark, rows):
    return spark.createDataFrame(rows, "subject string, object string")


def plain(rows):
    out = set()
    for name in {s for s, _ in rows if s}:
        for subject, obj in rows:
            if subject is not None and obj is not None and subject != name and name.lower() in obj.lower():
                out |= {(subject, name), (name, subject)}
    return out


def test_mentions_equal_a_double_loop(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("aAbé ") for _ in range(rng.choice([1, 2, 3, 5, 9, 17, 40]))) for _ in range(120)] + ["", "a", "Ab"]
    rows = [(rng.choice(names), rng.choice(["", None, "x" * 50, "ab"] + [rng.choice(names) + rng.choice(names) for _ in range(9)])) for _ in range(300)]
    got = [tuple(r) for r in search.mentions(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows) and len(got) > 100
    assert search.mentions(table(spark, [])).collect() == [] and search.mentions(table(spark, [(None, None), ("a", "b")])).collect() == []


def test_names_behind_one_beginning(spark):
    start = "https://www.example.org/a/very/long/common/beginning/of/all/pages/"
    rows = [(f"{start}{k * 7919 % 99991:05d}", f"see {start}{(k + 1) % 3000 * 7919 % 99991:05d} for more") for k in range(3000)]
    df = table(spark, rows).repartition(4).cache()
    df.count()
    search.mentions(df).count()
    began = time.monotonic()
    got = {tuple(r) for r in search.mentions(df).collect()}
    took = time.monotonic() - began
    assert got == {p for s, o in rows for p in ((s, o[4:-9]), (o[4:-9], s))}
    assert took < 30, took
    print("seconds", took)


def test_pieces_that_no_name_has_are_dropped_before_any_shuffle(spark, monkeypatch):
    written = []
    cut = search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda df: (written.append((df, cut(df))), written[-1][1])[1])
    rng = random.Random(5)
    rows = [(f"name {k:04d}", "".join(rng.choices("bcdfghjklmpqrstvwxz", k=400)) + f" name {(k + 1) % 200:04d}") for k in range(200)]
    assert {tuple(r) for r in search.mentions(table(spark, rows)).collect()} == plain(rows)
    plan, held = next((df._jdf.queryExecution().optimizedPlan().toString(), out) for df, out in written if df.columns == ["obj_id", "piece"])
    assert "Join" not in plan  # else all pieces meet the names' in a shuffle
    assert held.count() < 5 * len(rows)


def test_long_texts_and_characters_of_many_bytes(spark, monkeypatch):
    rows = [("Öäé漢字", "x" * search.STEP + "öÄÉ漢字"), ("b", "öäé漢"), ("😀", "a😀b"), ("字", None)]
    assert {tuple(r) for r in search.mentions(table(spark, rows)).collect()} == plain(rows)
    monkeypatch.setattr(search, "STEP", 20)
    texts = [bytes(random.Random(k).choices(b"abc", k=n)) for k, n in enumerate((0, 1, 19, 20, 21, 36, 90))]
    for p in search.PIECES:
        got = set()
        for rows, parts in search._segments(texts):
            assert max(map(len, parts)) < 20 + 16
            got |= {(rows[r], h) for _, row, hashes in search._hashes(parts, {p}) for r, h in zip(row.tolist(), hashes.tolist(), strict=True)}
        assert len(got) == len({(k, t[i : i + p]) for k, t in enumerate(texts) for i in range(len(t) - p + 1)})
