"""Leader clustering compares most claims with leaders only, and takes a bounded rest in order."""

import random

from attesta.operators import semantic


def test_pairs_follow_the_number_of_leaders(spark, monkeypatch):
    monkeypatch.setattr(semantic, "BLOCK", 10)
    rnd = random.Random(3)
    rows = [(str(i), i, f"t{i}", [1.0 * (i % 3 == k) + rnd.uniform(-0.05, 0.05) for k in range(3)]) for i in range(90)]
    pairs, plain = [], semantic.matches

    def counted(new, existing, *args, **named):
        pairs.append(new.count() * existing.count())
        return plain(new, existing, *args, **named)

    monkeypatch.setattr(semantic, "matches", counted)
    df = spark.createDataFrame(rows, "id string, seq long, fingerprint string, embedding array<double>")
    assert sorted(r.seq for r in semantic.leaders(df, 0.9).collect()) == [0, 1, 2]
    assert sum(pairs) < 90 * 10
