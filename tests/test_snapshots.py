"""Commits over several tables, buckets, crashes between writes, and what an update rewrites."""

import pytest
from build import NOW, claims, ev

from attesta.operators import ledger
from attesta.sources import ledger_store
from attesta.sources.snapshots import CommitConflict, Snapshots


def table(spark, rows):
    return spark.createDataFrame(rows, "k int, v string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tables_are_published_together_or_not_at_all(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    with s.transaction() as tx:
        tx.write("a", table(spark, [(1, "x")]))
        tx.write("b", table(spark, [(1, "x")]), "k")
    with pytest.raises(RuntimeError, match="lost"), s.transaction() as tx:
        tx.write("a", table(spark, [(2, "y")]))
        raise RuntimeError("lost between the two writes")
    assert rows(s.read("a")) == rows(s.read("b")) == [(1, "x")] and s.versions("a") == [1]
    first, second = s.transaction(), s.transaction()
    with pytest.raises(CommitConflict), first as one:
        one.write("a", table(spark, [(3, "z")]))
        with second as two:
            two.write("a", table(spark, [(4, "w")]))
    assert rows(s.read("a")) == [(4, "w")]
    assert s.vacuum(keep=1) >= 2 and rows(s.read("a")) == [(4, "w")] and rows(s.read("b")) == [(1, "x")]


def test_an_update_writes_only_its_buckets(spark, tmp_path):
    s = Snapshots(spark, f"file:{tmp_path}", buckets=16)
    s.write("t", table(spark, [(k, "old") for k in range(200)]), "k")
    before = s.manifest()["tables"]["t"]["parts"]
    s.upsert("t", table(spark, [(7, "new")]), ["k"])
    after = s.manifest()["tables"]["t"]["parts"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert rows(s.read("t")) == sorted([(k, "new" if k == 7 else "old") for k in range(200)])
    s.delete("t", spark.createDataFrame([(7,), (8,)], "k int"))
    assert s.read("t").count() == 198 and s.read("t", 1).where("v = 'old'").count() == 200
    assert s.versions("t") == [1, 2, 3]
    again = Snapshots(spark, str(tmp_path), buckets=5)  # the number of the first commit stays
    again.upsert("t", table(spark, [(9, "nine")]), ["k"])
    assert again.buckets == 16 and again.read("t").where("k = 9").collect()[0].v == "nine" and again.read("t").count() == 198
    s.delete("t", spark.createDataFrame([(k,) for k in range(200)], "k int"))
    assert rows(s.read("t")) == [] and s.read("t").columns == ["k", "v"]


def test_appended_parts_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("attesta.sources.snapshots.MOST_PARTS", 3)
    s = Snapshots(spark, str(tmp_path))
    for k in range(9):
        s.append("log", table(spark, [(k, None)]))
    assert rows(s.read("log")) == [(k, None) for k in range(9)] and len(s.manifest()["tables"]["log"]["parts"]) <= 4
    with pytest.raises(ValueError):
        s.write("t", table(spark, []), "k")
        s.append("t", table(spark, []))


def test_the_stored_ledger_equals_one_merge(spark, tmp_path):
    df = claims(spark, [dict(subject=f"s{i % 7}", object=f"o{i % 3}", confidence=0.1 * (i % 9), evidence=[ev(f"a{i % 5}")]) for i in range(60)])
    s = Snapshots(spark, str(tmp_path), buckets=8)
    for low, high in ((0, 20), (20, 21), (21, 60)):
        with s.transaction() as tx:
            ledger_store.merge_in(tx, df.where(f"seq >= {low} AND seq < {high}"), NOW)
    want, evidence = ledger.add_claims(df, NOW)
    cols = ["subject", "object", "n_supporting", "n_sources", "status", "confidence", "truth_score"]
    assert rows(s.read("claims").select(*cols)) == rows(want.select(*cols)) and s.read("evidence").count() == evidence.count()
    m1, m2 = s.manifest(2)["tables"], s.manifest(1)["tables"]
    for name in ("claims", "evidence"):  # one claim arrived: one bucket of each table was written
        assert sum(m1[name]["parts"][b] != m2[name]["parts"].get(b) for b in m1[name]["parts"]) == 1
    with s.transaction() as tx:
        n = ledger_store.retract(tx, spark.createDataFrame([("a1",)], "artifact_id string"))
    plain, flipped = ledger.retract(want, evidence, spark.createDataFrame([("a1",)], "artifact_id string"))
    assert n == flipped.where("retracted").count() > 0
    assert rows(s.read("claims").select(*cols)) == rows(plain.select(*cols))
