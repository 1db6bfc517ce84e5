"""The state store ends where the ledger ends, also when the stream is stopped and started again."""

import random
from datetime import datetime

from build import NOW, claims, ev
from pyspark.sql import Row
from test_sequential_models import random_rows

from attesta.operators import ledger
from attesta.streaming.claim_state import _NAMES, HELD, ClaimStates, claim_changes


def drained(spark, schema, inbox, folder, **options):
    q = (
        claim_changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(inbox)), **options)
        .writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return [r.asDict() for r in spark.read.parquet(str(folder / "out")).collect()]


def test_promotions_equal_the_ledger_after_a_restart(spark, tmp_path):
    rule = ledger.Promotion(sources=4)
    rows = random_rows(random.Random(3), 150)
    df = claims(spark, rows)
    for low in range(0, 150, 50):
        df.where(f"seq >= {low} AND seq < {low + 50}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes = drained(spark, df.schema, tmp_path / "in", tmp_path, rule=rule)  # each part ends the stream
    want, _ = ledger.add_claims(df, NOW, rule=rule)
    want = ledger.promote_all(want, NOW, rule)
    assert want.where("promoted").isEmpty()
    first = {r.merge_key: r.status for r in df.selectExpr("fingerprint AS merge_key", "seq", "status").groupBy("merge_key").agg({"seq": "min"}).withColumnRenamed("min(seq)", "seq")
             .join(df.select("seq", "status"), "seq").collect()}
    final = dict(first)
    for c in sorted(changes, key=lambda c: c["seq"]):
        assert final[c["merge_key"]] == c["old_status"]
        final[c["merge_key"]] = c["new_status"]
    assert final == {r.merge_key: r.status for r in want.collect()}
    assert len(changes) > 5 and {c["change"] for c in changes} == {"claim_promoted"}
    last = {c["merge_key"]: c for c in sorted(changes, key=lambda c: c["seq"])}
    assert any(last[r.merge_key]["n_sources"] == r.n_sources for r in want.collect() if r.merge_key in last)


def test_claims_age_by_event_time(spark, tmp_path):
    def row(k, **more):
        return dict(subject=f"s{k}", evidence=[ev("a", authority=0.3)], **more)

    first = claims(spark, [row(0, knowledge_class="tacit", created_at=datetime(2024, 1, 1)), row(1, knowledge_class="tacit", status="rejected", created_at=datetime(2024, 1, 1))])
    later = claims(spark, [row(2, created_at=datetime(2024, 1, 12))])
    end = claims(spark, [row(3, created_at=datetime(2024, 1, 12))])
    for part in (first, later, end):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes = drained(spark, first.schema, tmp_path / "in", tmp_path, age_days=10)
    aged = [c for c in changes if c["change"] == "claim_decayed"]
    assert [(c["merge_key"].split("|")[0], c["recency"]) for c in aged] == [("s0", round(0.98**10, 4))]
    want = ledger.decay(ledger.add_claims(first, NOW)[0], "2024-01-11 00:00:00").where("subject = 's0'").collect()[0]
    assert abs(want.recency - aged[0]["recency"]) < 1e-9 and abs(want.truth_score - aged[0]["truth_score"]) < 1e-9


class Store:
    """A list and a map that count how often they are asked."""

    def __init__(self):
        self.rows, self.map, self.asked = [], {}, 0

    def getListState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        return self

    def get(self):
        self.asked += 1
        return iter(self.rows)

    def put(self, rows):
        self.asked += 1
        self.rows = rows

    def containsKey(self, key):
        self.asked += 1
        return key in self.map

    def updateValue(self, key, value):
        self.asked += 1
        self.map[key] = value


def test_the_store_is_asked_by_bucket_and_for_artifacts_of_large_claims_only():
    def row(key, seq, artifact):
        evidence = [{"artifact_id": artifact, "supports": True, "source_authority": 0.1}]
        return Row(merge_key=key, seq=seq, claim_id=f"c{seq}", status="candidate", knowledge_class="process", confidence=0.1, authority=0.1, recency=1.0, n_conflicts=0, evidence=evidence, at=None)

    store, states = Store(), ClaimStates(ledger.Promotion(), None)
    states.init(store)
    rows = [row(f"k{k % 300}", k, f"a{k % 600}") for k in range(1200)]  # each key has two artifacts, each of them twice
    out = list(states.handleInputRows((0,), iter(rows), None))
    assert store.asked == 2 and len(out) == 300 and {(r.n_claims, r.n_sources, r.new_status) for r in out} == {(2, 2, "corroborated")}
    rest = [row("k7", 2000 + k, f"b{k % (2 * HELD)}") for k in range(4 * HELD)] + [row("k7", 3000, "a7")]
    list(states.handleInputRows((0,), iter(rest), None))
    last = {r[0]: dict(zip(_NAMES, r, strict=True)) for r in store.rows}["k7"]
    assert last["held"] is None and last["n_sources"] == 2 + 2 * HELD == len(store.map) and last["n_claims"] == 4 + 4 * HELD + 1


def test_few_buckets_hold_many_claims_through_restarts(spark, tmp_path):
    df = claims(spark, random_rows(random.Random(9), 120))
    for low in range(0, 120, 40):
        df.where(f"seq >= {low} AND seq < {low + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = drained(spark, df.schema, tmp_path / "in", tmp_path / "few", buckets=3)
    want = drained(spark, df.schema, tmp_path / "in", tmp_path / "many")
    assert len(want) > 5 and sorted(map(str, got)) == sorted(map(str, want))
