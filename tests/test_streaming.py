"""Claims that arrive as a stream end in the same ledger as a batch."""

from build import NOW, claims, ev

from attesta.operators import ledger
from attesta.sources.snapshots import Snapshots
from attesta.streaming import ingest


def test_stream_keeps_the_ledger(spark, tmp_path):
    df = claims(spark, [dict(object=f"o{i % 3}", confidence=0.1 * (i % 9), evidence=[ev(f"a{i % 5}")]) for i in range(12)])
    inbox = str(tmp_path / "in")
    store = Snapshots(spark, str(tmp_path / "store"))
    sink = ingest.ledger_sink(spark, store, NOW)
    for part in ("seq < 6", "seq >= 6"):
        df.where(part).write.mode("append").parquet(inbox)
        ingest.run_available(spark.readStream.schema(df.schema).parquet(inbox), sink, str(tmp_path / "cp"))
    want, _ = ledger.add_claims(df, NOW)
    cols = ["object", "n_supporting", "n_sources", "status", "confidence"]
    assert sorted(map(tuple, store.read("claims").select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    before = store.versions("claims")
    sink(df.where("seq < 6"), 0)  # delivered again
    assert store.versions("claims") == before
