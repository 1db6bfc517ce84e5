"""Answers of parsers and embedders are kept: a second run calls nobody, a new version empties a kind."""

import os

from build import NOW

from attesta.api import Brain
from attesta.config import Settings
from attesta.sources.content_cache import ContentCache
from attesta.sources.snapshots import Snapshots

TEXT = "Zoe owns the report.\n"


def test_second_run_calls_nobody(spark, tmp_path):
    marks, inbox = tmp_path / "marks", tmp_path / "inbox"
    marks.mkdir()
    inbox.mkdir()
    asked = []

    def parser(content: bytes, path: str) -> str:
        (marks / os.path.basename(path)).write_text("")
        return TEXT

    def embed(df):
        asked.extend(r.text for r in df.select("text").collect())
        return df.selectExpr("id", "seq", "fingerprint", "array(1D, 1D / 3) AS embedding")

    def brain(version):
        return Brain(spark, str(tmp_path / "brain"), Settings(llm_rate_limit_rpm=100000), embed=embed, parsers={".pdf": [parser]}, versions={"parse": version})

    (inbox / "a.pdf").write_bytes(b"%PDF one")
    first = brain("1").ingest(str(inbox), NOW)
    assert first["claims"] == 1 and os.listdir(marks) == ["a.pdf"] and len(asked) == 1
    (inbox / "b.pdf").write_bytes(b"%PDF one")  # the same bytes: no parser, no extractor, no embedder
    again = brain("1")
    counts = again.ingest(str(inbox), NOW)
    assert counts["artifacts"] == 1 and counts["claims"] == 1
    assert os.listdir(marks) == ["a.pdf"] and len(asked) == 1
    assert again.claims().first().n_supporting == 2
    assert again.cache_stats() == {"documents": 2, "extractions": 1, "parse": 1, "embed": 1}
    (inbox / "c.pdf").write_bytes(b"%PDF one")
    brain("2").ingest(str(inbox), NOW)  # another version of the parsers: they are asked again, the embedder is not
    assert sorted(os.listdir(marks)) == ["a.pdf", "c.pdf"] and len(asked) == 1


def test_entries(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), 4)
    cache = ContentCache(store, {"k": "1"})
    rows = spark.createDataFrame([("k:a", "1"), ("k:b", "2"), ("k:b", "2"), ("k:c", None)], "cache_key string, value string")
    assert cache.find("k", rows.select("cache_key"))[0].isEmpty()
    with store.transaction() as tx:
        cache.keep(tx, "k", rows)
    hits, misses = cache.find("k", rows.select("cache_key").distinct())
    assert sorted((r.cache_key, r.value) for r in hits.collect()) == [("k:a", "1"), ("k:b", "2")]
    assert [r.cache_key for r in misses.collect()] == ["k:c"]
    assert cache.invalidate(keys=rows.where("value = '1'")) == 1 and cache.counts() == {"k": 1}
    assert ContentCache(store, {"k": "2"}).find("k", rows.select("cache_key"))[0].isEmpty() and cache.counts() == {}
