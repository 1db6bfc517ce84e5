"""Parts that only outside services or other programs call."""

import json

from build import NOW

from attesta.functions import render
from attesta.operators import authority, changelog, conflicts, documents, extraction
from attesta.sources import publish, snapshots
from attesta.streaming import ingest


def one(spark, expr):
    return spark.range(1).selectExpr(f"{expr} AS x").first().x


def test_addresses_and_one_liners(spark):
    assert one(spark, publish.api_base("'https://host.example:8443/group/project'")) == "https://host.example:8443/api/v4"
    assert one(spark, publish.escaped_path("'pages/a b/c.md'")) == "pages%2Fa b%2Fc.md"
    assert one(spark, render.entity_oneliner("'0123456789'", "'Jane'", "repeat('x', 200)")) == "[E:0123456] Jane: " + "x" * 80


def test_batches_are_published_once_each(spark, tmp_path):
    sent = tmp_path / "sent"
    sent.mkdir()

    class Client:
        def commit(self, message, actions):
            (sent / message.replace(" ", "_")).write_text(json.dumps(actions))
            return f"id of {message}"

    rows = spark.createDataFrame([(1, "part 1", "b.md", "create", "B"), (1, "part 1", "a.md", "update", "A"), (2, "part 2", "c.md", "delete", None)], "batch long, message string, path string, action string, content string")
    assert sorted(map(tuple, publish.publish(rows, Client).collect())) == [(1, "id of part 1", 2), (2, "id of part 2", 1)]
    assert [a["path"] for a in json.loads((sent / "part_1").read_text())] == ["a.md", "b.md"]


def test_call_counts(spark):
    calls = spark.createDataFrame([(None, 100), (None, 201), ("broken", 50)], "error string, latency_ms long")
    assert extraction.call_stats(calls).first().asDict() == {"total_jobs": 3, "succeeded": 2, "failed": 1, "total_latency_ms": 301, "avg_latency_ms": 150}
    none = extraction.call_stats(calls.where("false")).first()
    assert (none.total_jobs, none.avg_latency_ms) == (0, 0)


def test_topics_of_a_source(spark):
    registry = spark.createDataFrame([("boss", "b", 0.9), ("boss", "a", 0.8), ("boss", authority.DEFAULT_TOPIC, 0.5), ("x", authority.DEFAULT_TOPIC, 0.1)], "source string, topic string, weight double")
    assert [(r.source, r.topics) for r in authority.topics_of(registry).collect()] == [("boss", ["a", "b"])]


def test_events_become_pending_resolutions(spark):
    events = spark.createDataFrame([("e1", "conflict_detected", '{"description": "A vs B"}'), ("e2", "claim_added", "{}"), ("e3", "conflict_detected", "not json")], "event_id string, change_type string, payload string")
    got = sorted((r.conflict_id, r.winner_id, r.strategy_used, r.rationale) for r in conflicts.resolutions_from_events(events, NOW).collect())
    assert got == [("e1", None, "manual:pending", "Conflict from event: A vs B"), ("e3", None, "manual:pending", "Conflict from event: ")]


def test_enrichment_reports_become_events(spark):
    report = spark.createDataFrame([(part, json.dumps({field: "Jane"} if field else {"x": 1})) for part, (_, field) in changelog.ENRICHMENT.items()], "part string, payload string")
    got = {(r.change_type, r.entity_id, r.agent) for r in changelog.enrichment_events(report, NOW).collect()}
    assert got == {(kind, "Jane" if field else "", "graph_population_agent") for kind, field in changelog.ENRICHMENT.values()}


def test_sources_that_are_gone_and_audit_lines(spark, tmp_path):
    state, now = (spark.createDataFrame([(x,) for x in xs], "source_uri string") for xs in (["a", "b"], ["b", "c"]))
    assert [r.source_uri for r in documents.removed_since(now, state).collect()] == ["a"]
    for k in range(2):
        snapshots.append_jsonl(spark.createDataFrame([(k,)], "k int"), str(tmp_path / "audit"))
    back = spark.read.json(str(tmp_path / "audit"))
    assert sorted(r.k for r in back.collect()) == [0, 1] and "audit_recorded_at" in back.columns


def test_files_arrive_as_a_stream_once_per_content(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    got = []
    sink = lambda batch, number: got.extend((r.title, r.body) for r in batch.collect())
    for name, text in (("a.md", "one"), ("b.md", "two")):
        (box / name).write_text(text)
        ingest.run_available(ingest.once_per_content(ingest.file_stream(spark, str(box))), sink, str(tmp_path / "cp"))
    assert sorted(got) == [("a.md", "one"), ("b.md", "two")]
    query = ingest.watch(ingest.file_stream(spark, str(box)), sink, str(tmp_path / "cp2"), "1 second")
    query.processAllAvailable()
    query.stop()
    assert sorted(got)[-1] == ("b.md", "two") and len(got) == 4
