"""The whole workflow on a small folder: ingest, re-ingest, change, conflicts, projection."""

import os

import pytest
from build import NOW

from attesta.api import Brain
from attesta.config import Settings
from attesta.operators import extraction
from attesta.sources import files
from attesta.sources.snapshots import Snapshots

DOC = "# Team\n\nJane owns the billing service. Bob uses the billing service.\n\n# Rules\n\nThe permit requires approval.\n"


@pytest.fixture(scope="module")
def brain(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("brain")
    box = root / "inbox"
    box.mkdir()
    (box / "team.md").write_text(DOC)
    (box / "page.html").write_text("<html><head><title>t</title></head><body><h1>Ports</h1><p>PortNet uses Python.</p></body></html>")
    (box / "skip.bin").write_text("x is y.")
    return Brain(spark, str(root), Settings(llm_rate_limit_rpm=100000)), box, root


def test_ingest_twice_then_change(brain):
    b, box, root = brain
    first = b.ingest(str(box), NOW)
    assert first["artifacts"] == 2 and first["claims"] == 4 and first["events"] == 2 + 4
    assert b.ingest(str(box), NOW)["artifacts"] == 0
    (box / "team.md").write_text(DOC + "\n# More\n\nJane owns the gateway.\n")
    again = b.ingest(str(box), NOW)
    assert again["artifacts"] == 1 and again["cached_chunks"] == 2
    subjects = {r.subject for r in b.claims().collect()}
    assert subjects == {"Jane", "Bob", "The permit", "PortNet"}
    assert b.claims().count() == 5  # the repeated claims were merged
    kinds = {r.change_type: r["count"] for r in b.events().groupBy("change_type").count().collect()}
    assert kinds["document_added"] == 2 and kinds["document_modified"] == 1
    assert b.search_claims("gateway").count() == 1 and b.get_entity("portnet").count() == 1


def test_project_writes_only_what_changed(brain):
    b, box, root = brain
    out = root / "pages"
    assert set(b.project(str(out), "2024-06-02 00:00:00")) == {"create"}
    page = (out / "entities" / "jane.md").read_text()
    assert page.startswith("---\nentity: Jane\nclaim_count: 2\n") and "## Source Documents" in page and "owns the billing service" in page
    assert os.path.exists(out / "index.md") and os.path.exists(out / "topics" / "permits-licensing.md")
    assert set(b.project(str(out), "2024-06-03 00:00:00")) == {"unchanged"}
    b.set_status(b.claims().where("subject = 'PortNet'").collect()[0].claim_id, "rejected", NOW)
    plan = b.project(str(out), "2024-06-04 00:00:00")
    assert plan["delete"] >= 1 and plan["update"] >= 1
    assert not (out / "entities" / "portnet.md").exists() and (out / "entities" / "jane.md").exists()


def test_conflicts_authority_and_text(brain):
    b, _, _ = brain
    b.set_authority("boss", 0.95)
    assert b.add_text("memo", "Bob uses the old gateway.", "boss", NOW)["claims"] == 1
    assert b.claims().where("object = 'the old gateway'").collect()[0].max_authority == 0.95
    found = b.detect_conflicts().collect()
    assert {(r.a_object, r.b_object) for r in found} >= {("the billing service", "the old gateway")}
    res = b.resolve_conflicts(NOW)
    assert res["total"] == len(found) and b.resolutions().count() == len(found)
    before = [sorted(map(str, df.collect())) for df in (b.claims(), b.resolutions(), b.events())]
    assert b.resolve_conflicts(NOW)["total"] == 0
    assert [sorted(map(str, df.collect())) for df in (b.claims(), b.resolutions(), b.events())] == before
    assert b.promote_all(NOW) >= 0
    b.remove_authority("boss")
    assert b.authority().count() == 0


def test_semantic_merge_at_ingest(spark, tmp_path):
    def embed(df):
        return df.selectExpr("id", "seq", "fingerprint", "if(contains(text, 'billing'), array(1D, 0D), array(0D, double(length(text)))) AS embedding")

    b = Brain(spark, str(tmp_path), Settings(llm_rate_limit_rpm=100000), embed=embed)
    b.add_text("a", "Jane owns the billing service.", "", NOW)
    b.add_text("b", "Jane owns the billing.", "", NOW)
    (r,) = b.claims().collect()
    assert r.object == "the billing service" and r.n_supporting == 2 and r.status == "corroborated"


def test_vectors_are_stored_and_only_arriving_claims_embedded(spark, tmp_path):
    seen = []

    def embed(df):
        seen.append(sorted(r.text for r in df.select("text").collect()))
        return df.selectExpr("id", "seq", "fingerprint", "if(contains(text, 'billing'), array(1D, 0D), if(contains(text, 'gateway'), array(), array(0D, 1D))) AS embedding")

    plain = Brain(spark, str(tmp_path), Settings(llm_rate_limit_rpm=100000))
    plain.add_text("a", "Jane owns the billing service.", "", NOW)
    assert tuple(plain.embedding_stats().first()) == (1, 0, 1, 0.0)
    b = Brain(spark, str(tmp_path), Settings(llm_rate_limit_rpm=100000), embed=embed)
    assert b.embed_claims() == 1 and len(seen.pop()) == 1
    assert b.embed_claims() == 0 and not seen
    b.add_text("b", "Jane owns the billing. Bob uses the gateway.", "", NOW)
    assert len(seen) == 1 and all("service" not in t for t in seen[0])
    claims = {r.object: r.n_supporting for r in b.claims().collect()}
    assert claims == {"the billing service": 2, "the gateway": 1}
    assert tuple(b.embedding_stats().first()) == (2, 1, 1, 50.0)
    assert [r.object for r in b.unembedded().collect()] == ["the gateway"]
    with pytest.raises(ValueError):
        plain.embed_claims()


def test_settings_from_environment():
    s = Settings.load({"ATTESTA_CHUNK_SIZE": "100", "ATTESTA_ENABLE_CONFLICT_RESOLUTION": "true", "OTHER": "1"}, env_file=None)
    assert (s.chunk_size, s.enable_conflict_resolution, s.promote_threshold) == (100, True, 0.15)


def test_extractor_retries_and_errors(spark, tmp_path):
    marks = str(tmp_path)

    def flaky(prompt: str) -> str:
        path = os.path.join(marks, "tried")
        if "again" in prompt and not os.path.exists(path):
            open(path, "w").close()
            raise RuntimeError("HTTP 503")
        if "bad" in prompt:
            raise RuntimeError("no such model")
        return "{}"

    df = spark.createDataFrame([("again",), ("bad",), ("fine",)], "prompt string")
    out = {r.prompt: (r.response, r.error) for r in extraction.call_extractor(df, flaky, rate_per_minute=10**6, backoff=0.01, tasks=1).collect()}
    assert out == {"again": ("{}", None), "bad": (None, "no such model"), "fine": ("{}", None)}
    assert extraction.is_transient("Rate_Limit hit") and not extraction.is_transient("404")


def test_scan_state(spark, tmp_path):
    (tmp_path / "a.md").write_text("one")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "B.TXT").write_bytes(b"caf\xe9")
    (tmp_path / "c.exe").write_text("no")
    found, state = files.scan(spark, str(tmp_path))
    assert {r.title for r in found.collect()} == {"a.md", "sub/B.TXT"}
    rows = state.collect()
    state = spark.createDataFrame(rows, state.schema)
    assert files.scan(spark, str(tmp_path), state)[0].count() == 0
    (tmp_path / "a.md").write_text("two")
    assert [(r.title, r.change) for r in files.scan(spark, str(tmp_path), state)[0].collect()] == [("a.md", "modified")]


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    assert s.read("t") is None
    s.write("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    s.upsert("t", spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), ["k"])
    assert sorted(tuple(r) for r in s.read("t").collect()) == [(1, "a"), (2, "B"), (3, "c")]
    s.delete("t", spark.createDataFrame([(1,)], "k int"))
    assert s.read("t").count() == 2 and s.read("t", 1).count() == 2 and s.versions("t") == [1, 2, 3]


def test_calls_overlap_and_hung_calls_do_not_block(spark):
    import time

    def slow(prompt: str) -> str:
        time.sleep(4.0 if prompt == "hang" else 0.5)
        return prompt

    df = spark.createDataFrame([(f"p{k}",) for k in range(8)], "prompt string").coalesce(1)
    extraction.call_extractor(df.limit(1), slow, rate_per_minute=10**6, tasks=1).count()  # starts the Python worker
    began = time.monotonic()
    assert extraction.call_extractor(df, slow, rate_per_minute=10**6, tasks=1).where("response = prompt").count() == 8
    assert time.monotonic() - began < 3.0  # one after the other: 4 s
    hung = spark.createDataFrame([("hang",), ("a",), ("b",)], "prompt string").coalesce(1)
    out = {r.prompt: r.error for r in extraction.call_extractor(hung, slow, max_concurrent=1, rate_per_minute=10**6, retries=0, timeout=1.0, tasks=1).collect()}
    assert out == {"hang": "Timeout after 1 attempts", "a": None, "b": None}


def test_long_texts_are_read_whole(spark, tmp_path):
    b = Brain(spark, str(tmp_path))
    b.add_text("long", "Nothing to see.\n" * 3200 + "Zoe owns the last sentence.", "", NOW)
    assert b.claims().where("subject = 'Zoe' AND object = 'the last sentence'").count() == 1
    parts = extraction.prompts(spark.createDataFrame([("s", "t", "a", "f", "d", "x" * 25 + " yy\n" + "z" * 12)], "source_type string, title string, author string, source_artifact string, dated string, content string"), 10)
    bodies = [r.prompt.split("Content:\n")[1] for r in parts.orderBy("part").collect()]
    assert all(len(x) <= 10 for x in bodies) and "".join("".join(bodies).split()) == "x" * 25 + "yy" + "z" * 12


def test_copies_cause_one_call(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    box = tmp_path / "inbox"
    box.mkdir()
    for k in range(12):
        (box / f"copy{k}.md").write_text(DOC)

    def counted(prompt: str) -> str:
        import uuid

        (calls / uuid.uuid4().hex).write_text("")
        return extraction.sentence_extractor(prompt)

    b = Brain(spark, str(tmp_path / "brain"), Settings(llm_rate_limit_rpm=10**6), extract=counted)
    assert b.ingest(str(box), NOW)["claims"] == 36
    assert len(list(calls.iterdir())) == 2  # two sections


def test_ledger_files_round_trip(spark, tmp_path):
    source = tmp_path / "ledger.json"
    source.write_text("""[{"id": "c1", "subject": "A", "predicate": "is", "object": "B", "confidence": 0.6, "status": "candidate", "created_at": "2024-05-01T10:00:00Z",
      "evidence": [{"artifact_id": "x", "supports": true, "recorded_at": "2024-05-01T12:00:00+02:00"}], "conflicts_with": ["c2"]},
      {"id": "c2", "subject": "A", "confidence": "many"}]""")
    rows = files.claims_from_json(spark, str(source)).collect()
    assert [(r.claim_id, r.subject, str(r.created_at)) for r in rows] == [("c1", "A", "2024-05-01 10:00:00")]
    assert str(rows[0].evidence[0].recorded_at) == "2024-05-01 10:00:00" and rows[0].conflicts_with == ["c2"]
    plain = spark.createDataFrame([], "id string, confidence double").schema
    assert files.unreadable(files.json_table(spark, str(source), plain)) == 1
    files.claims_to_json(files.claims_from_json(spark, str(source)), str(tmp_path / "out"))
    assert files.claims_from_json(spark, str(tmp_path / "out")).collect() == rows


def test_claim_files_never_share_a_path(spark):
    from attesta.operators import pages

    long = "x" * 100
    claims = spark.createDataFrame(
        [(f"c{k}", long, "is", o, "candidate", "stable", 0.1, 0.2, 1, 0) for k, o in enumerate(("a", "b"))] + [("c9", "Short", "is", "o", "candidate", "stable", 0.1, 0.2, 1, 0)],
        "claim_id string, subject string, predicate string, object string, status string, knowledge_class string, truth_score double, confidence double, n_supporting long, n_refuting long",
    ).selectExpr("*", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS created_at", "cast(null AS TIMESTAMP_NTZ) AS last_confirmed_at", "'text' AS natural_language")
    paths = [r.path for r in pages.claim_files(claims).collect()]
    assert len(set(paths)) == 3 and "claims/stable/short-is-o.md" in paths
