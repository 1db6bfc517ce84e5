"""JSON array files cut into small ranges, and round trips of ledger, change log and resolutions."""

import json
import random

import pytest

from attesta import schema as S
from attesta.sources import files, json_arrays


def text_of(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", " ", "\n", "é", "x", "\\\""]) for _ in range(rng.randrange(12)))
    if kind == 2:
        return rng.choice([1, -2.5, True, None])
    if kind == 3:
        return {}
    if kind == 4:
        return [text_of(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{k}\"\\{k}": text_of(rng, depth + 1) for k in range(rng.randrange(4))}


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_elements_of_any_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [{"n": k, "v": text_of(rng)} for k in range(8 if size == 1 else 60)]
    (tmp_path / "compact.json").write_text(json.dumps(rows, ensure_ascii=False, separators=(",", ":")))
    (tmp_path / "pretty.json").write_text("﻿" + json.dumps(rows, indent=2))
    (tmp_path / "lines.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "other.json").write_text('[1, "a b, c", [2, {"x": 3}], {"y": "}"}, null]')
    (tmp_path / "none.json").write_text(" [ ] ")
    (tmp_path / "empty.json").write_text("")
    got = {}
    for r in json_arrays.json_objects(spark, str(tmp_path), size).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.at, json.loads(r.object)))
    for name in ("compact.json", "pretty.json", "lines.json"):
        assert [x for _, x in sorted(got[name], key=lambda p: p[0])] == rows
    assert [x for _, x in sorted(got["other.json"], key=lambda p: p[0])] == [1, "a b, c", [2, {"x": 3}], {"y": "}"}, None]
    assert set(got) == {"compact.json", "pretty.json", "lines.json", "other.json"}


def test_bad_elements_are_counted(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": "many"}, 7, {"x": 2}, {"x": 3')
    table = files.json_table(spark, str(tmp_path / "a.json"), spark.createDataFrame([], "x int").schema)
    assert sorted(r.x for r in table.where("_corrupt_record IS NULL").collect()) == [1, 2] and files.unreadable(table) == 3


def test_ledger_of_two_files_round_trip(spark, tmp_path):
    claims = spark.range(10_000).selectExpr(
        "id AS seq", "concat('c', id) AS claim_id", "concat('s \"', id, '\\\\') AS subject", "'is' AS predicate", "repeat('[{,', cast(id % 5 AS INT)) AS object", "'text' AS natural_language",
        "id / 10000D AS confidence", "0.5D AS authority", "1D AS recency", "0.5D AS specificity", "'candidate' AS status", "'process' AS knowledge_class",
        "array(named_struct('artifact_id', concat('a', id), 'episode_id', cast(null AS STRING), 'supports', true, 'source_span', 'line\\nline', 'source_artifact', 'f', 'author', 'x', 'author_role', '', 'source_authority', 0.5D, "
        "'recorded_at', TIMESTAMP_NTZ '2024-05-01 10:00:00.123456')) AS evidence", "TIMESTAMP_NTZ '2024-05-01 10:00:00' AS created_at", "cast(null AS TIMESTAMP_NTZ) AS valid_from",
        "cast(null AS TIMESTAMP_NTZ) AS valid_until", "cast(null AS TIMESTAMP_NTZ) AS last_confirmed_at", "cast(null AS STRING) AS group_id", "array(0.1D, id / 3D) AS embedding",
        "cast(null AS STRING) AS superseded_by", "cast(null AS STRING) AS supersedes", "array('c1') AS conflicts_with",
    ).select(*S.CLAIM.names)
    files.claims_to_json(claims.where("seq < 6000"), str(tmp_path / "ledger" / "a"))
    files.claims_to_json(claims.where("seq >= 6000"), str(tmp_path / "ledger" / "b"))
    assert sum(len(json.loads(p.read_text() or "[]")) for p in tmp_path.glob("ledger/*/part-*")) == 10_000  # whole arrays
    back = files.claims_from_json(spark, str(tmp_path / "ledger"))
    assert back.drop("seq").exceptAll(claims.drop("seq")).isEmpty() and back.count() == 10_000
    assert [r.claim_id for r in back.orderBy("seq").limit(200).collect()] == [f"c{k}" for k in range(200)]


def test_log_and_resolutions_round_trip(spark, tmp_path):
    events = spark.range(50).selectExpr(
        "concat('e', id) AS event_id", "id AS seq", "'claim_added' AS change_type", "TIMESTAMP_NTZ '2024-05-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "'x' AS entity_id",
        "'u' AS source_uri", "to_json(named_struct('a', id)) AS payload", "cast(null AS STRING) AS triggered_by", "'' AS agent",
    )
    files.events_to_json(events, str(tmp_path / "log"))
    assert files.events_from_json(spark, str(tmp_path / "log")).drop("seq").exceptAll(events.drop("seq")).isEmpty()
    assert [r.event_id for r in files.events_from_json(spark, str(tmp_path / "log")).orderBy("seq").collect()] == [f"e{k}" for k in range(50)]
    (tmp_path / "own.json").write_text('[{"id": "e1", "timestamp": "2024-05-01T12:00:00+02:00", "change_type": "claim_added", "payload": {"a": [1, 2]}}]')
    row = files.events_from_json(spark, str(tmp_path / "own.json")).collect()[0]
    assert (row.event_id, str(row.ts), json.loads(row.payload)) == ("e1", "2024-05-01 10:00:00", {"a": [1, 2]})
    res = spark.createDataFrame([(k, f"c{k}", "w", None, "auto:authority_wins", 0.5, "auto", None, 'says "no"', None) for k in range(20)], S.RESOLUTION)
    files.resolutions_to_json(res, str(tmp_path / "res"))
    back = files.resolutions_from_json(spark, str(tmp_path / "res"))
    assert back.drop("seq").exceptAll(res.drop("seq")).isEmpty() and back.count() == 20
