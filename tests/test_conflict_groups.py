"""Conflicts of stored groups: what an ingest reads, and resolution in one pass for a subject with many values."""

import pytest
from build import NOW, claims, ev

from attesta.api import Brain
from attesta.config import Settings
from attesta.operators import conflicts, ledger
from attesta.sources.snapshots import Snapshots


def test_only_groups_with_new_claims_are_read(spark, tmp_path, monkeypatch):
    b = Brain(spark, str(tmp_path), Settings(llm_rate_limit_rpm=10**6))
    b.add_text("many", " ".join(f"Name{k} owns the thing{k}." for k in range(40)), "", NOW)
    assert b.resolve_conflicts(NOW)["total"] == 0
    b.add_text("one", "Name7 owns the other box.", "", NOW)
    seen = {}
    plain = conflicts.detect_within

    def spy(df, *more):
        seen["subjects"] = {r.subject for r in df.collect()}
        return plain(df, *more)

    monkeypatch.setattr(conflicts, "detect_within", spy)
    assert b.resolve_conflicts(NOW)["total"] == 1 and seen["subjects"] == {"Name7"}
    seen.clear()
    assert b.resolve_conflicts(NOW)["total"] == 0 and not seen
    # a claim that was put aside and comes back is looked at again
    claim = b.claims(limit=None).where("subject = 'Name9'").first().claim_id
    b.set_status(claim, "rejected", NOW)
    b.set_status(claim, "candidate", NOW)
    b.add_text("two", "Name9 owns the other box.", "", NOW)
    assert b.resolve_conflicts(NOW)["total"] == 1 and seen["subjects"] == {"Name9"}


@pytest.mark.parametrize("n", [300])
def test_a_subject_with_many_values_ends_in_one_pass(spark, n, monkeypatch):
    rows = [dict(object=f"v{k}", confidence=0.2 + 0.7 * (k * 37 % 101) / 101, evidence=[ev(f"a{k}", authority=0.9)]) for k in range(n)]
    led, _ = ledger.add_claims(claims(spark, rows), NOW)
    pairs = conflicts.detect_within(led)
    calls = []
    monkeypatch.setattr(conflicts, "cut_lineage", lambda df, plain=conflicts.cut_lineage: calls.append(1) or plain(df))
    got = {(r.a_seq, r.b_seq): (r.auto, r.winner_id) for r in conflicts.resolve_in_order(pairs, NOW, "higher_score", 0.05).collect()}
    assert len(got) == n * (n - 1) // 2 and len(calls) == 1
    state = {r.seq: (r.claim_id, r.truth_score, 0) for r in led.collect()}
    for a, b in sorted(got):
        (a_id, x, m), (b_id, y, k) = state[a], state[b]
        now = x * 0.9**m, y * 0.9**k
        auto = abs(now[0] - now[1]) >= 0.05
        assert got[a, b] == (auto, (a_id if now[0] >= now[1] else b_id) if auto else None)
        if auto:
            state[a], state[b] = (a_id, x, m + 1), (b_id, y, k + 1)


def test_groups_survive_another_commit(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "tables"))
    assert Brain(spark, str(tmp_path)).resolve_conflicts(NOW) == {"total": 0, "auto": 0, "pending": 0} and store.commits() == []
