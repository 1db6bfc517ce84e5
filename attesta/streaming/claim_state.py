"""Claims that arrive as a stream, with the running state of every merged claim in the state store; promotions and ageing come out as rows.

State of a merge key: one row with counts, best authority, score parts and status, and the artifacts that were counted. Asking the store costs far more than folding a row, so merge
keys share buckets by hash, and a bucket's rows are read and written together: how often the store is asked does not grow beyond the number of buckets. A claim with more than ``HELD``
artifacts has them in a map, which stays in the store and is asked for single artifacts, so a claim that most artifacts support costs a task no more state in memory than others. Rows of a
key are folded in ``seq`` order within a batch and batch after batch, by the rules of ``ledger.merge``: the status after the last row is that of the ledger over the same rows. Nothing but
the checkpoint is needed to go on after a restart; the number of buckets belongs to it.

With ``age_days`` each claim ages that many days of event time after its last change: recency falls by the rate of its class, and the
claim is scored with it from then on, as ``ledger.decay`` does. The timer of a bucket is that of its next claim.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from attesta import schema as S
from attesta.operators.ledger import Promotion

CHANGES = (
    "merge_key string, claim_id string, seq long, change string, old_status string, new_status string, n_claims long, n_sources long, n_supporting long, n_refuting long, "
    "recency double, truth_score double"
)
_STATE = (
    "merge_key string, claim_id string, status string, knowledge_class string, confidence double, authority double, recency double, best double, n_claims long, n_sources long, "
    "n_supporting long, n_refuting long, n_conflicts long, clock_ms long, due_ms long, held array<string>"
)
_NAMES = [c.split()[0] for c in _STATE.split(", ")]
DAY_MS = 86_400_000
HELD = 32         # artifacts that a claim's own row holds; with more they are in the map
BUCKETS = 65_536  # buckets of merge keys
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def score(s: dict) -> float:
    """The truth score of a state, as ``score.truth_score_from_counts`` has it."""
    corroboration = min(1.0, s["n_supporting"] * S.CORROBORATION_STEP) if s["n_supporting"] + s["n_refuting"] else S.NO_EVIDENCE_FACTOR
    trust = s["authority"] if s["best"] is None else s["best"]
    return s["confidence"] * trust * s["recency"] * corroboration * S.REFUTE_FACTOR ** s["n_refuting"] * S.CONFLICT_FACTOR ** s["n_conflicts"]


def promoted(s: dict, rule: Promotion) -> str:
    """The status after one look at the ladder."""
    if s["status"] in ("candidate", "unverified") and s["n_sources"] >= rule.sources:
        return "corroborated"
    if s["status"] == "candidate" and ((s["best"] or 0.0) >= rule.authority or score(s) >= rule.score):
        return "unverified"
    return s["status"]


class ClaimStates(StatefulProcessor):
    """Folds the claims of a bucket of merge keys into their states; emits a row for every change of status (and of recency)."""

    def __init__(self, rule: Promotion, age_days: float | None) -> None:
        self.rule, self.age_ms = rule, None if age_days is None else int(age_days * DAY_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claims = handle.getListState("claims", _STATE)
        self.artifacts = handle.getMapState("artifacts", "merge_key string, artifact_id string", "seen boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        states = self._states()
        for r in sorted(rows, key=lambda r: (r.seq, r.claim_id or "")):
            evidence = r.evidence or []
            s = states.get(r.merge_key)
            if s is None:
                supporting = [e for e in evidence if e["supports"]]
                s = states[r.merge_key] = {
                    "merge_key": r.merge_key, "claim_id": r.claim_id, "status": r.status, "knowledge_class": r.knowledge_class, "confidence": r.confidence, "authority": r.authority, "recency": r.recency,
                    "best": max((e["source_authority"] for e in supporting if e["source_authority"] is not None), default=None), "n_claims": 0, "n_sources": len({e["artifact_id"] for e in supporting}),
                    "n_supporting": len(supporting), "n_refuting": len(evidence) - len(supporting), "n_conflicts": r.n_conflicts or 0, "clock_ms": 0, "due_ms": None, "held": [],
                }
                for e in evidence:
                    self._is_new(s, e["artifact_id"])
            else:
                for e in evidence:
                    if self._is_new(s, e["artifact_id"]):
                        s["n_supporting" if e["supports"] else "n_refuting"] += 1
                        if e["supports"]:
                            s["n_sources"] += 1
                            s["best"] = max((x for x in (s["best"], e["source_authority"]) if x is not None), default=None)
                s["confidence"] = max(s["confidence"], r.confidence)
            s["n_claims"] += 1
            s["clock_ms"] = max(s["clock_ms"], int(r.at.replace(tzinfo=timezone.utc).timestamp() * 1000) if r.at else 0)
            s["due_ms"] = None if self.age_ms is None else s["clock_ms"] + self.age_ms
            new = promoted(s, self.rule)
            if new != s["status"]:
                old, s["status"] = s["status"], new
                yield self._row(s["merge_key"], r.seq, "claim_promoted", old, s)
        self._keep(states)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        states = self._states()
        for s in states.values():
            at = s["due_ms"]
            if at is None or at > now:
                continue
            if s["status"] in S.INACTIVE:
                s["due_ms"] = None
                continue
            fresh = S.DECAY_PER_DAY.get(s["knowledge_class"], S.DECAY_FALLBACK) ** ((at - s["clock_ms"]) / DAY_MS)
            if abs(fresh - s["recency"]) > S.DECAY_WRITE_THRESHOLD:
                s["recency"] = round(fresh, 4)
                yield self._row(s["merge_key"], None, "claim_decayed", s["status"], s)
            s["due_ms"] = at + self.age_ms
        self._keep(states)

    def _states(self) -> dict:
        """The states of this bucket by merge key."""
        rows = (dict(zip(_NAMES, t, strict=True)) for t in self.claims.get())
        return {s["merge_key"]: {**s, "held": None if s["held"] is None else list(s["held"])} for s in rows}

    def _is_new(self, s: dict, artifact: str | None) -> bool:
        """Whether an artifact was not yet counted for this claim; it is from now on."""
        held = s["held"]
        if held is not None:
            if artifact in held:
                return False
            held.append(artifact)
            if len(held) > HELD:
                for a in held:
                    self.artifacts.updateValue((s["merge_key"], a), (True,))
                s["held"] = None
            return True
        if self.artifacts.containsKey((s["merge_key"], artifact)):
            return False
        self.artifacts.updateValue((s["merge_key"], artifact), (True,))
        return True

    def _keep(self, states: dict) -> None:
        self.claims.put([tuple(s[c] for c in _NAMES) for s in states.values()])
        if self.age_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            due = min((s["due_ms"] for s in states.values() if s["due_ms"] is not None), default=None)
            if due is not None:
                self.handle.registerTimer(due)

    @staticmethod
    def _row(key: str, seq: int | None, change: str, old: str, s: dict) -> Row:
        return Row(
            merge_key=key, claim_id=s["claim_id"], seq=seq, change=change, old_status=old, new_status=s["status"], n_claims=s["n_claims"], n_sources=s["n_sources"],
            n_supporting=s["n_supporting"], n_refuting=s["n_refuting"], recency=s["recency"], truth_score=score(s),
        )


def claim_changes(claims: DataFrame, rule: Promotion = Promotion(), merge_key: str = "fingerprint", age_days: float | None = None, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Changes (``claim_promoted``, ``claim_decayed``) of the merged claims of a stream of claims with nested evidence.

    A claim without a merge key, or with a null seq, is its own kind of key or the first of its batch; a null list of evidence is an empty one. ``created_at`` is the event time of
    ageing: rows later than ``delay`` are still counted, as no state is dropped. ``buckets`` must stay what it was in the stream's first run.
    """
    conf = claims.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    narrow = claims.selectExpr(
        f"{merge_key} AS merge_key", f"pmod(xxhash64({merge_key}), {buckets}) AS bucket", "coalesce(seq, cast(-9223372036854775808 AS BIGINT)) AS seq", "claim_id", "status", "knowledge_class", "confidence", "authority", "recency", "n_conflicts",
        "transform(evidence, e -> struct(e.artifact_id, coalesce(e.supports, false) AS supports, e.source_authority)) AS evidence", "created_at AS at", *([] if age_days is None else ["cast(created_at AS TIMESTAMP) AS event_time"]),
    )
    if age_days is not None:
        narrow = narrow.withWatermark("event_time", delay)
    mode = "none" if age_days is None else "eventTime"
    return narrow.groupBy("bucket").transformWithState(ClaimStates(rule, age_days), CHANGES, "append", mode)
