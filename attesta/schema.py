"""Table schemas and fixed values of the claim model. Timestamps are TIMESTAMP_NTZ holding UTC."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values (closed domains).
SOURCE_TYPES = (
    "local_file", "slack_message", "email", "document", "meeting_transcript",
    "github_issue", "github_pr", "notion_page", "web_page", "manual",
)
STATUSES = (
    "candidate", "unverified", "corroborated", "owner_confirmed", "canonical", "superseded", "rejected",
)
INACTIVE = ("superseded", "rejected")
KNOWLEDGE_CLASSES = ("stable", "process", "tacit", "stateful")
CHANGE_TYPES = (
    "document_added", "document_modified", "document_removed",
    "claim_added", "claim_merged", "claim_modified", "claim_retracted", "claim_superseded", "claim_promoted",
    "entity_merged", "conflict_detected", "relationship_discovered", "gap_detected",
)
STRATEGIES = ("authority_wins", "recency_wins", "majority_wins", "higher_score")

# Fixed values (scores).
DECAY_PER_DAY = {"stable": 0.999, "process": 0.995, "tacit": 0.98, "stateful": 0.95}
DECAY_FALLBACK = 0.995
DECAY_WRITE_THRESHOLD = 0.001
PROMOTE_SCORE = 0.15
PROMOTE_AUTHORITY = 0.8
PROMOTE_SOURCES = 2
DEFAULT_AUTHORITY = 0.5
CORROBORATION_STEP = 0.25
NO_EVIDENCE_FACTOR = 0.1
REFUTE_FACTOR = 0.7
CONFLICT_FACTOR = 0.9
SEMANTIC_THRESHOLD = 0.92
CONFLICT_SIMILARITY = 0.8
AUTO_RESOLVE_DELTA = 0.3

EVIDENCE = T.StructType([
    T.StructField("artifact_id", T.StringType()),
    T.StructField("episode_id", T.StringType()),
    T.StructField("supports", T.BooleanType()),
    T.StructField("source_span", T.StringType()),
    T.StructField("source_artifact", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("author_role", T.StringType()),
    T.StructField("source_authority", T.DoubleType()),
    T.StructField("recorded_at", T.TimestampNTZType()),
])

# A claim as it arrives: its own evidence list is short (one entry per extraction).
CLAIM = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("claim_id", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("predicate", T.StringType()),
    T.StructField("object", T.StringType()),
    T.StructField("natural_language", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("authority", T.DoubleType()),
    T.StructField("recency", T.DoubleType()),
    T.StructField("specificity", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("knowledge_class", T.StringType()),
    T.StructField("evidence", T.ArrayType(EVIDENCE)),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("valid_from", T.TimestampNTZType()),
    T.StructField("valid_until", T.TimestampNTZType()),
    T.StructField("last_confirmed_at", T.TimestampNTZType()),
    T.StructField("group_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("superseded_by", T.StringType()),
    T.StructField("supersedes", T.StringType()),
    T.StructField("conflicts_with", T.ArrayType(T.StringType())),
])

ARTIFACT = T.StructType([
    T.StructField("artifact_id", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("source_uri", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("content_created_at", T.TimestampNTZType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("replaces_id", T.StringType()),
])

EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("change_type", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("source_uri", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("triggered_by", T.StringType()),
    T.StructField("agent", T.StringType()),
])

RESOLUTION = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("conflict_id", T.StringType()),
    T.StructField("winner_id", T.StringType()),
    T.StructField("loser_id", T.StringType()),
    T.StructField("strategy_used", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("resolved_by", T.StringType()),
    T.StructField("resolved_at", T.TimestampNTZType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("audit_trail", T.StringType()),
])

AUTHORITY = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("weight", T.DoubleType()),
])

MANIFEST = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("content_hash", T.StringType()),
])
