"""Scores of a claim as Spark SQL expressions."""

from __future__ import annotations

from attesta import schema as S


def ts(value: str) -> str:
    """A point in time as SQL: text such as '2002-01-01', or an expression in parentheses."""
    return value if value.startswith("(") else f"TIMESTAMP_NTZ '{value}'"


def days_between(start: str, end: str) -> str:
    """Fractional days; an interval subtraction, so the session time zone plays no part."""
    return f"(cast(cast(cast({end} - {start} AS INTERVAL SECOND) AS DECIMAL(20, 6)) AS DOUBLE) / 86400D)"


def truth_score_from_counts(
    confidence: str, max_support_authority: str, authority: str, recency: str, n_sup: str, n_ref: str, n_conflicts: str
) -> str:
    """confidence x authority x recency x corroboration x penalties, from evidence counts."""
    corroboration = f"if({n_sup} + {n_ref} > 0, least(1D, {n_sup} * {S.CORROBORATION_STEP}D), {S.NO_EVIDENCE_FACTOR}D)"
    return (
        f"({confidence} * coalesce({max_support_authority}, {authority}) * {recency} * {corroboration}"
        f" * pow({S.REFUTE_FACTOR}D, {n_ref}) * pow({S.CONFLICT_FACTOR}D, {n_conflicts}))"
    )


LEDGER_SCORE = truth_score_from_counts(
    "confidence", "max_authority", "authority", "recency", "n_supporting", "n_refuting", "n_conflicts"
)


def evidence_counts(evidence: str = "evidence") -> dict[str, str]:
    """Counts over a claim's own evidence array."""
    sup = f"filter({evidence}, e -> e.supports)"
    return {
        "n_supporting": f"cast(size({sup}) AS BIGINT)",
        "n_refuting": f"cast(size(filter({evidence}, e -> NOT e.supports)) AS BIGINT)",
        "max_authority": f"array_max(transform({sup}, e -> e.source_authority))",
        "n_sources": f"cast(size(array_distinct(transform({sup}, e -> e.artifact_id))) AS BIGINT)",
    }


def truth_score(evidence: str, confidence: str, authority: str, recency: str, conflicts: str) -> str:
    """The same score over nested evidence and conflict arrays."""
    c = evidence_counts(evidence)
    return truth_score_from_counts(
        confidence, c["max_authority"], authority, recency, c["n_supporting"], c["n_refuting"], f"size({conflicts})"
    )


def decay_rate(knowledge_class: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {rate}D" for name, rate in S.DECAY_PER_DAY.items())
    return f"CASE {knowledge_class} {cases} ELSE {S.DECAY_FALLBACK}D END"


def clamp01(x: str) -> str:
    return f"greatest(0D, least(1D, {x}))"


def cosine(a: str, b: str) -> str:
    """Cosine similarity; 0 for empty, unequal or zero vectors."""
    dot = f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS DOUBLE) * y), 0D, (s, x) -> s + x)"

    def length(v: str) -> str:
        return f"sqrt(aggregate(transform({v}, x -> cast(x AS DOUBLE) * x), 0D, (s, x) -> s + x))"

    return f"if(size({a}) > 0 AND size({a}) = size({b}), coalesce(try_divide({dot}, {length(a)} * {length(b)}), 0D), 0D)"
