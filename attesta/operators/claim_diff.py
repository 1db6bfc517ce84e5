"""Differences between two extractions of the same sources."""

from __future__ import annotations

from pyspark.sql import DataFrame

from attesta.functions import render as R
from attesta.functions import text as X
from attesta.plans.sqlrun import run_sql

FIELDS = ["claim_id", "subject", "predicate", "object", "natural_language", "confidence", "knowledge_class"]


def claim_diff(old: DataFrame, new: DataFrame, confidence_step: float = 0.05) -> DataFrame:
    """Per fingerprint: added, removed, modified or unchanged, with the changed fields.

    Of equal fingerprints within one side the last one (by ``seq``) counts. Both sides meet in one aggregation, so a
    heavily repeated claim is reduced before the shuffle.
    """
    packed = f"struct({', '.join(FIELDS)})"
    tests = [
        *[f"if({X.norm(f'o.{f}')} <> {X.norm(f'n.{f}')}, '{f}', null)" for f in ("subject", "predicate", "object")],
        "if(o.natural_language <> n.natural_language, 'natural_language', null)",
        f"if(abs(o.confidence - n.confidence) > {confidence_step}D, 'confidence', null)",
        "if(o.knowledge_class <> n.knowledge_class, 'knowledge_class', null)",
    ]
    return run_sql(
        f"""
        WITH sides AS (
          SELECT fingerprint, seq, true AS is_old, {packed} AS c FROM @old UNION ALL SELECT fingerprint, seq, false, {packed} FROM @new),
        last_of AS (
          SELECT fingerprint, max_by(c, seq) FILTER (WHERE is_old) AS o, max_by(c, seq) FILTER (WHERE NOT is_old) AS n
          FROM sides GROUP BY fingerprint),
        compared AS (SELECT *, if(o IS NULL OR n IS NULL, array(), array_compact(array({', '.join(tests)}))) AS changed_fields FROM last_of)
        SELECT fingerprint, o.claim_id AS old_id, n.claim_id AS new_id, changed_fields,
          CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' WHEN size(changed_fields) > 0 THEN 'modified' ELSE 'unchanged' END AS change,
          arrays_overlap(changed_fields, array('subject', 'predicate', 'object')) AS is_substantive
        FROM compared
        """,
        old=old, new=new,
    )


def affected_subjects(diff: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Subjects (subject, n) whose pages a diff touches: those of added, removed and modified claims, in their new form if there is one."""
    return run_sql(
        """
        SELECT subject, count(*) AS n FROM (SELECT coalesce(new_id, old_id) AS claim_id FROM @d WHERE change <> 'unchanged') d
        JOIN (SELECT claim_id, subject FROM @old UNION SELECT claim_id, subject FROM @new) c ON d.claim_id = c.claim_id GROUP BY subject
        """,
        d=diff, old=old, new=new,
    )


DIFF_SUMMARY = R.counted([("+", "n_added", " new"), ("-", "n_removed", " removed"), ("~", "n_modified", " modified")], "no changes")


def diff_summary(diff: DataFrame) -> DataFrame:
    return run_sql(
        f"""
        SELECT *, n_added + n_removed + n_modified > 0 AS has_changes, {DIFF_SUMMARY} AS summary FROM (
          SELECT count_if(change = 'added') AS n_added, count_if(change = 'removed') AS n_removed,
            count_if(change = 'modified') AS n_modified, count_if(change = 'unchanged') AS n_unchanged FROM @d)
        """,
        d=diff,
    )
