"""What to write: rendered pages against the manifest of the last run, and against a remote copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import render as R
from attesta.plans.ordered import ordered_index
from attesta.plans.sqlrun import run_sql

BATCH = 500  # file actions per commit


def full(rendered: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, action): create, update, unchanged or delete. Both sides are (path, content_hash)."""
    return run_sql(
        """
        SELECT coalesce(r.path, m.path) AS path, r.content_hash,
          CASE WHEN m.path IS NULL THEN 'create' WHEN r.path IS NULL THEN 'delete' WHEN r.content_hash = m.content_hash THEN 'unchanged' ELSE 'update' END AS action
        FROM @r r FULL JOIN @m m ON r.path = m.path
        """,
        r=rendered, m=manifest,
    )


def incremental(rendered: DataFrame, manifest: DataFrame, page_claims: DataFrame, changed: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """Only new pages, and changed pages that hold a changed claim; the index is always looked at. Never deletes.

    ``page_claims`` has the manifest's (path, claim_id) rows, ``changed`` the claim ids, ``also`` further paths to look at.
    """
    if also is not None:
        held = files_for_claims(page_claims, changed).unionByName(also.select("path"))
        page_claims, changed = held.selectExpr("path", "'' AS claim_id"), changed.sparkSession.createDataFrame([("",)], "claim_id string")
    return run_sql(
        """
        WITH affected AS (
          SELECT path FROM @p p LEFT SEMI JOIN @c c ON p.claim_id = c.claim_id UNION SELECT 'index.md')
        SELECT r.path, r.content_hash, CASE WHEN m.path IS NULL THEN 'create'
          WHEN a.path IS NOT NULL AND r.content_hash <> m.content_hash THEN 'update' ELSE 'unchanged' END AS action
        FROM @r r LEFT JOIN @m m ON r.path = m.path LEFT JOIN affected a ON r.path = a.path
        """,
        r=rendered, m=manifest, p=page_claims, c=changed,
    )


def plan(rendered: DataFrame, manifest: DataFrame, page_claims: DataFrame | None = None, changed: DataFrame | None = None, force_full: bool = False) -> DataFrame:
    """Full when forced, when nothing was written before or when no change set is known; else incremental."""
    if force_full or changed is None or page_claims is None or manifest.isEmpty():
        return full(rendered, manifest)
    return incremental(rendered, manifest, page_claims, changed)


def files_for_claims(page_claims: DataFrame, claims: DataFrame) -> DataFrame:
    return page_claims.join(claims, "claim_id", "left_semi").select("path").distinct()


PLAN_SUMMARY = R.counted([("", "n_create", " create"), ("", "n_update", " update"), ("", "n_delete", " delete"), ("", "n_unchanged", " unchanged")], "no changes")


def summary(plan_df: DataFrame, reason: str) -> DataFrame:
    return run_sql(
        f"""
        SELECT *, n_create + n_update + n_delete AS total_changes, concat('[{reason}] ', {PLAN_SUMMARY}) AS summary FROM (
          SELECT count_if(action = 'create') AS n_create, count_if(action = 'update') AS n_update,
            count_if(action = 'delete') AS n_delete, count_if(action = 'unchanged') AS n_unchanged FROM @p)
        """,
        p=plan_df,
    )


def next_manifest(plan_df: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest after the plan was carried out; an incremental plan leaves pages it did not see alone."""
    return run_sql(
        """
        SELECT coalesce(p.path, m.path) AS path, if(p.action IN ('create', 'update'), p.content_hash, m.content_hash) AS content_hash
        FROM @p p FULL JOIN @m m ON p.path = m.path WHERE NOT (p.action <=> 'delete')
        """,
        p=plan_df, m=manifest,
    )


def sync_actions(local: DataFrame, remote: DataFrame, incremental_mode: bool = False) -> DataFrame:
    """Commit actions against a remote copy, compared by stable hash; deletions only in a full sync."""
    actions = full(local, remote)
    return actions.where("action <> 'delete'") if incremental_mode else actions


def commit_batches(actions: DataFrame, message: str, size: int = BATCH) -> DataFrame:
    """Batch number and message per file action, in path order; numbered by a distributed sort."""
    todo = ordered_index(actions.where("action <> 'unchanged'").select("path", "action"), [], [F.asc("path")], "no")
    return run_sql(
        f"""
        SELECT path, action, batch, if(total > {size}, concat('{message} (batch ', batch, ')'), '{message}') AS message
        FROM (SELECT *, (no - 1) div {size} + 1 AS batch, (SELECT count(*) FROM @t) AS total FROM @t)
        """,
        t=todo,
    )


def auto_message(subjects: DataFrame | None, n_claims: int, prefix: str = "attesta") -> DataFrame | str:
    """The commit message: five subjects and how many more, or the number of claims of a full sync."""
    if subjects is None:
        return f"{prefix}: full sync — {n_claims} claims"
    return run_sql(
        f"""
        SELECT concat('{prefix}: update knowledge for ', array_join(first, ', '), if(n > 5, concat(' (+', n - 5, ' more)'), '')) AS message
        FROM (SELECT (SELECT array_sort(collect_list(subject)) FROM (SELECT DISTINCT subject FROM @s ORDER BY subject LIMIT 5)) AS first,
                (SELECT count(DISTINCT subject) FROM @s) AS n)
        """,
        s=subjects,
    )
