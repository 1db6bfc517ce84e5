"""Document operators: hashing, incremental scan, boilerplate, sections, chunks, version diffs and parse choice."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import render as R
from attesta.functions import text as X
from attesta.plans.sqlrun import run_sql


def content_hashes(artifacts: DataFrame) -> DataFrame:
    return artifacts.selectExpr("*", f"{X.sha_prefix('body')} AS content_hash")


def changed_since(artifacts: DataFrame, state: DataFrame) -> DataFrame:
    """Artifacts whose (source_uri, content_hash) is not in the saved state; adds ``change`` (new or modified)."""
    return run_sql(
        """
        SELECT a.*, if(s.source_uri IS NULL, 'new', 'modified') AS change
        FROM @a a LEFT JOIN (SELECT source_uri, content_hash AS old_hash FROM @s) s ON a.source_uri = s.source_uri
        WHERE NOT (a.content_hash <=> s.old_hash)
        """,
        a=artifacts, s=state,
    )


def removed_since(artifacts: DataFrame, state: DataFrame) -> DataFrame:
    """Saved sources that are gone."""
    return state.join(artifacts.select("source_uri"), "source_uri", "left_anti")


def line_frequency(docs: DataFrame, key: str, text: str, max_len: int = 100, least: int = 1) -> DataFrame:
    """How often each short stripped line occurs per document."""
    return run_sql(
        f"""
        SELECT {key}, line, count(*) AS n FROM (
          SELECT {key}, {X.ws_trim('raw')} AS line FROM (SELECT {key}, explode(split({text}, '\\n')) AS raw FROM @docs))
        WHERE line <> '' AND length(line) < {max_len} GROUP BY {key}, line HAVING count(*) >= {least}
        """,
        docs=docs,
    )


def split_sections(docs: DataFrame, keys: list[str], text: str, preamble: str = "", strip_plain: bool = False) -> DataFrame:
    return run_sql(
        f"""
        SELECT {', '.join(keys)}, pos, s.heading, s.content FROM (
          SELECT {', '.join(keys)}, posexplode({X.sections(text, preamble, strip_plain)}) AS (pos, s) FROM @docs)
        """,
        docs=docs,
    )


def chunk(docs: DataFrame, keys: list[str], text: str, max_chars: int = 6000) -> DataFrame:
    """Chunks (keys, index, heading, content, char_count, chunk_hash)."""
    return run_sql(
        f"""
        SELECT {', '.join(keys)}, index, c.heading, c.content, length(c.content) AS char_count, {X.sha_prefix('c.content')} AS chunk_hash
        FROM (SELECT {', '.join(keys)}, posexplode({X.chunks(text, max_chars)}) AS (index, c) FROM @docs)
        """,
        docs=docs,
    )


def section_diff(old: DataFrame, new: DataFrame, source: str = "source_uri", text: str = "markdown", hash_col: str = "content_hash") -> DataFrame:
    """Section changes (source, heading, change, old_content, new_content) between two versions of the documents.

    A source that is only in ``new`` is new: all its sections count as added. Equal hashes mean nothing changed. Where
    headings repeat, the last section counts. Both versions go through one aggregation per (source, heading).
    """
    both = run_sql(
        f"""
        WITH v AS (
          SELECT n.{source}, n.{text} AS new_text, o.{text} AS old_text,
            CASE WHEN o.{source} IS NULL THEN 'new' WHEN o.{hash_col} = n.{hash_col} THEN 'same' ELSE 'changed' END AS kind
          FROM @new n LEFT JOIN @old o ON n.{source} = o.{source})
        SELECT {source}, kind, true AS is_new, pos, s.heading, s.content
        FROM (SELECT {source}, kind, posexplode({X.sections('new_text', '_preamble_', True)}) AS (pos, s) FROM v)
        UNION ALL
        SELECT {source}, kind, false, pos, s.heading, s.content
        FROM (SELECT {source}, kind, posexplode({X.sections('old_text', '_preamble_', True)}) AS (pos, s) FROM v WHERE kind = 'changed')
        """,
        old=old, new=new,
    )
    return run_sql(
        f"""
        WITH plain AS (
          SELECT {source}, heading, if(kind = 'new', 'added', 'unchanged') AS change, null AS old_content, content AS new_content, kind, pos
          FROM @both WHERE kind <> 'changed'),
        aligned AS (
          SELECT {source}, heading, max_by(content, pos) FILTER (WHERE NOT is_new) AS old_content,
            max_by(content, pos) FILTER (WHERE is_new) AS new_content, cast(null AS INT) AS pos
          FROM @both WHERE kind = 'changed' GROUP BY {source}, heading)
        SELECT {source}, heading, change, old_content, new_content, kind, pos FROM plain
        UNION ALL
        SELECT {source}, heading, CASE WHEN old_content IS NULL THEN 'added' WHEN new_content IS NULL THEN 'removed'
          WHEN old_content = new_content THEN 'unchanged' ELSE 'modified' END, old_content, new_content, 'changed', pos FROM aligned
        """,
        both=both,
    )


@F.pandas_udf(T.StringType())
def diff_text(old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified diff with one line of context, whole; a display may shorten it."""
    def one(a: str, b: str) -> str:
        lines = difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="", n=1)
        return "\n".join(lines)

    return pd.Series([one(a, b) for a, b in zip(old, new)], index=old.index)


def with_diff_text(diff: DataFrame) -> DataFrame:
    """Modified sections with their diff text."""
    return diff.where("change = 'modified'").withColumn("diff_summary", diff_text("old_content", "new_content"))


CHANGE_SUMMARY = R.counted(
    [("+", "n_added", " added"), ("-", "n_removed", " removed"), ("~", "n_modified", " modified"), ("=", "n_unchanged", " unchanged")],
    "no sections",
)


def change_summary(diff: DataFrame, source: str = "source_uri") -> DataFrame:
    """Per source: section counts, change ratio, is_new and a one-line summary."""
    return run_sql(
        f"""
        SELECT *, n_added + n_removed + n_modified AS n_changed,
          coalesce(try_divide(n_added + n_removed + n_modified, n_added + n_removed + n_modified + n_unchanged), 1D) AS change_ratio,
          {CHANGE_SUMMARY} AS summary
        FROM (SELECT {source}, count_if(change = 'added') AS n_added, count_if(change = 'removed') AS n_removed,
                count_if(change = 'modified') AS n_modified, count_if(change = 'unchanged') AS n_unchanged, max(kind) = 'new' AS is_new
              FROM @diff GROUP BY {source})
        """,
        diff=diff,
    )


def qa_mode(summaries: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Which review a changed document gets: none, skip, partial or full."""
    return summaries.selectExpr(
        "*",
        f"""CASE WHEN change_ratio < {threshold} THEN 'none' WHEN is_new THEN 'full' WHEN change_ratio < 0.05 THEN 'skip'
            WHEN change_ratio < 0.3 THEN 'partial' ELSE 'full' END AS review_mode""",
    )


def document_events(summaries: DataFrame, titles: DataFrame, as_of: str, source: str = "source_uri") -> DataFrame:
    """document_added for new sources, document_modified for changed ones, nothing for unchanged ones."""
    return run_sql(
        f"""
        SELECT if(is_new, 'document_added', 'document_modified') AS change_type, s.{source} AS source_uri, '' AS entity_id, TIMESTAMP_NTZ '{as_of}' AS ts,
          if(is_new, to_json(named_struct('title', t.title, 'sections', n_added)),
             to_json(named_struct('change_ratio', round(change_ratio, 3), 'summary', summary))) AS payload
        FROM @s s LEFT JOIN @t t ON s.{source} = t.{source} WHERE is_new OR change_ratio > 0
        """,
        s=summaries, t=titles,
    )


def parse_best(candidates: DataFrame, key: str) -> DataFrame:
    """The better of several parses (key, backend, priority, markdown, tables): highest quality, then lowest priority."""
    return run_sql(
        f"""
        SELECT {key}, b.* FROM (
          SELECT {key}, max_by(struct(backend, markdown, tables, quality), struct(quality, -priority)) AS b
          FROM (SELECT *, {X.quality_score('markdown', 'tables')} AS quality FROM @c) GROUP BY {key})
        """,
        c=candidates,
    )


def cached_split(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks found in the extraction cache (chunk_hash, response), and all chunks still to extract."""
    hits = chunks.join(cache, "chunk_hash", "inner")
    misses = chunks.join(cache.select("chunk_hash"), "chunk_hash", "left_anti")
    return hits, misses
