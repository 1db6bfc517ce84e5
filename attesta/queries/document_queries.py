"""Document queries: hashes, scans, boilerplate, sections, chunks, version diffs, parse quality and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.functions import text as X
from attesta.functions import topics as TP
from attesta.operators import documents as D
from attesta.plans import views as V
from attesta.plans.sqlrun import run_sql
from attesta.queries.base import A1, PAGES_MD, WS, query, sections_sql


@query("content_hash_dedup", f"""
WITH {A1}
SELECT left(sha256(body), 16) AS content_hash, count(*) AS n_copies, min(artifact_id) AS first_artifact FROM a1 GROUP BY 1""")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(
        "SELECT content_hash, count(*) AS n_copies, min(artifact_id) AS first_artifact FROM @a GROUP BY content_hash",
        a=D.content_hashes(V.artifacts(spark, sf_dir)),
    )


@query("incremental_scan", f"""
WITH {A1}, h AS (SELECT *, left(sha256(body), 16) AS content_hash FROM a1)
SELECT artifact_id, content_hash, CASE WHEN length(title) % 3 = 0 OR source_type <> 'document' THEN 'new' ELSE 'modified' END AS change
FROM h WHERE source_type <> 'document' OR length(title) % 3 = 0 OR content_hash LIKE '0%'""")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and changed artifacts against a saved state that knows some documents, a few with an older hash."""
    a = D.content_hashes(V.artifacts(spark, sf_dir))
    state = a.where("source_type = 'document' AND length(title) % 3 <> 0").selectExpr(
        "source_uri", "if(startswith(content_hash, '0'), 'stale', content_hash) AS content_hash"
    )
    return D.changed_since(a, state).select("artifact_id", "content_hash", "change")


@query("artifact_episodes", f"""
WITH {A1}
SELECT source_type || '-' || artifact_id AS name, source_type || ': ' || title AS source_description, length(body) AS n_chars FROM a1""")
def artifact_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes as the knowledge graph stores them; the body is JSON and parses back to the whole text."""
    return run_sql(
        """
        SELECT name, source_description, cast(length(get_json_object(episode_body, '$.body')) AS BIGINT) AS n_chars FROM (
          SELECT concat(source_type, '-', artifact_id) AS name, concat(source_type, ': ', title) AS source_description,
            to_json(named_struct('title', title, 'body', body, 'metadata', map('source_type', source_type, 'source_uri', source_uri, 'author', author))) AS episode_body
          FROM @a)
        """,
        a=V.artifacts(spark, sf_dir),
    )


LINES = f"""
lines AS (
  SELECT doc_id, unnest(arr) AS line, generate_subscripts(arr, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents)),
bare AS (SELECT *, trim(line, {WS}) AS b FROM lines),
freq AS (SELECT doc_id, b, count(*) AS n FROM bare WHERE b <> '' AND length(b) < 100 GROUP BY doc_id, b)"""


@query("line_frequency", f"WITH {LINES} SELECT doc_id, b AS line, n FROM freq WHERE n >= 2")
def line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.line_frequency(V.spread(V.table(spark, sf_dir, "documents")), "doc_id", "text", least=2)


@query("boilerplate_strip", f"""
WITH {LINES},
kept AS (
  SELECT l.doc_id, l.pos, l.line FROM bare l LEFT JOIN freq f ON l.doc_id = f.doc_id AND l.b = f.b AND f.n >= 3
  WHERE f.b IS NULL AND NOT regexp_matches(l.b, '^(Page\\s+\\d+|[-–—]\\s*\\d+\\s*[-–—]|\\d+\\s*$)'))
SELECT d.doc_id, len(string_split(d.text, chr(10))) - coalesce(k.n, 0) AS n_dropped, left(sha256(coalesce(k.body, '')), 16) AS text_hash
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS body FROM kept GROUP BY doc_id) k ON d.doc_id = k.doc_id""")
def boilerplate_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(
        f"""
        SELECT doc_id, cast(n_before - if(body = '' AND text <> '' AND n_before > 0, 0, size(split(body, '\\n'))) AS BIGINT) AS n_dropped,
          {X.sha_prefix('body')} AS text_hash
        FROM (SELECT doc_id, text, size(split(text, '\\n')) AS n_before, {X.strip_boilerplate('text')} AS body FROM @d)
        """,
        d=V.spread(V.table(spark, sf_dir, "documents")),
    )


@query("heading_extract", f"""
WITH {PAGES_MD}
SELECT page_id, array_to_string(list_transform(regexp_extract_all(markdown, '(?m)^(#{{1,4}})\\s+(.+)$', 2), lambda h: trim(h, {WS})), '|') AS headings,
  len(regexp_extract_all(markdown, '(?m)^(#{{1,4}})\\s+(.+)$', 2)) AS n FROM md""")
def heading_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(
        "SELECT page_id, array_join(h, '|') AS headings, cast(size(h) AS BIGINT) AS n FROM (SELECT page_id, " + X.headings("markdown") + " AS h FROM @m)",
        m=V.page_markdown(spark, sf_dir),
    )


@query("section_split", f"""
WITH {PAGES_MD}, {sections_sql('md', 'page_id', 'markdown', '', 's')}
SELECT page_id, heading, length(content) AS n_chars, left(sha256(content), 16) AS content_hash FROM s""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.split_sections(V.page_markdown(spark, sf_dir), ["page_id"], "markdown", strip_plain=True)
    return s.selectExpr("page_id", "heading", "cast(length(content) AS BIGINT) AS n_chars", f"{X.sha_prefix('content')} AS content_hash")


CHUNK_SQL = f"""
WITH {PAGES_MD}, {sections_sql('md', 'page_id', 'markdown', '', 's')},
packed AS (
  SELECT page_id, pos, heading, CASE WHEN length(content) <= MAX_CHARS THEN [content] ELSE
    (SELECT list_append(r.done, array_to_string(r.cur, chr(10) || chr(10))) FROM (SELECT list_reduce(
      list_transform(string_split_regex(content, '\\n\\n+'), lambda p: {{'done': CAST([] AS VARCHAR[]), 'cur': [p], 'len': length(p) + 2}}),
      lambda a, x: CASE WHEN a.len + x.len > MAX_CHARS
        THEN {{'done': list_append(a.done, array_to_string(a.cur, chr(10) || chr(10))), 'cur': x.cur, 'len': x.len}}
        ELSE {{'done': a.done, 'cur': list_concat(a.cur, x.cur), 'len': a.len + x.len}} END) AS r)) END AS texts
  FROM s),
flat AS (SELECT page_id, pos, heading, unnest(texts) AS content, generate_subscripts(texts, 1) AS sub FROM packed)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos, sub) - 1 AS index, heading, length(content) AS char_count, left(sha256(content), 16) AS chunk_hash FROM flat"""


def _chunks(spark: SparkSession, sf_dir: str, max_chars: int) -> DataFrame:
    c = D.chunk(V.page_markdown(spark, sf_dir), ["page_id"], "markdown", max_chars)
    return c.selectExpr("page_id", "cast(index AS BIGINT) AS index", "heading", "cast(char_count AS BIGINT) AS char_count", "chunk_hash")


@query("chunk_index", CHUNK_SQL.replace("MAX_CHARS", "6000"))
def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, 6000)


@query("chunk_pack", CHUNK_SQL.replace("MAX_CHARS", "600"))
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a small limit, so that most sections are packed from paragraphs."""
    return _chunks(spark, sf_dir, 600)


@query("chunk_cache_split", CHUNK_SQL.replace("MAX_CHARS", "600").replace(
    "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos, sub) - 1 AS index, heading, length(content) AS char_count, left(sha256(content), 16) AS chunk_hash FROM flat",
    """, h AS (SELECT page_id, left(sha256(content), 16) AS chunk_hash FROM flat)
SELECT page_id % 5 AS bucket, count_if(chunk_hash < '4') AS n_cached, count_if(NOT chunk_hash < '4') AS n_pending FROM h GROUP BY 1"""))
def chunk_cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks already in the extraction cache against those still to extract; the cache holds a quarter of them."""
    c = _chunks(spark, sf_dir, 600)
    cache = run_sql("SELECT DISTINCT chunk_hash, array('cached') AS claims FROM @c WHERE chunk_hash < '4'", c=c)
    hits, misses = D.cached_split(c, cache)
    return run_sql(
        """
        SELECT page_id % 5 AS bucket, count_if(hit) AS n_cached, count_if(NOT hit) AS n_pending FROM (
          SELECT page_id, true AS hit FROM @h UNION ALL SELECT page_id, false FROM @m) GROUP BY 1
        """,
        h=hits, m=misses,
    )


VERSIONS_SQL = PAGES_MD + """,
new_v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN markdown WHEN 1 THEN markdown || chr(10) || chr(10) || '# Added section' || chr(10) || chr(10) || 'New text.'
    WHEN 2 THEN replace(markdown, 'a', 'A') ELSE replace(markdown, '# ', '# Renamed ') END AS markdown FROM md),
old_v AS (SELECT * FROM md WHERE page_id % 10 <> 9)"""
DIFF_KINDS = f"""
WITH {VERSIONS_SQL}, {sections_sql('new_v', 'page_id', 'markdown', '_preamble_', 'ns')}, {sections_sql('old_v', 'page_id', 'markdown', '_preamble_', 'os')},
kind AS (SELECT n.page_id, CASE WHEN o.page_id IS NULL THEN 'new' WHEN sha256(o.markdown) = sha256(n.markdown) THEN 'same' ELSE 'changed' END AS kind
         FROM new_v n LEFT JOIN old_v o USING (page_id)),
plain AS (SELECT page_id, heading, CASE kind WHEN 'new' THEN 'added' ELSE 'unchanged' END AS change FROM ns JOIN kind USING (page_id) WHERE kind <> 'changed'),
n1 AS (SELECT page_id, heading, arg_max(content, pos) AS c FROM ns JOIN kind USING (page_id) WHERE kind = 'changed' GROUP BY ALL),
o1 AS (SELECT page_id, heading, arg_max(content, pos) AS c FROM os JOIN kind USING (page_id) WHERE kind = 'changed' GROUP BY ALL),
diff AS (
  SELECT * FROM plain UNION ALL
  SELECT coalesce(n.page_id, o.page_id), coalesce(n.heading, o.heading),
    CASE WHEN o.c IS NULL THEN 'added' WHEN n.c IS NULL THEN 'removed' WHEN o.c = n.c THEN 'unchanged' ELSE 'modified' END
  FROM n1 n FULL JOIN o1 o ON n.page_id = o.page_id AND n.heading = o.heading)"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    md = V.page_markdown(spark, sf_dir).select("page_id", "markdown")
    new = md.selectExpr(
        "page_id",
        """CASE page_id % 4 WHEN 0 THEN markdown WHEN 1 THEN concat(markdown, '\\n\\n# Added section\\n\\nNew text.')
           WHEN 2 THEN replace(markdown, 'a', 'A') ELSE replace(markdown, '# ', '# Renamed ') END AS markdown""",
    )
    hashed = [df.selectExpr("*", f"{X.sha_prefix('markdown')} AS content_hash") for df in (md.where("page_id % 10 <> 9"), new)]
    return hashed[0], hashed[1]


@query("section_diff", DIFF_KINDS + " SELECT page_id, heading, change FROM diff")
def section_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return D.section_diff(old, new, "page_id").select("page_id", "heading", "change")


@query("section_diff_text")
def section_diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diff text of each modified section."""
    old, new = _versions(spark, sf_dir)
    return D.with_diff_text(D.section_diff(old, new, "page_id")).select("page_id", "heading", "diff_summary")


SUMMARY_SQL = DIFF_KINDS + """,
s AS (SELECT page_id, count_if(change = 'added') AS a, count_if(change = 'removed') AS r, count_if(change = 'modified') AS m, count_if(change = 'unchanged') AS u
      FROM diff GROUP BY page_id),
ratio AS (SELECT s.*, kind = 'new' AS is_new, (a + r + m) / CAST(a + r + m + u AS DOUBLE) AS ratio FROM s JOIN kind USING (page_id))"""


@query("change_ratio", SUMMARY_SQL + """
SELECT page_id, is_new, round(ratio, 6) AS change_ratio, concat_ws(', ', CASE WHEN a > 0 THEN '+' || a || ' added' END, CASE WHEN r > 0 THEN '-' || r || ' removed' END,
  CASE WHEN m > 0 THEN '~' || m || ' modified' END, CASE WHEN u > 0 THEN '=' || u || ' unchanged' END) AS summary FROM ratio""")
def change_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return D.change_summary(D.section_diff(old, new, "page_id"), "page_id").selectExpr(
        "page_id", "is_new", "round(change_ratio, 6) AS change_ratio", "summary"
    )


@query("qa_gate", SUMMARY_SQL + """
SELECT CASE WHEN ratio < 0.05 THEN 'none' WHEN is_new THEN 'full' WHEN ratio < 0.3 THEN 'partial' ELSE 'full' END AS review_mode, count(*) AS n FROM ratio GROUP BY 1""")
def qa_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    gate = D.qa_mode(D.change_summary(D.section_diff(old, new, "page_id"), "page_id"))
    return run_sql("SELECT review_mode, count(*) AS n FROM @g GROUP BY review_mode", g=gate)


@query("document_events", SUMMARY_SQL + """
SELECT CASE WHEN is_new THEN 'document_added' ELSE 'document_modified' END AS change_type, page_id, CASE WHEN is_new THEN a END AS sections, CASE WHEN NOT is_new THEN round(ratio, 3) END AS ratio
FROM ratio WHERE is_new OR ratio > 0""")
def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    summaries = D.change_summary(D.section_diff(old, new, "page_id"), "page_id").withColumnRenamed("page_id", "source_uri")
    events = D.document_events(summaries, new.selectExpr("page_id AS source_uri", "concat('Page ', page_id) AS title"), V.AS_OF)
    return events.selectExpr(
        "change_type", "source_uri AS page_id", "cast(get_json_object(payload, '$.sections') AS BIGINT) AS sections",
        "cast(get_json_object(payload, '$.change_ratio') AS DOUBLE) AS ratio",
    )


QUALITY_SQL = f"""
CASE WHEN length(t) = 0 THEN 0.0 ELSE least(1.0::DOUBLE,
  (least(wc / 500.0::DOUBLE, 0.3::DOUBLE) + CASE WHEN tables > 0 THEN 0.15 ELSE 0.0 END::DOUBLE
   + least((len(regexp_extract_all(t, '(?m)^#{{1,6}}\\s')) + len(regexp_extract_all(t, '(?m)^[-*]\\s'))) / 20.0::DOUBLE, 0.2::DOUBLE))
  * CASE WHEN wc > 0 AND length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) / CAST(length(t) AS DOUBLE) > 0.1 THEN 0.7 ELSE 1.0 END::DOUBLE
  * CASE WHEN len(ls) > 0 AND list_sum(list_transform(ls, lambda x: length(x))) / CAST(len(ls) AS DOUBLE) < 10 THEN 0.5 ELSE 1.0 END::DOUBLE
  * CASE WHEN length(regexp_replace(left(t, 500), '[^\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) > 10 THEN 0.1 ELSE 1.0 END::DOUBLE) END"""
PREPARED = f"""*, len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) AS wc,
  list_filter(string_split_regex(t, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: trim(x, {WS}) <> '') AS ls"""


@query("parse_quality_score", f"""
WITH p AS (SELECT {PREPARED} FROM (SELECT doc_id, text AS t, 0 AS tables FROM documents))
SELECT doc_id, wc AS word_count, round({QUALITY_SQL} + 1e-9, 6) AS quality FROM p""")
def parse_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.spread(V.table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", f"{X.word_count('text')} AS word_count", f"round({X.quality_score('text', '0')} + 1e-9D, 6) AS quality"
    )


@query("parse_best", f"""
WITH {PAGES_MD},
c AS (SELECT page_id, 'markdown' AS backend, 0 AS priority, markdown AS t, 0 AS tables FROM md UNION ALL SELECT page_id, 'text', 1, html, 0 FROM pages),
p AS (SELECT {PREPARED} FROM c), q AS (SELECT page_id, backend, priority, {QUALITY_SQL} AS quality FROM p)
SELECT page_id, arg_max(backend, round(quality, 9) * 10 - priority) AS backend, round(max(quality) + 1e-9, 6) AS quality FROM q GROUP BY page_id""")
def parse_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better parse of each page: structured Markdown or the raw text."""
    candidates = run_sql(
        """
        SELECT page_id, 'markdown' AS backend, 0 AS priority, markdown, 0 AS tables FROM @m
        UNION ALL SELECT page_id, 'text', 1, html, 0 FROM @p
        """,
        m=V.page_markdown(spark, sf_dir), p=V.table(spark, sf_dir, "pages"),
    )
    return D.parse_best(candidates, "page_id").selectExpr("page_id", "backend", "round(quality + 1e-9D, 6) AS quality")


def _topic_cases(text: str) -> str:
    cases = []
    for topic, keywords in TP.TOPIC_KEYWORDS.items():
        test = " OR ".join(f"contains({text}, '{k}')" for k in keywords)
        cases.append(f"CASE WHEN {test} THEN '{topic}' END")
    return f"coalesce(nullif(concat_ws(',', {', '.join(cases)}), ''), '{TP.FALLBACK_TOPIC}')"


@query("topic_keyword", f"SELECT doc_id, {_topic_cases('lower(text)')} AS topics FROM documents")
def topic_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.spread(V.table(spark, sf_dir, "documents")).selectExpr("doc_id", f"array_join({TP.keyword_topics('text')}, ',') AS topics")


@query("topic_counts", f"""
SELECT topic, count(*) AS n, count(DISTINCT source) AS n_sources FROM (
  SELECT source, unnest(string_split({_topic_cases('lower(text)')}, ',')) AS topic FROM documents) GROUP BY topic""")
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(
        f"SELECT topic, count(*) AS n, count(DISTINCT source) AS n_sources FROM (SELECT source, explode({TP.keyword_topics('text')}) AS topic FROM @d) GROUP BY topic",
        d=V.spread(V.table(spark, sf_dir, "documents")),
    )
