"""Page and emission queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import render as R
from attesta.functions import text as X
from attesta.operators import conflicts, emission, extraction, ledger, pages
from attesta.plans import views as V
from attesta.plans.ordered import ordered_index
from attesta.plans.sqlrun import run_sql
from attesta.queries.base import LEDGER1, query
from attesta.queries.common import ledger_c1, stamped_c1
from attesta.session import cut_lineage


def _page_claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    claims, evidence = ledger.add_claims(stamped_c1(spark, sf_dir), V.AS_OF, first_piece=True)
    return cut_lineage(pages.page_claims(ledger.decay(claims, V.AS_OF), evidence)), evidence


@query("flagship_entities", f"""
WITH {LEDGER1},
groups AS (SELECT lower(trim(subject)) AS s, lower(trim(predicate)) AS p, count(DISTINCT lower(object)) AS n_objects FROM ledger1 GROUP BY 1, 2)
SELECT lower(trim(subject)) AS entity, count(*) AS claim_count, CAST(sum(n_supporting) AS BIGINT) AS n_evidence, count_if(status = 'corroborated') AS n_corroborated,
  round(avg(truth_score), 6) AS avg_truth_score, max(n_objects) AS n_values
FROM ledger1 JOIN groups ON s = lower(trim(subject)) AND p = lower(trim(predicate)) GROUP BY 1 ORDER BY avg(truth_score) DESC, 1 LIMIT 100""")
def flagship_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge, authority, promotion, decay, score and conflicts, then the 100 best supported entities; ``n_values`` is the most that one of their predicates has."""
    c = ledger_c1(spark, sf_dir)
    return run_sql(
        f"""
        SELECT entity, count(*) AS claim_count, sum(n_supporting) AS n_evidence, count_if(status = 'corroborated') AS n_corroborated,
          round(avg(truth_score), 6) AS avg_truth_score, max(coalesce(n_objects, 1L)) AS n_values
        FROM (SELECT {X.norm('subject')} AS entity, {X.conflict_key('subject', 'predicate')} AS ck, n_supporting, status, truth_score FROM @c) e LEFT JOIN @k k ON e.ck = k.ck
        GROUP BY entity ORDER BY avg(truth_score) DESC, entity LIMIT 100
        """,
        c=c, k=conflicts.conflict_counts(c),
    )


@query("entity_page_summary", f"""
WITH {LEDGER1}
SELECT subject, count(*) AS claim_count, round(sum(round(truth_score, 9)::DECIMAL(28,9))::DOUBLE / count(*), 3) AS avg_truth_score, count(DISTINCT first_source) AS n_sources FROM ledger1 GROUP BY subject""")
def entity_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pc, _ = _page_claims(spark, sf_dir)
    return pages.entity_summary(pc)


@query("source_page_summary", f"WITH {LEDGER1} SELECT first_source AS source, count(*) AS claims_extracted, count(DISTINCT subject) AS n_entities FROM ledger1 GROUP BY 1")
def source_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pc, _ = _page_claims(spark, sf_dir)
    return run_sql(
        "SELECT source, sum(n) AS claims_extracted, count(*) AS n_entities FROM @s GROUP BY source", s=pages.source_summary(pc)
    )


TOPIC_OF_SEGMENT = "CASE WHEN segment IN ('BUILDING', 'FURNITURE') THEN 'premises' WHEN segment = 'HOUSEHOLD' THEN 'home' ELSE 'industry' END"


def _with_topics(spark: SparkSession, sf_dir: str, pc: DataFrame) -> DataFrame:
    """Page claims with the topic of their customer's market segment.

    The name is a column before the join: a sort by an expression works it out again for each comparison.
    """
    seg = V.table(spark, sf_dir, "customer").selectExpr("lower(c_name) AS name", "c_mktsegment AS segment")
    named = pc.selectExpr("*", f"{X.norm('subject')} AS _name")
    return run_sql(f"SELECT p.* EXCEPT (_name), {TOPIC_OF_SEGMENT} AS topic FROM @p p JOIN @s s ON p._name = s.name", p=named, s=seg)


@query("topic_page_summary", f"""
WITH {LEDGER1}
SELECT {TOPIC_OF_SEGMENT} AS topic, count(*) AS claim_count, count(DISTINCT subject) AS n_entities, min(subject) AS first_entity FROM ledger1 GROUP BY 1""")
def topic_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims are read once here, so they are not written; their sources play no part."""
    claims, _ = ledger.add_claims(stamped_c1(spark, sf_dir), V.AS_OF)
    return pages.topic_summary(_with_topics(spark, sf_dir, pages.active_claims(claims)))


@query("index_summary", f"""
WITH {LEDGER1}
SELECT count(*) AS total_claims, count(DISTINCT subject) AS entity_count, count(DISTINCT first_source) AS source_count FROM ledger1""")
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pc, _ = _page_claims(spark, sf_dir)
    return pages.index_summary(pc)


SLUG = "left(regexp_replace(replace(lower(trim({0})), ' ', '-'), '[^\\p{{L}}\\p{{N}}_-]', '', 'g'), 80)"


@query("claim_bullets", f"""
WITH {LEDGER1}
SELECT claim_id, '- **[' || status || ']** ' || natural_language || '  `bar` ' || repeat('█', CAST(floor(truth_score * 10) AS INTEGER)) || chr(10) || '  — [' || first_source || '](../sources/' || {SLUG.format('first_source')} || '.md)' AS bullet
FROM ledger1""")
def claim_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim bullets; the printed score is replaced by a word, since languages round halves differently."""
    pc, _ = _page_claims(spark, sf_dir)
    return pages.bullets(pc).selectExpr("claim_id", "regexp_replace(bullet, r'`score=[0-9.]+`', '`bar`') AS bullet")


@query("source_page_numbers", f"""
WITH {LEDGER1}
SELECT first_source AS source, row_number() OVER (PARTITION BY first_source ORDER BY truth_score DESC, seq) AS no, claim_id FROM ledger1""")
def source_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of each claim on its source page."""
    pc, _ = _page_claims(spark, sf_dir)
    numbered = ordered_index(pc.select("source", "claim_id", "truth_score", "seq"), ["source"], [F.desc("truth_score"), F.asc("seq")], "no")
    return numbered.select("source", "no", "claim_id")


@query("entity_pages", f"""
WITH {LEDGER1}, s AS (SELECT {SLUG.format('l.subject')} AS slug, count(DISTINCT c.source_artifact) AS n FROM ledger1 l JOIN c1 c USING (fp) GROUP BY 1)
SELECT 'entities/' || slug || '.md' AS path, b.n AS n_bullets, s.n AS n_source_links, b.n_topics
FROM (SELECT {SLUG.format('subject')} AS slug, count(*) AS n, count(DISTINCT {TOPIC_OF_SEGMENT}) AS n_topics FROM ledger1 GROUP BY 1) b JOIN s USING (slug)""")
def entity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity pages rendered whole; checked by their claims, topic headings and source links."""
    pc, evidence = _page_claims(spark, sf_dir)
    lines = pages.entity_lines(pc, evidence, None, V.AS_OF, _with_topics(spark, sf_dir, pc))
    return run_sql(
        """
        SELECT path, count_if(section = 2 AND NOT isnan(k2) AND k2 > double('-Infinity')) AS n_bullets, count_if(section = 5) AS n_source_links,
          count_if(section = 2 AND k2 = double('-Infinity')) AS n_topics FROM @l GROUP BY path
        """,
        l=lines,
    )


@query("page_parts")
def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as parts with their stable hashes."""
    pc, evidence = _page_claims(spark, sf_dir)
    topical = _with_topics(spark, sf_dir, pc)
    lines = pages.union_lines([
        pages.entity_lines(pc, evidence, None, V.AS_OF, topical), pages.source_lines(pc, V.AS_OF), pages.topic_lines(topical, V.AS_OF),
        pages.conflict_lines(pc, V.AS_OF), pages.index_lines(pc, V.AS_OF),
    ])
    return pages.to_parts(lines).selectExpr("path", "part", "content_hash", "cast(length(content) AS BIGINT) AS n_chars")


@query("claim_files", f"""
WITH {LEDGER1}
SELECT 'claims/' || knowledge_class || '/' || {SLUG.format("subject || '-' || predicate || '-' || object")} || '.md' AS path, claim_id FROM ledger1""")
def claim_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.claim_files(ledger_c1(spark, sf_dir)).select("path", "claim_id")


# --- emission: the documents of a source as pages, today's against those of an older run ---

RENDERED = """
rendered AS (SELECT 'pages/' || doc_id || '.md' AS path, left(sha256(text), 16) AS content_hash, doc_id FROM documents WHERE doc_id % 10 <> 0),
manifest AS (SELECT 'pages/' || doc_id || '.md' AS path, CASE WHEN doc_id % 7 = 0 THEN 'older' ELSE left(sha256(text), 16) END AS content_hash FROM documents WHERE doc_id % 6 <> 0),
planned AS (
  SELECT coalesce(r.path, m.path) AS path, CASE WHEN m.path IS NULL THEN 'create' WHEN r.path IS NULL THEN 'delete' WHEN r.content_hash = m.content_hash THEN 'unchanged' ELSE 'update' END AS action,
    r.content_hash AS new_hash, m.content_hash AS old_hash
  FROM rendered r FULL JOIN manifest m ON r.path = m.path)"""


def _rendered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = V.table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('pages/', doc_id, '.md') AS path", f"{X.sha_prefix('text')} AS content_hash")
    rendered = d.where("doc_id % 10 <> 0").select("path", "content_hash")
    manifest = d.where("doc_id % 6 <> 0").selectExpr("path", "if(doc_id % 7 = 0, 'older', content_hash) AS content_hash")
    return rendered, manifest


@query("plan_full", f"WITH {RENDERED} SELECT path, action FROM planned")
def plan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emission.full(*_rendered(spark, sf_dir)).select("path", "action")


@query("plan_summary", f"""
WITH {RENDERED}
SELECT '[full] ' || count_if(action = 'create') || ' create, ' || count_if(action = 'update') || ' update, ' || count_if(action = 'delete') || ' delete, ' || count_if(action = 'unchanged') || ' unchanged' AS summary,
  count_if(action <> 'unchanged') AS total_changes FROM planned""")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emission.summary(emission.full(*_rendered(spark, sf_dir)), "full").select("summary", "total_changes")


@query("plan_incremental", f"""
WITH {RENDERED}, affected AS (SELECT 'pages/' || doc_id || '.md' AS path FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 3 = 1)
SELECT p.path, CASE WHEN old_hash IS NULL THEN 'create' WHEN a.path IS NOT NULL AND new_hash <> old_hash THEN 'update' ELSE 'unchanged' END AS action
FROM planned p LEFT JOIN affected a ON p.path = a.path WHERE new_hash IS NOT NULL""")
def plan_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered, manifest = _rendered(spark, sf_dir)
    page_claims = run_sql("SELECT path, concat('c3-', regexp_extract(path, r'(\\d+)', 1)) AS claim_id FROM @m", m=manifest)
    changed = V.table(spark, sf_dir, "documents").where("doc_id % 3 = 1").selectExpr("concat('c3-', doc_id) AS claim_id")
    return emission.incremental(rendered, manifest, page_claims, changed).select("path", "action")


@query("manifest_update", f"WITH {RENDERED} SELECT path, coalesce(new_hash, old_hash) AS content_hash FROM planned WHERE action <> 'delete'")
def manifest_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered, manifest = _rendered(spark, sf_dir)
    return emission.next_manifest(emission.full(rendered, manifest), manifest)


@query("sync_actions", """
SELECT 'pages/' || doc_id || '.md' AS path, CASE WHEN doc_id % 9 = 0 THEN 'create' WHEN doc_id % 5 = 0 THEN 'update' ELSE 'unchanged' END AS action FROM documents WHERE doc_id % 4 <> 0
UNION ALL SELECT 'pages/' || doc_id || '.md', 'delete' FROM documents WHERE doc_id % 4 = 0 AND doc_id % 9 <> 0""")
def sync_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local pages against a remote copy; the time stamps inside differ and do not count."""
    v = run_sql(
        """
        SELECT doc_id, concat('pages/', doc_id, '.md') AS path, concat('---\\ntitle: x\\n  last_updated: today\\n---\\n', text) AS local,
          concat('---\\ntitle: x\\nlast_updated: long ago\\n---\\n', if(doc_id % 5 = 0, 'changed', text)) AS remote FROM @d
        """,
        d=V.table(spark, sf_dir, "documents"),
    )
    local = v.where("doc_id % 4 <> 0").selectExpr("path", f"{X.stable_hash('local')} AS content_hash")
    remote = v.where("doc_id % 9 <> 0").selectExpr("path", f"{X.stable_hash('remote')} AS content_hash")
    return emission.sync_actions(local, remote).select("path", "action")


@query("stable_hash", """
WITH lines AS (SELECT doc_id, unnest(arr) AS line, generate_subscripts(arr, 1) AS pos FROM (
  SELECT doc_id, string_split_regex(regexp_replace('last_updated: now' || chr(10) || text, '(\\r\\n|\\n|\\r)$', ''), '\\r\\n|\\n|\\r') AS arr FROM documents))
SELECT doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT regexp_matches(trim(line), '^last_(updated|projected):')), '')) AS hash FROM lines GROUP BY doc_id""")
def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = "concat('last_updated: now\\n', text)"
    return V.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{X.stable_hash(page)} AS hash")


@query("commit_batches", f"""
WITH {RENDERED}, n AS (SELECT path, action, row_number() OVER (ORDER BY path) AS no FROM planned WHERE action <> 'unchanged')
SELECT path, action, (no - 1) // 100 + 1 AS batch, 'Update knowledge (batch ' || ((no - 1) // 100 + 1) || ')' AS message FROM n""")
def commit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = emission.full(*_rendered(spark, sf_dir))
    return emission.commit_batches(plan, "Update knowledge", size=100)


@query("commit_message", """
SELECT 'attesta: update knowledge for ' || (SELECT string_agg(c_name, ', ' ORDER BY c_name) FROM (SELECT c_name FROM customer ORDER BY c_name LIMIT 5))
  || ' (+' || ((SELECT count(DISTINCT c_name) FROM customer) - 5) || ' more)' AS message""")
def commit_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emission.auto_message(V.table(spark, sf_dir, "customer").selectExpr("c_name AS subject"), 0)


@query("alias_explode", """
SELECT c_name AS subject, 'buys in segment' AS predicate, c_mktsegment AS object, 0.7::DOUBLE AS confidence, 'process' AS knowledge_class FROM customer
UNION ALL SELECT 'cust-' || c_custkey, 'is alias of', c_name, 0.95::DOUBLE, 'stable' FROM customer
UNION ALL SELECT '#' || c_custkey, 'is alias of', c_name, 0.95::DOUBLE, 'stable' FROM customer WHERE c_custkey % 2 = 0""")
def alias_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction results (JSON, as a model returns them) parsed into claims; every alias is a claim of its own."""
    raw = V.table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey AS STRING) AS artifact_id", "'customers' AS source_artifact", "'' AS author",
        """to_json(named_struct('claims', array(named_struct('subject', c_name, 'predicate', 'buys in segment', 'object', c_mktsegment,
             'natural_language', concat(c_name, ' buys in ', c_mktsegment), 'confidence', 0.7D, 'knowledge_class', 'unheard-of', 'valid_from', 'null', 'source_span', '',
             'entity_aliases', if(c_custkey % 2 = 0,
                array(named_struct('alias', concat('cust-', c_custkey), 'canonical', c_name), named_struct('alias', concat('#', c_custkey), 'canonical', c_name)),
                array(named_struct('alias', concat('cust-', c_custkey), 'canonical', c_name))))))) AS response""",
    )
    return extraction.parse_responses(raw).select("subject", "predicate", "object", "confidence", "knowledge_class")
