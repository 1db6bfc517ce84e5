"""Registry of named queries, each with the equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# The claim views of plans/views.py in SQL, to be put in front of a query.
CLASS_OF_SEGMENT = "CASE c_mktsegment WHEN 'BUILDING' THEN 'stable' WHEN 'AUTOMOBILE' THEN 'process' WHEN 'MACHINERY' THEN 'tacit' WHEN 'FURNITURE' THEN 'stateful' ELSE 'process' END"
CLASS_OF_TYPE = "CASE p_type WHEN 'ECONOMY' THEN 'stable' WHEN 'SMALL' THEN 'process' WHEN 'MEDIUM' THEN 'tacit' WHEN 'PROMO' THEN 'stateful' ELSE 'process' END"
WEIGHT_OF_PRIORITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 0.9 WHEN '2-HIGH' THEN 0.8 WHEN '3-MEDIUM' THEN 0.6 WHEN '5-LOW' THEN 0.3 ELSE 0.5 END"

C1 = f"""
c1 AS (
  SELECT o_orderkey AS seq, 'c1-' || o_orderkey AS claim_id,
    CASE WHEN o_orderkey % 3 = 0 THEN c_name WHEN o_orderkey % 3 = 1 THEN upper(c_name) ELSE '  ' || lower(c_name) || ' ' END AS subject,
    'has order status' AS predicate, o_orderstatus AS object,
    c_name || ' has order status ' || o_orderstatus AS natural_language,
    least(0.95::DOUBLE, 0.2::DOUBLE + o_totalprice / 500000.0::DOUBLE) AS confidence,
    {CLASS_OF_SEGMENT} AS knowledge_class, o_orderdate AS created_at, o_orderpriority AS author, c_mktsegment AS segment,
    CAST(o_orderkey AS VARCHAR) AS artifact_id, 'orders-' || year(o_orderdate) AS source_artifact,
    CAST({WEIGHT_OF_PRIORITY} AS DOUBLE) AS weight,
    lower(c_name) || '|has order status|' || lower(o_orderstatus) AS fp
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

# The ledger of C1: merged, promoted, decayed and scored as of 2002-01-01. All its evidence supports.
LEDGER1 = C1 + """,
c1_merged AS (
  SELECT fp, min(seq) AS seq, arg_min(claim_id, seq) AS claim_id, arg_min(subject, seq) AS subject, arg_min(predicate, seq) AS predicate,
    arg_min(object, seq) AS object, arg_min(natural_language, seq) AS natural_language, arg_min(knowledge_class, seq) AS knowledge_class,
    arg_min(created_at, seq) AS created_at, arg_min(source_artifact, seq) AS first_source, arg_min(segment, seq) AS segment,
    max(confidence) AS confidence, count(*) AS n_supporting, max(weight) AS max_authority
  FROM c1 GROUP BY fp),
c1_status AS (
  SELECT *,
    CASE WHEN n_supporting >= 2 THEN 'corroborated' WHEN max_authority >= 0.8 THEN 'unverified'
         WHEN confidence * max_authority * 0.25 >= 0.15 THEN 'unverified' ELSE 'candidate' END AS status,
    CASE WHEN n_supporting >= 2 THEN TIMESTAMP '2002-01-01' END AS last_confirmed_at
  FROM c1_merged),
c1_fresh AS (
  SELECT *, pow(CASE knowledge_class WHEN 'stable' THEN 0.999 WHEN 'process' THEN 0.995 WHEN 'tacit' THEN 0.98 ELSE 0.95 END::DOUBLE,
    (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(coalesce(last_confirmed_at, created_at))) / 86400000000.0::DOUBLE) AS fresh
  FROM c1_status),
ledger1 AS (
  SELECT * EXCLUDE (fresh), CASE WHEN abs(fresh - 1.0) > 0.001 THEN round(fresh, 4) ELSE 1.0::DOUBLE END AS recency,
    abs(fresh - 1.0) > 0.001 AS decayed,
    confidence * max_authority * (CASE WHEN abs(fresh - 1.0) > 0.001 THEN round(fresh, 4) ELSE 1.0::DOUBLE END) * least(1.0::DOUBLE, n_supporting * 0.25::DOUBLE) AS truth_score
  FROM c1_fresh)"""

C2 = f"""
c2 AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS seq,
    'c2-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS claim_id,
    'part:' || l_partkey AS subject, 'supplied by' AS predicate, 'supplier:' || l_suppkey AS object,
    0.3::DOUBLE + l_discount * 5 AS confidence, {CLASS_OF_TYPE} AS knowledge_class, l_shipdate AS created_at,
    l_shipdate AS valid_from,
    CASE WHEN l_linestatus = 'F' THEN l_shipdate + to_days(CAST(l_quantity AS INTEGER)) END AS valid_until,
    CAST(l_orderkey AS VARCHAR) AS artifact_id, l_returnflag <> 'R' AS supports, 0.3::DOUBLE + l_tax * 7 AS weight, l_suppkey AS supplier_key,
    l_partkey || '|' || l_suppkey AS fp
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"""

# White space characters as text for trim(x, WS).
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"

A1 = """
a1 AS (
  SELECT 'document-' || doc_id AS artifact_id, 'document' AS source_type, 'doc://' || source || '/' || doc_id AS source_uri, 'Document ' || doc_id AS title, text AS body, source AS author FROM documents
  UNION ALL SELECT 'web_page-' || page_id, 'web_page', url, 'Page ' || page_id, html, '' FROM pages
  UNION ALL SELECT 'slack_message-' || conv_id || '-' || turn, 'slack_message', 'chat://' || conv_id || '-' || turn, 'Message ' || conv_id || '-' || turn, text, role FROM conversations)"""


def _pages_markdown() -> str:
    t = "regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>|<!--.*?-->', '', 'g')"
    for level in range(1, 7):
        t = f"regexp_replace({t}, '(?i)<h{level}\\b[^>]*>', chr(10) || chr(10) || '{'#' * level} ', 'g')"
    t = f"regexp_replace({t}, '(?i)<li\\b[^>]*>', chr(10) || '- ', 'g')"
    t = f"regexp_replace({t}, '(?i)<br\\s*/?>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?i)</?(p|div|h[1-6]|ul|ol|table|tr|article|section|nav|footer)\\b[^>]*>', chr(10) || chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{ref}', '{char}')"
    return f"trim(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS})"


PAGES_MD = f"md AS (SELECT page_id, url AS source_uri, {_pages_markdown()} AS markdown FROM pages)"
MARKED = "string_split(regexp_replace({0}, '(?m)^(#{{1,4}})\\s+(.+)$', chr(57344) || '\\0', 'g'), chr(57344))"


def sections_sql(table: str, key: str, text: str, preamble: str, name: str) -> str:
    """CTE of sections (key, pos, heading, content) of ``table``."""
    return f"""
{name}_parts AS (
  SELECT {key}, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos, len(parts) AS n
  FROM (SELECT {key}, {MARKED.format(text)} AS parts FROM {table})),
{name} AS (
  SELECT {key}, pos, CASE WHEN n = 1 THEN '' WHEN pos = 0 THEN '{preamble}' ELSE trim(regexp_extract(part, '(?m)^(#{{1,4}})\\s+(.+)$', 2), {WS}) END AS heading,
    trim(part, {WS}) AS content FROM {name}_parts WHERE trim(part, {WS}) <> '')"""
