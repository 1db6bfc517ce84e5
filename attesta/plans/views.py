"""Claim views over the operational tables: the deterministic stand-in for model-based extraction.

Each view has the columns the operators expect. ``seq`` gives the order of arrival; where no single column does, it is
a struct of the columns that do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.functions import text as X
from attesta.plans.sqlrun import run_sql

AS_OF = "2002-01-01 00:00:00"

# Trust per order priority; '4-NOT SPECIFIED' is not registered and falls back to 0.5.
PRIORITY_WEIGHT = {"1-URGENT": 0.9, "2-HIGH": 0.8, "3-MEDIUM": 0.6, "5-LOW": 0.3}
# Topic weights of the same registry.
PRIORITY_TOPIC_WEIGHT = {("1-URGENT", "BUILDING"): 0.95, ("2-HIGH", "MACHINERY"): 0.4, ("5-LOW", "BUILDING"): 0.7}
# Market segment -> knowledge class; part type -> knowledge class; event type -> change type.
SEGMENT_CLASS = {
    "BUILDING": "stable", "AUTOMOBILE": "process", "MACHINERY": "tacit", "FURNITURE": "stateful", "HOUSEHOLD": "process",
}
TYPE_CLASS = {"ECONOMY": "stable", "SMALL": "process", "MEDIUM": "tacit", "PROMO": "stateful", "STANDARD": "process"}
EVENT_CHANGE = {
    "signup": "document_added", "view": "claim_added", "click": "claim_merged", "purchase": "claim_promoted",
    "error": "conflict_detected",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly expressions over a small table: a scan with fewer splits than cores is dealt out.

    A table of any size has more splits than that and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pick(x: str, mapping: dict[str, str], default: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {x} {cases} ELSE '{default}' END"


def authority_registry(spark: SparkSession) -> DataFrame:
    """The registry as rows (source, topic, weight); topic ``_default`` holds for every other topic."""
    rows = [(s, "_default", w) for s, w in PRIORITY_WEIGHT.items()]
    rows += [(s, t, w) for (s, t), w in PRIORITY_TOPIC_WEIGHT.items()]
    values = ", ".join(f"('{s}', '{t}', {w}D)" for s, t, w in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(source, topic, weight)")


# Columns a freshly extracted claim starts with.
NEW_CLAIM = f"""
    {X.fingerprint('subject', 'predicate', 'object')} AS fingerprint,
    0.5D AS authority, 1.0D AS recency, 0.5D AS specificity, 'candidate' AS status, 'default' AS group_id,
    cast(null AS TIMESTAMP_NTZ) AS last_confirmed_at, 0L AS n_conflicts,
    cast(null AS STRING) AS superseded_by, cast(null AS STRING) AS supersedes"""


def one_evidence(artifact: str, supports: str, source: str, author: str, authority: str, span: str, at: str) -> str:
    return (
        f"array(named_struct('artifact_id', {artifact}, 'episode_id', '', 'supports', {supports}, 'source_span', {span}, "
        f"'source_artifact', {source}, 'author', {author}, 'author_role', '', 'source_authority', {authority}, 'recorded_at', {at}))"
    )


def customer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, one claim per order: <customer> 'has order status' <status>. Case and spaces vary with the order key."""
    ev = one_evidence(
        "cast(o_orderkey AS STRING)", "true", "concat('orders-', year(o_orderdate))", "o_orderpriority", "0.5D", "''", "o_orderdate"
    )
    return run_sql(
        f"""
        SELECT *, {NEW_CLAIM}, created_at AS valid_from, cast(null AS TIMESTAMP_NTZ) AS valid_until FROM (
          SELECT o_orderkey AS seq, concat('c1-', o_orderkey) AS claim_id,
            CASE o_orderkey % 3 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) ELSE concat('  ', lower(c_name), ' ') END AS subject,
            'has order status' AS predicate, o_orderstatus AS object,
            concat(c_name, ' has order status ', o_orderstatus) AS natural_language,
            least(0.95D, 0.2D + o_totalprice / 500000D) AS confidence,
            {pick('c_mktsegment', SEGMENT_CLASS, 'process')} AS knowledge_class,
            o_orderdate AS created_at, {ev} AS evidence, o_orderpriority AS author, c_mktsegment AS segment
          FROM @orders JOIN @customer ON o_custkey = c_custkey)
        """,
        orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"),
    )


PART_SUPPLIER_ORDER = "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate)"


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2, one claim per line item: part 'supplied by' supplier; a returned line refutes it."""
    ev = one_evidence(
        "cast(l_orderkey AS STRING)", "l_returnflag <> 'R'", "''", "concat('supplier:', l_suppkey)", "0.3D + l_tax * 7", "''", "l_shipdate"
    )
    return run_sql(
        f"""
        SELECT *, {NEW_CLAIM}, concat(subject, ' is supplied by ', object) AS natural_language FROM (
          SELECT {PART_SUPPLIER_ORDER} AS seq,
            concat_ws('-', 'c2', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd')) AS claim_id,
            concat('part:', l_partkey) AS subject, 'supplied by' AS predicate, concat('supplier:', l_suppkey) AS object,
            0.3D + l_discount * 5 AS confidence, {pick('p_type', TYPE_CLASS, 'process')} AS knowledge_class,
            l_shipdate AS created_at, l_shipdate AS valid_from,
            if(l_linestatus = 'F', l_shipdate + make_dt_interval(cast(l_quantity AS INT)), null) AS valid_until,
            {ev} AS evidence, l_suppkey AS supplier_key
          FROM @lineitem LEFT JOIN @part ON l_partkey = p_partkey)
        """,
        lineitem=spread(table(spark, sf_dir, "lineitem")), part=table(spark, sf_dir, "part"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: documents, pages and conversation turns as one artifact table."""
    return run_sql(
        """
        SELECT concat('document-', doc_id) AS artifact_id, 'document' AS source_type, concat('doc://', source, '/', doc_id) AS source_uri,
          concat('Document ', doc_id) AS title, text AS body, source AS author FROM @documents
        UNION ALL
        SELECT concat('web_page-', page_id), 'web_page', url, concat('Page ', page_id), html, '' FROM @pages
        UNION ALL
        SELECT concat_ws('-', 'slack_message', conv_id, turn), 'slack_message', concat('chat://', conv_id, '-', turn),
          concat('Message ', conv_id, '-', turn), text, role FROM @conversations
        """,
        documents=table(spark, sf_dir, "documents"), pages=table(spark, sf_dir, "pages"),
        conversations=table(spark, sf_dir, "conversations"),
    )


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1: the event stream as change log; parents form a forest of bounded depth."""
    return run_sql(
        f"""
        SELECT event_id, event_id AS seq, {pick('event_type', EVENT_CHANGE, 'gap_detected')} AS change_type, ts,
          concat('user-', user_id) AS entity_id, concat('app://', event_type) AS source_uri, props AS payload,
          if(j > 0 AND event_id % 50 - j >= 0, event_id - j, null) AS triggered_by, 'app' AS agent, value
        FROM (SELECT *, cast(get_json_object(props, '$.k') AS BIGINT) % 7 AS j FROM @events)
        """,
        events=table(spark, sf_dir, "events"),
    )


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as Markdown: the sectioned text the chunk and diff operators work on."""
    return spread(table(spark, sf_dir, "pages")).selectExpr(
        "page_id", "url AS source_uri", f"{X.html_to_markdown('html')} AS markdown"
    )
