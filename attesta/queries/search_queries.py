"""Search, coverage, relations, change log and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import dates
from attesta.functions import render as R
from attesta.functions import score as SC
from attesta.functions import text as X
from attesta.operators import changelog as CL
from attesta.operators import ledger, search, semantic
from attesta.plans import views as V
from attesta.plans.ordered import ordered_index
from attesta.plans.sqlrun import run_sql
from attesta.queries.base import C2, LEDGER1, WS, query
from attesta.queries.common import ledger_c1, stamped_c1


@query("claim_search", f"""
WITH {LEDGER1}
SELECT claim_id, natural_language, round(truth_score, 3) AS truth_score, status, knowledge_class, n_supporting AS evidence_count FROM ledger1
WHERE (contains(lower(natural_language), 'status f') OR contains(lower(subject), 'status f') OR contains(lower(object), 'status f'))
ORDER BY ledger1.truth_score DESC, seq LIMIT 20""")
def claim_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best hits in the whole ledger."""
    hits = search.search_claims(ledger_c1(spark, sf_dir), "Status F", limit=20)
    return hits.selectExpr(
        "claim_id", "natural_language", "round(truth_score, 3) AS truth_score", "status", "knowledge_class", "n_supporting AS evidence_count"
    )


@query("entity_claims", f"""
WITH {LEDGER1}
SELECT claim_id, subject, object FROM ledger1 WHERE contains(lower(subject), 'customer#00000012') OR contains(lower(object), 'customer#00000012')""")
def entity_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.claims_by_entity(ledger_c1(spark, sf_dir), "Customer#00000012").select("claim_id", "subject", "object")


@query("similar_claims", f"""
WITH {LEDGER1}
SELECT claim_id, round(truth_score, 6) AS truth_score FROM ledger1 WHERE lower(trim(subject)) = 'customer#000000007' OR lower(object) = 'p'
ORDER BY ledger1.truth_score DESC, seq LIMIT 20""")
def similar_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.similar_claims(ledger_c1(spark, sf_dir), "customer#000000007", "P")
    return hits.selectExpr("claim_id", "round(truth_score, 6) AS truth_score")


LEAST_OVERLAP = 0.25


@query("token_overlap", f"""
WITH t AS (SELECT a.item_id AS a_id, b.doc_id AS b_id, list_distinct(list_filter(string_split_regex(lower(a.text), '\\s+'), lambda w: w <> '')) AS ta,
    list_distinct(list_filter(string_split_regex(lower(b.text), '\\s+'), lambda w: w <> '')) AS tb FROM benchmark a, documents b)
SELECT a_id, b_id, round(len(list_intersect(ta, tb)) / CAST(greatest(len(ta), len(tb)) AS DOUBLE), 6) AS overlap FROM t
WHERE len(list_intersect(ta, tb)) >= {LEAST_OVERLAP} * greatest(len(ta), len(tb)) AND len(list_intersect(ta, tb)) > 0""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items that share a quarter of the larger one's tokens or more: all items are asked for in all documents, through the tokens they share."""
    docs = V.spread(V.table(spark, sf_dir, "documents"))
    return run_sql(
        f"""
        WITH asked AS (SELECT item_id, text, size(tokens) AS n, tokens FROM (SELECT item_id, text, array_distinct({X.words('lower(text)')}) AS tokens FROM @a)),
        found AS (
          SELECT item_id, doc_id, max(i.n) AS na, max(d.n) AS nb, count(*) AS shared
          FROM (SELECT item_id, n, explode(tokens) AS token FROM asked) i
          JOIN (SELECT doc_id, size(tokens) AS n, explode(tokens) AS token FROM (SELECT doc_id, array_distinct({X.words('lower(text)')}) AS tokens FROM @b)) d ON i.token = d.token
          GROUP BY item_id, doc_id)
        SELECT f.item_id AS a_id, f.doc_id AS b_id, round({X.token_overlap('lower(a.text)', 'lower(b.text)')}, 6) AS overlap
        FROM found f JOIN @a a ON f.item_id = a.item_id JOIN @b b ON f.doc_id = b.doc_id WHERE shared >= {LEAST_OVERLAP}D * greatest(na, nb)
        """,
        a=V.table(spark, sf_dir, "benchmark"), b=docs,
    )


@query("claim_coverage", f"""
WITH {LEDGER1}, m AS (SELECT * FROM ledger1 WHERE contains(lower(subject), '00000'))
SELECT count(*) AS total_claims, round(avg(confidence), 3) AS avg_confidence, round(avg(truth_score), 3) AS avg_truth_score,
  count_if(knowledge_class = 'stable') AS n_stable, count_if(knowledge_class = 'process') AS n_process, count_if(knowledge_class = 'tacit') AS n_tacit,
  count_if(knowledge_class = 'stateful') AS n_stateful, (SELECT count(DISTINCT artifact_id) FROM c1 WHERE fp IN (SELECT fp FROM m)) AS source_count FROM m""")
def claim_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, evidence = ledger.add_claims(stamped_c1(spark, sf_dir), V.AS_OF)
    return search.coverage(ledger.decay(claims, V.AS_OF), evidence, "00000")


@query("related_claims", f"""
WITH {LEDGER1}, given AS (SELECT * FROM ledger1 WHERE seq % 97 = 0), names AS (SELECT lower(subject) AS n FROM given UNION SELECT lower(object) FROM given)
SELECT claim_id FROM ledger1 WHERE (lower(subject) IN (SELECT n FROM names) OR lower(object) IN (SELECT n FROM names)) AND claim_id NOT IN (SELECT claim_id FROM given)
ORDER BY truth_score DESC, seq LIMIT 50""")
def related_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ledger_c1(spark, sf_dir)
    return search.related_claims(c, c.where("seq % 97 = 0")).select("claim_id")


@query("claims_for_source", f"""
WITH {LEDGER1} SELECT count(*) AS n FROM ledger1 WHERE fp IN (SELECT fp FROM c1 WHERE contains(source_artifact, 'orders-1996'))""")
def claims_for_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, evidence = ledger.add_claims(stamped_c1(spark, sf_dir), V.AS_OF)
    return run_sql("SELECT count(*) AS n FROM @k", k=search.claims_for_source(evidence, "orders-1996"))


@query("entities_distinct", f"WITH {C2} SELECT subject AS entity FROM c2 UNION SELECT object FROM c2")
def entities_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.entities(V.part_supplier(spark, sf_dir))


@query("claim_oneliner", f"""
WITH {LEDGER1}
SELECT printf('[C:%s] %s | %s | %s (%s, %.2f, %d src)', left(claim_id, 7), subject, predicate, object, knowledge_class, floor(confidence * 100) / 100, n_supporting) AS line FROM ledger1""")
def claim_oneliner(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = R.claim_oneliner("claim_id", "subject", "predicate", "object", "knowledge_class", "floor(confidence * 100) / 100D", "n_supporting")
    return ledger_c1(spark, sf_dir).selectExpr(f"{line} AS line")


@query("claims_block", f"""
WITH {LEDGER1}, r AS (SELECT *, row_number() OVER (ORDER BY truth_score DESC, seq) AS ord FROM ledger1)
SELECT string_agg(left(claim_id, 7) || ' ' || subject, chr(10) ORDER BY ord) FILTER (WHERE ord <= 50) || chr(10) || '... and ' || (count(*) - 50) || ' more' AS block FROM r""")
def claims_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 50 claims as one text, with the number of those left out."""
    c = ledger_c1(spark, sf_dir)
    ranked = run_sql(
        """
        SELECT cast(row_number() OVER (ORDER BY truth_score DESC, seq) AS BIGINT) AS ord, concat(left(claim_id, 7), ' ', subject) AS line, total
        FROM (SELECT t.*, (SELECT count(*) FROM @c) AS total FROM @t t)
        """,
        t=ledger.list_claims(c, limit=50), c=c,
    )
    return search.claims_block(ranked)


WORDS = f"""
c AS (SELECT conv_id * 1000 + turn AS seq, lower(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1]) AS subject, text AS object FROM conversations)"""


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose object is a whole message and whose subject is its first word."""
    return run_sql(
        f"SELECT conv_id * 1000 + turn AS seq, lower({X.words('text')}[0]) AS subject, text AS object, concat('conv-', conv_id) AS source_artifact FROM @c",
        c=V.table(spark, sf_dir, "conversations"),
    )


@query("entity_mentions", f"""
WITH {WORDS}, names AS (SELECT DISTINCT subject AS name FROM c),
pairs AS (SELECT DISTINCT c.subject AS a, n.name AS b FROM c JOIN names n ON contains(lower(c.object), n.name) AND c.subject <> n.name)
SELECT DISTINCT entity, related FROM (SELECT a AS entity, b AS related FROM pairs UNION ALL SELECT b, a FROM pairs)""")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.mentions(_spoken(spark, sf_dir).where("subject IS NOT NULL"))


@query("entity_source_groups", f"""
WITH {WORDS}, e AS (SELECT DISTINCT 'conv-' || (seq // 1000) AS source, subject AS entity FROM c)
SELECT source, entity, count(*) OVER (PARTITION BY source) AS n_entities FROM e""")
def entity_source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations through shared sources, as groups of entities per source."""
    return search.shared_sources(_spoken(spark, sf_dir).where("subject IS NOT NULL"))


@query("entity_related_through_sources", f"""
WITH {WORDS}, e AS (SELECT DISTINCT seq // 1000 AS source, subject AS entity FROM c)
SELECT DISTINCT a.entity, b.entity AS related FROM e a JOIN e b ON a.source = b.source AND a.entity <> b.entity WHERE a.entity = (SELECT min(entity) FROM e)""")
def entity_related_through_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of one asked entity, expanded from the groups."""
    g = search.shared_sources(_spoken(spark, sf_dir).where("subject IS NOT NULL"))
    return search.related_through_sources(g, g.agg({"entity": "min"}).withColumnRenamed("min(entity)", "entity"))


BM25_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS dl, len(list_filter(ws, lambda w: w = 'the')) AS tf0, len(list_filter(ws, lambda w: w = 'elle')) AS tf1, len(list_filter(ws, lambda w: w = 'sch')) AS tf2 FROM d),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count_if(tf0 > 0) AS df0, count_if(tf1 > 0) AS df1, count_if(tf2 > 0) AS df2 FROM t)
SELECT doc_id, round(ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
  + ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * dl / avgdl))
  + ln(1 + (n - df2 + 0.5) / (df2 + 0.5)) * tf2 * 2.2 / (tf2 + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score
FROM t, st WHERE tf0 + tf1 + tf2 > 0"""


@query("search_bm25", BM25_SQL)
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over whole documents for three words."""
    ranked = search.bm25(V.spread(V.table(spark, sf_dir, "documents")), "doc_id", "text", ["the", "elle", "sch"], limit=None)
    return ranked.selectExpr("doc_id", "round(score, 6) AS score")


HYBRID_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS dl, len(list_filter(ws, lambda w: w = 'the')) AS tf0, len(list_filter(ws, lambda w: w = 'elle')) AS tf1 FROM d),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count_if(tf0 > 0) AS df0, count_if(tf1 > 0) AS df1 FROM t),
b AS (SELECT doc_id, round(ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
  + ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM t, st WHERE tf0 + tf1 > 0),
q AS (SELECT arg_min(embedding, vec_id) AS q FROM embeddings),
e AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT q FROM q)::DOUBLE[]) AS sim FROM embeddings),
ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b
  UNION ALL SELECT doc_id, row_number() OVER (ORDER BY round(sim, 6) DESC, doc_id) FROM e)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ranks GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"""


@query("hybrid_search_bm25", HYBRID_SQL)
def hybrid_search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector ranking fused: all documents with a hit by BM25, and all vectors by their nearness to the first vector."""
    words = search.bm25(V.spread(V.table(spark, sf_dir, "documents")), "doc_id", "text", ["the", "elle"], limit=None)
    by_words = ordered_index(words.selectExpr("doc_id", "round(score, 6) AS score"), [], [F.desc("score"), F.col("doc_id")], "rank")
    e = V.table(spark, sf_dir, "embeddings")
    near = run_sql(
        f"SELECT vec_id AS doc_id, round({SC.cosine('embedding', 'q')}, 6) AS sim FROM (SELECT *, (SELECT min_by(embedding, vec_id) FROM @e) AS q FROM @e)", e=e
    )
    by_vector = ordered_index(near, [], [F.desc("sim"), F.col("doc_id")], "rank")
    return search.fuse([by_words, by_vector], "doc_id", limit=20).selectExpr("doc_id", "round(score, 9) AS score")


# --- change log ---

E1 = """
e1 AS (
  SELECT event_id, CASE event_type WHEN 'signup' THEN 'document_added' WHEN 'view' THEN 'claim_added' WHEN 'click' THEN 'claim_merged' WHEN 'purchase' THEN 'claim_promoted' WHEN 'error' THEN 'conflict_detected' ELSE 'gap_detected' END AS change_type,
    ts, 'user-' || user_id AS entity_id, 'app://' || event_type AS source_uri, props AS payload,
    CASE WHEN j > 0 AND event_id % 50 - j >= 0 THEN event_id - j END AS triggered_by
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS j FROM events))"""


@query("changelog_since", f"WITH {E1} SELECT event_id, change_type FROM e1 WHERE ts > TIMESTAMP '2024-01-10' AND change_type IN ('claim_added', 'conflict_detected')")
def changelog_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.change_events(spark, sf_dir)
    return CL.since(e, "2024-01-10", ["claim_added", "conflict_detected"]).select("event_id", "change_type")


@query("changelog_for_source", f"WITH {E1} SELECT event_id, entity_id FROM e1 WHERE source_uri = 'app://purchase'")
def changelog_for_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.for_source(V.change_events(spark, sf_dir), "app://purchase").select("event_id", "entity_id")


@query("changelog_recent", f"WITH {E1} SELECT event_id, change_type FROM e1 ORDER BY event_id DESC LIMIT 50")
def changelog_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.recent(V.change_events(spark, sf_dir)).select("event_id", "change_type")


@query("changelog_recent_minutes", f"""
WITH {E1} SELECT event_id AS seq, ts, change_type, entity_id AS about FROM e1 WHERE ts > TIMESTAMP '2024-01-12' - INTERVAL 600 MINUTE ORDER BY event_id LIMIT 50""")
def changelog_recent_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.recent_minutes(V.change_events(spark, sf_dir), 600, "2024-01-12")


@query("entity_history", f"""
WITH {E1} SELECT event_id AS seq, ts, change_type, left(payload, 120) AS payload FROM e1
WHERE contains(lower(payload), 'user-1') OR contains(lower(entity_id), 'user-1') ORDER BY event_id LIMIT 30""")
def entity_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.entity_history(V.change_events(spark, sf_dir), "User-1")


@query("causal_chain", f"""
WITH RECURSIVE {E1},
t AS (SELECT event_id, event_id AS root_id, 0 AS depth, CAST(event_id AS VARCHAR) AS path FROM e1 WHERE triggered_by IS NULL
      UNION ALL SELECT e.event_id, t.root_id, t.depth + 1, t.path || '/' || e.event_id FROM e1 e JOIN t ON e.triggered_by = t.event_id)
SELECT event_id, root_id, CAST(depth AS BIGINT) AS depth, path FROM t""")
def causal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The causal chain of every event."""
    return CL.lineage(V.change_events(spark, sf_dir)).selectExpr(
        "event_id", "root_id", "cast(depth AS BIGINT) AS depth", "array_join(transform(path, p -> cast(p AS STRING)), '/') AS path"
    )


@query("causal_chain_sizes", f"""
WITH RECURSIVE {E1},
t AS (SELECT event_id, event_id AS root_id, 0 AS depth FROM e1 WHERE triggered_by IS NULL
      UNION ALL SELECT e.event_id, t.root_id, t.depth + 1 FROM e1 e JOIN t ON e.triggered_by = t.event_id)
SELECT root_id, count(*) - 1 AS n_caused, CAST(max(depth) AS BIGINT) AS max_depth FROM t GROUP BY root_id""")
def causal_chain_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(
        "SELECT root_id, count(*) - 1 AS n_caused, cast(max(depth) AS BIGINT) AS max_depth FROM @l GROUP BY root_id",
        l=CL.intervals(V.change_events(spark, sf_dir)),
    )


@query("causal_descendants", f"""
WITH RECURSIVE {E1},
t AS (SELECT event_id, event_id AS root_id, 0 AS depth, [event_id] AS path FROM e1 WHERE triggered_by IS NULL
      UNION ALL SELECT e.event_id, t.root_id, t.depth + 1, list_append(t.path, e.event_id) FROM e1 e JOIN t ON e.triggered_by = t.event_id),
below AS (SELECT above, count(*) - 1 AS n FROM (SELECT unnest(path) AS above FROM t) GROUP BY above)
SELECT t.event_id, root_id, CAST(depth AS BIGINT) AS depth, below.n AS n_below FROM t JOIN below ON t.event_id = below.above""")
def causal_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much every event set off, directly and indirectly, from the width of its interval."""
    return CL.intervals(V.change_events(spark, sf_dir)).selectExpr("event_id", "root_id", "depth", "cast((leave - enter - 1) / 2 AS BIGINT) AS n_below")


HANDLERS = "(VALUES ('audit_log', NULL, NULL, 0), ('conflict_escalation', 'conflict_detected', 'conflict_detected', 0), ('gitlab_mr', 'conflict_detected', 'conflict_detected', 1), ('gitlab_mr', 'claim_added', 'conflict_detected', 0), ('mirror', 'document_added', NULL, 0)) h(handler_name, change_type, only_type, position)"


@query("event_routing", f"""
WITH {E1}
SELECT h.handler_name, e.change_type, count(*) AS n FROM e1 e JOIN {HANDLERS} ON (h.change_type IS NULL OR h.change_type = e.change_type)
WHERE h.only_type IS NULL OR h.only_type = e.change_type GROUP BY ALL""")
def event_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    handlers = spark.sql(f"SELECT * FROM {HANDLERS}")
    return run_sql(
        "SELECT handler_name, change_type, count(*) AS n FROM @r GROUP BY handler_name, change_type",
        r=CL.route(V.change_events(spark, sf_dir), handlers),
    )


def _escalate(delivery: dict) -> str:
    return f"escalated {delivery['change_type']}"


@query("event_handling", f"""
WITH {E1}
SELECT h.handler_name, h.handler_name IN ('audit_log', 'conflict_escalation') AS success, CASE h.handler_name WHEN 'audit_log' THEN 'logged' WHEN 'conflict_escalation' THEN 'escalated ' || e.change_type ELSE 'skipped' END AS action_taken, count(*) AS n
FROM e1 e JOIN {HANDLERS} ON (h.change_type IS NULL OR h.change_type = e.change_type) WHERE h.only_type IS NULL OR h.only_type = e.change_type GROUP BY ALL""")
def event_handling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callbacks registered for two of the handlers, run for every delivery."""
    routed = CL.route(V.change_events(spark, sf_dir), spark.sql(f"SELECT * FROM {HANDLERS}"))
    done = CL.dispatch(routed, {"audit_log": lambda delivery: "logged", "conflict_escalation": _escalate})
    return run_sql("SELECT handler_name, success, action_taken, count(*) AS n FROM @d GROUP BY ALL", d=done)


@query("event_emission", f"""
WITH {C2} SELECT subject AS entity_id, 'claim_added' AS change_type, count(*) AS n, count(DISTINCT object) AS n_objects FROM c2 GROUP BY subject""")
def event_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_added events of all extracted claims, summed per entity."""
    claims = V.part_supplier(spark, sf_dir).selectExpr("subject", "predicate", "object", "'lineitem' AS source_uri")
    return run_sql(
        "SELECT entity_id, change_type, count(*) AS n, count(DISTINCT get_json_object(payload, '$.object')) AS n_objects FROM @e GROUP BY ALL",
        e=CL.claim_events(claims, V.AS_OF),
    )


@query("changelog_counts", f"WITH {E1} SELECT change_type, count(*) AS n, count(triggered_by) AS n_caused FROM e1 GROUP BY change_type")
def changelog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql("SELECT change_type, count(*) AS n, count(triggered_by) AS n_caused FROM @e GROUP BY change_type", e=V.change_events(spark, sf_dir))


# --- vectors ---

VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "embeddings").selectExpr(
        "cast(vec_id AS STRING) AS id", "vec_id AS seq", "embedding",
        "concat('label-', label, '-', vec_id % 170) AS fingerprint", "vec_id", "label",
    )


@query("semantic_best_match", f"""
WITH {VEC}, s AS (SELECT n.vec_id AS new_id, o.vec_id AS old_id, list_cosine_similarity(n.e, o.e) AS sim FROM v n JOIN v o ON n.vec_id % 2 = 1 AND o.vec_id % 2 = 0)
SELECT new_id, arg_max(old_id, sim) AS best_id, round(max(sim), 6) AS similarity FROM s WHERE sim >= 0.40 GROUP BY new_id""")
def semantic_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    found = semantic.best_match(v.where("vec_id % 2 = 1"), v.where("vec_id % 2 = 0"), 0.40)
    return found.selectExpr("cast(id AS BIGINT) AS new_id", "cast(best_id AS BIGINT) AS best_id", "round(best_sim, 6) AS similarity")


# One step of the recursion for each vector in order: it leads unless a leader has its fingerprint or is similar.
LED = f"""
RECURSIVE {VEC},
f AS (SELECT vec_id AS id, e, 'label-' || label || '-' || (vec_id % 170) AS fp, row_number() OVER (ORDER BY vec_id) AS n FROM v),
s AS (SELECT a.id, b.id AS other, a.fp = b.fp AS same, list_cosine_similarity(a.e, b.e) AS sim FROM f a JOIN f b ON b.id < a.id AND (a.fp = b.fp OR list_cosine_similarity(a.e, b.e) >= 0.40)),
near AS (SELECT f.n, f.id, coalesce(list(s.other) FILTER (s.other IS NOT NULL), []) AS others FROM f LEFT JOIN s ON f.id = s.id GROUP BY f.n, f.id),
step AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS led UNION ALL
  SELECT near.n, CASE WHEN list_has_any(led, others) THEN led ELSE list_append(led, near.id) END FROM step JOIN near ON near.n = step.n + 1),
led AS (SELECT unnest(led) AS id FROM step WHERE n = (SELECT max(n) FROM step)),
best AS (SELECT s.id, min(s.other) FILTER (same) AS equal, arg_max(s.other, sim) FILTER (sim >= 0.40) AS nearest, max(sim) FILTER (sim >= 0.40) AS sim FROM s JOIN led ON s.other = led.id GROUP BY s.id),
clusters AS (
  SELECT id, id AS leader_id, 'new' AS how, CAST(NULL AS DOUBLE) AS similarity FROM led UNION ALL
  SELECT f.id, coalesce(equal, nearest), CASE WHEN equal IS NOT NULL THEN 'exact' ELSE 'semantic' END, CASE WHEN equal IS NULL THEN round(sim, 6) END
  FROM f ANTI JOIN led ON f.id = led.id JOIN best ON f.id = best.id)"""


@query("semantic_dedup", f"WITH {LED} SELECT * FROM clusters")
def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader clustering of all vectors in order of arrival."""
    c = semantic.cluster(_vectors(spark, sf_dir), 0.40)
    return c.selectExpr("cast(id AS BIGINT) AS id", "cast(leader_id AS BIGINT) AS leader_id", "how", "round(similarity, 6) AS similarity")


@query("semantic_dedup_counts", f"WITH {LED} SELECT count(*) FILTER (how <> 'new') AS merged_count, count(*) FILTER (how = 'new') AS unique_count FROM clusters")
def semantic_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.dedup_counts(semantic.cluster(_vectors(spark, sf_dir), 0.40))


@query("pairwise_similarity", f"""
WITH {VEC} SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def pairwise_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return run_sql(
        f"SELECT a.vec_id, round({SC.cosine('a.embedding', 'b.embedding')}, 6) AS similarity FROM @v a JOIN @v b ON b.vec_id = a.vec_id + 1", v=v
    )


@query("embedding_coverage", """
SELECT count(*) AS total, count(e.vec_id) AS embedded, round(100.0 * count(e.vec_id) / count(*), 1) AS coverage_pct FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(
        """
        SELECT count(*) AS total, count_if(size(embedding) > 0) AS embedded, round(100D * count_if(size(embedding) > 0) / count(*), 1) AS coverage_pct
        FROM @d d LEFT JOIN @e e ON d.doc_id = e.vec_id
        """,
        d=V.spread(V.table(spark, sf_dir, "documents")), e=V.table(spark, sf_dir, "embeddings"),
    )


# --- functions ---

@query("slugify", f"""
SELECT doc_id, coalesce(nullif(left(regexp_replace(replace(lower(trim(text, {WS})), ' ', '-'), '[^\\p{{L}}\\p{{N}}_-]', '', 'g'), 80), ''), 'unnamed') AS slug FROM documents""")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.spread(V.table(spark, sf_dir, "documents")).selectExpr("doc_id", f"{X.slugify('text')} AS slug")


@query("date_parse", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN ts WHEN 1 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 2 THEN date_trunc('second', ts) - INTERVAL 150 MINUTE
  WHEN 3 THEN date_trunc('second', ts) ELSE NULL END AS parsed FROM events""")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in several ways, parsed back; 'n/a' and free text give NULL."""
    written = V.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """CASE event_id % 6 WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") WHEN 1 THEN date_format(ts, 'yyyy-MM-dd')
           WHEN 2 THEN concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), '+02:30') WHEN 3 THEN concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'Z')
           WHEN 4 THEN 'N/A' ELSE 'next spring' END AS written""",
    )
    return written.selectExpr("event_id", f"{dates.parse_date('written')} AS parsed")


@query("merge_keys", """
SELECT array_to_string(list_sort([lower(c_name), lower(n_name)]), '|') AS pair_key, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def merge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision-cache keys of entity pairs; the order and case of the two names do not matter."""
    return run_sql(
        f"""
        SELECT if(c_custkey % 2 = 0, {X.pair_key('c_name', 'n_name')}, {X.pair_key('upper(n_name)', 'c_name')}) AS pair_key, count(*) AS n
        FROM @c JOIN @n ON c_nationkey = n_nationkey GROUP BY 1
        """,
        c=V.table(spark, sf_dir, "customer"), n=V.table(spark, sf_dir, "nation"),
    )
