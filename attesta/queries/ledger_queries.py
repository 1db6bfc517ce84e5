"""Ledger queries: scores, merge, promotion, decay, reads, retraction and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.functions import score as SC
from attesta.operators import authority, ledger
from attesta.plans import views as V
from attesta.plans.sqlrun import run_sql
from attesta.queries.base import C1, C2, LEDGER1, query
from attesta.queries.common import ledger_c1, stamped_c1


@query("claim_truth_score", f"""
WITH {C2}
SELECT claim_id, round(confidence * CASE WHEN supports THEN weight ELSE 0.5 END * CASE WHEN supports THEN 0.25 ELSE 0.0 END
  * CASE WHEN supports THEN 1.0 ELSE 0.7 END, 6) AS truth_score,
  CAST(supports AS BIGINT) AS n_supporting, CAST(NOT supports AS BIGINT) AS n_refuting
FROM c2""")
def claim_truth_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = SC.evidence_counts("evidence")
    score = SC.truth_score("evidence", "confidence", "authority", "recency", "array()")
    return V.part_supplier(spark, sf_dir).selectExpr(
        "claim_id", f"round({score}, 6) AS truth_score", f"{n['n_supporting']} AS n_supporting", f"{n['n_refuting']} AS n_refuting"
    )


@query("claim_exact_dedup", f"""
WITH {C1}
SELECT fp AS fingerprint, arg_min(claim_id, seq) AS claim_id, arg_min(subject, seq) AS subject, round(max(confidence), 6) AS confidence,
  count(*) AS n_claims, count(*) AS n_supporting, count(DISTINCT artifact_id) AS n_sources, max(weight) AS max_authority
FROM c1 GROUP BY fp""")
def claim_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, _ = ledger.add_claims(stamped_c1(spark, sf_dir), V.AS_OF)
    return claims.selectExpr(
        "fingerprint", "claim_id", "subject", "round(confidence, 6) AS confidence", "n_claims", "n_supporting", "n_sources", "max_authority"
    )


PREFIX_SQL = f"""
WITH {C2},
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY fp, artifact_id ORDER BY seq) = 1 AS is_new FROM c2),
running AS (
  SELECT fp, seq, claim_id,
    max(confidence) OVER w AS conf,
    sum(CASE WHEN is_new AND supports THEN 1 ELSE 0 END) OVER w AS n_sup,
    sum(CASE WHEN is_new AND NOT supports THEN 1 ELSE 0 END) OVER w AS n_ref,
    max(CASE WHEN is_new AND supports THEN weight END) OVER w AS auth
  FROM firsts WINDOW w AS (PARTITION BY fp ORDER BY seq ROWS UNBOUNDED PRECEDING)),
judged AS (
  SELECT *, n_sup >= 2 AS corroborated,
    coalesce(auth >= 0.8, FALSE) OR conf * coalesce(auth, 0.5) * least(1.0, n_sup * 0.25) * pow(0.7, n_ref) >= 0.15 AS lifted
  FROM running),
final AS (
  SELECT fp, arg_min(claim_id, seq) AS claim_id, count(*) AS n_claims, max(n_sup) AS n_supporting, max(n_ref) AS n_refuting,
    CASE WHEN bool_or(corroborated) THEN 'corroborated' WHEN bool_or(lifted) THEN 'unverified' ELSE 'candidate' END AS status
  FROM judged GROUP BY fp)
"""


@query("claim_promotion_prefix", PREFIX_SQL + """
SELECT claim_id, n_claims, CAST(n_supporting AS BIGINT) AS n_supporting, CAST(n_refuting AS BIGINT) AS n_refuting, status FROM final""")
def claim_promotion_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, _ = ledger.add_claims(V.part_supplier(spark, sf_dir), V.AS_OF)
    return claims.select("claim_id", "n_claims", "n_supporting", "n_refuting", "status")


@query("claim_promotion_stats", PREFIX_SQL + "SELECT status, count(*) AS n FROM final GROUP BY status")
def claim_promotion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, _ = ledger.add_claims(V.part_supplier(spark, sf_dir), V.AS_OF)
    return ledger.counts_by(claims, "status")


@query("claim_decay", f"""
WITH {LEDGER1}
SELECT claim_id, knowledge_class, recency, decayed FROM ledger1""")
def claim_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_c1(spark, sf_dir).select("claim_id", "knowledge_class", "recency", "decayed")


AS_OF_VALID = "1999-06-15 00:00:00"


@query("claims_as_of_valid", f"""
WITH {C2}
SELECT knowledge_class, supplier_key % 10 AS supplier_group, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM c2
WHERE valid_from <= TIMESTAMP '{AS_OF_VALID}' AND (valid_until IS NULL OR valid_until >= TIMESTAMP '{AS_OF_VALID}')
GROUP BY ALL""")
def claims_as_of_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that hold at a point in valid time."""
    c = V.part_supplier(spark, sf_dir).selectExpr("*", "confidence AS truth_score")
    held = ledger.list_claims(c, limit=None, as_of_valid=AS_OF_VALID)
    return run_sql("SELECT knowledge_class, supplier_key % 10 AS supplier_group, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM @c GROUP BY ALL", c=held)


@query("claims_as_of_transaction", f"""
WITH {C2}
SELECT claim_id, subject, object, round(confidence, 6) AS confidence FROM c2 WHERE created_at <= TIMESTAMP '1996-03-01'""")
def claims_as_of_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims the system knew at a point in transaction time."""
    c = V.part_supplier(spark, sf_dir).selectExpr("*", "confidence AS truth_score")
    return ledger.list_claims(c, limit=None, as_of_transaction="1996-03-01 00:00:00").selectExpr("claim_id", "subject", "object", "round(confidence, 6) AS confidence")


@query("claims_by_status_topk", f"""
WITH {LEDGER1}
SELECT claim_id, status, round(truth_score, 6) AS truth_score FROM ledger1 WHERE status = 'unverified'
ORDER BY ledger1.truth_score DESC, seq LIMIT 50""")
def claims_by_status_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ledger.list_claims(ledger_c1(spark, sf_dir), status="unverified", limit=50)
    return top.selectExpr("claim_id", "status", "round(truth_score, 6) AS truth_score")


@query("authority_lookup", f"""
WITH {C1}
SELECT claim_id, author, segment, weight AS source_authority,
  CASE WHEN author = '1-URGENT' AND segment = 'BUILDING' THEN 0.95 WHEN author = '2-HIGH' AND segment = 'MACHINERY' THEN 0.4
       WHEN author = '5-LOW' AND segment = 'BUILDING' THEN 0.7 ELSE weight END::DOUBLE AS topic_authority
FROM c1""")
def authority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = V.authority_registry(spark)
    flat = authority.lookup(V.customer_status(spark, sf_dir).select("claim_id", "author", "segment"), reg, "author")
    return authority.lookup(flat, reg, "author", topic="segment", out="topic_authority")


@query("authority_registry_update", """
SELECT source, topic, weight FROM (VALUES
  ('1-URGENT', '_default', 1.0), ('2-HIGH', '_default', 0.8), ('3-MEDIUM', '_default', 0.6),
  ('2-HIGH', 'MACHINERY', 0.4), ('1-URGENT', 'BUILDING', 0.95)) t(source, topic, weight)
UNION ALL SELECT s_name, '_default', CAST(least(1.0, greatest(0.0, s_acctbal / 10000.0)) AS DOUBLE) FROM supplier""")
def authority_registry_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry after upserts (clamped to 0..1) from the suppliers and the removal of one source."""
    changes = run_sql(
        "SELECT s_name AS source, cast(null AS STRING) AS topic, s_acctbal / 10000D AS weight FROM @s UNION ALL SELECT '1-URGENT', null, 1.5D",
        s=V.table(spark, sf_dir, "supplier"),
    )
    return authority.remove(authority.set_weights(V.authority_registry(spark), changes), "5-LOW")


@query("retract_artifact", f"""
WITH {C2},
kept AS (
  SELECT *, row_number() OVER (PARTITION BY fp, artifact_id ORDER BY seq) = 1 AS is_new FROM c2),
flipped AS (SELECT *, supports AND CAST(artifact_id AS BIGINT) % 13 <> 0 AS now_supports FROM kept WHERE is_new)
SELECT min_claim AS claim_id, f.n_supporting, f.n_refuting, f.n_retracted,
  round(conf * coalesce(auth, 0.5) * least(1.0, f.n_supporting * 0.25) * pow(0.7, f.n_refuting) + 1e-9, 6) AS truth_score
FROM (SELECT fp, count_if(now_supports) AS n_supporting, count_if(NOT now_supports) AS n_refuting, count_if(supports AND NOT now_supports) AS n_retracted,
        max(CASE WHEN now_supports THEN weight END) AS auth FROM flipped GROUP BY fp) f
JOIN (SELECT fp, arg_min(claim_id, seq) AS min_claim, max(confidence) AS conf FROM c2 GROUP BY fp) c USING (fp)
WHERE f.n_retracted > 0""")
def retract_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims weakened by the retraction of every thirteenth order."""
    claims, evidence = ledger.add_claims(V.part_supplier(spark, sf_dir), V.AS_OF)
    gone = V.table(spark, sf_dir, "lineitem").where("l_orderkey % 13 = 0").selectExpr("cast(l_orderkey AS STRING) AS artifact_id")
    after, _ = ledger.retract(claims, evidence, gone)
    return after.where("n_retracted > 0").selectExpr("claim_id", "n_supporting", "n_refuting", "n_retracted", "round(truth_score + 1e-9, 6) AS truth_score")


SUPERSEDE_PAIRS = """
  SELECT arg_max(claim_id, seq) AS new_id, arg_min(claim_id, seq) AS old_id FROM ledger1 GROUP BY lower(trim(subject)) HAVING count(*) > 1"""


@query("supersede_apply", f"""
WITH {LEDGER1}, pairs AS ({SUPERSEDE_PAIRS})
SELECT claim_id, CASE WHEN d.old_id IS NOT NULL THEN 'superseded' ELSE status END AS status, d.new_id AS superseded_by, u.old_id AS supersedes
FROM ledger1 LEFT JOIN pairs d ON claim_id = d.old_id LEFT JOIN pairs u ON claim_id = u.new_id""")
def supersede_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first status claim of each customer is superseded by the last one; one pair names an unknown claim."""
    c = ledger_c1(spark, sf_dir)
    pairs = run_sql(
        """
        SELECT max_by(claim_id, seq) AS new_id, min_by(claim_id, seq) AS old_id, max(seq) AS ord FROM @c
        GROUP BY lower(trim(subject)) HAVING count(*) > 1
        UNION ALL SELECT 'c1-unknown', min(claim_id), 0L FROM @c
        """,
        c=c,
    )
    return ledger.supersede(c, pairs).select("claim_id", "status", "superseded_by", "supersedes")


@query("conflict_links", f"""
WITH {LEDGER1}, pairs AS ({SUPERSEDE_PAIRS}), links AS (SELECT new_id AS id FROM pairs UNION ALL SELECT old_id FROM pairs)
SELECT claim_id, CAST(CASE WHEN id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_conflicts,
  round(truth_score * CASE WHEN id IS NULL THEN 1.0 ELSE 0.9 END, 6) AS truth_score
FROM ledger1 LEFT JOIN links ON claim_id = id""")
def conflict_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric conflict links lower the score of both claims; repeated links count once."""
    c = ledger_c1(spark, sf_dir)
    pairs = run_sql(
        """
        WITH p AS (SELECT max_by(claim_id, seq) AS a_id, min_by(claim_id, seq) AS b_id FROM @c GROUP BY lower(trim(subject)) HAVING count(*) > 1)
        SELECT a_id, b_id FROM p UNION ALL SELECT b_id, a_id FROM p
        """,
        c=c,
    )
    out = ledger.with_conflict_counts(c, ledger.conflict_links(c, pairs))
    return out.selectExpr("claim_id", "n_conflicts", "round(truth_score, 6) AS truth_score")


@query("manual_promote", f"""
WITH {LEDGER1}
SELECT claim_id, CASE WHEN knowledge_class = 'stable' THEN 'canonical' WHEN knowledge_class = 'stateful' THEN 'rejected' ELSE status END AS status,
  CASE WHEN knowledge_class = 'stable' THEN TIMESTAMP '2002-01-01' ELSE last_confirmed_at END AS last_confirmed_at FROM ledger1""")
def manual_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ledger_c1(spark, sf_dir)
    changes = c.where("knowledge_class IN ('stable', 'stateful')").selectExpr(
        "claim_id", "if(knowledge_class = 'stable', 'canonical', 'rejected') AS new_status"
    )
    return ledger.set_status(c, changes, V.AS_OF).select("claim_id", "status", "last_confirmed_at")


@query("promote_all", f"""
WITH {C1},
merged AS (SELECT fp, arg_min(claim_id, seq) AS claim_id, max(confidence) AS confidence, count(*) AS n, max(weight) AS w FROM c1 GROUP BY fp)
SELECT claim_id, CASE WHEN n >= 3 THEN 'corroborated' WHEN w >= 0.95 OR confidence * w * least(1.0, n * 0.25) >= 0.4 THEN 'unverified' ELSE 'candidate' END AS status,
  n >= 3 OR w >= 0.95 OR confidence * w * least(1.0, n * 0.25) >= 0.4 AS promoted
FROM merged""")
def promote_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One promotion pass with stricter thresholds over candidates."""
    strict = ledger.Promotion(score=9.0, authority=9.0, sources=10**9)
    claims, _ = ledger.add_claims(stamped_c1(spark, sf_dir), V.AS_OF, rule=strict)
    out = ledger.promote_all(claims, V.AS_OF, ledger.Promotion(score=0.4, authority=0.95, sources=3))
    return out.select("claim_id", "status", "promoted")


@query("ledger_upsert", f"""
WITH {C1}
SELECT fp AS fingerprint, arg_min(claim_id, seq) AS claim_id, count(*) AS n_supporting, round(max(confidence), 6) AS confidence,
  CASE WHEN count(*) >= 2 THEN 'corroborated' WHEN max(weight) >= 0.8 OR max(confidence) * max(weight) * 0.25 >= 0.15 THEN 'unverified' ELSE 'candidate' END AS status
FROM c1 GROUP BY fp""")
def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored ledger of the older half, then the newer half on top: the same as adding everything in order."""
    c = stamped_c1(spark, sf_dir)
    cut = c.agg({"seq": "max"}).withColumnRenamed("max(seq)", "m").selectExpr("m div 2 AS m").scalar()
    base = ledger.add_claims(c.where(c["seq"] < cut), V.AS_OF)
    claims, _ = ledger.add_claims(c.where(c["seq"] >= cut), V.AS_OF, base=base)
    return claims.selectExpr("fingerprint", "claim_id", "n_supporting", "round(confidence, 6) AS confidence", "status")


@query("ledger_delete", f"""
WITH {LEDGER1}
SELECT status, count(*) AS n FROM ledger1 WHERE NOT (knowledge_class = 'tacit' AND status <> 'corroborated') GROUP BY status""")
def ledger_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ledger_c1(spark, sf_dir)
    gone = c.where("knowledge_class = 'tacit' AND status <> 'corroborated'").select("claim_id")
    return ledger.counts_by(c.join(gone, "claim_id", "left_anti"), "status")


@query("stats_by_status", f"WITH {LEDGER1} SELECT status, count(*) AS n FROM ledger1 GROUP BY status")
def stats_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.counts_by(ledger_c1(spark, sf_dir), "status")


@query("stats_by_class", f"WITH {LEDGER1} SELECT knowledge_class, count(*) AS n FROM ledger1 GROUP BY knowledge_class")
def stats_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.counts_by(ledger_c1(spark, sf_dir), "knowledge_class")


@query("brain_stats", f"""
WITH {LEDGER1}
SELECT count(*) AS total_claims, round(avg(truth_score), 3) AS avg_truth_score, (SELECT count(*) FROM orders) AS total_episodes FROM ledger1""")
def brain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(
        "SELECT s.*, (SELECT count(*) FROM @o) AS total_episodes FROM @s s",
        s=ledger.stats(ledger_c1(spark, sf_dir)), o=V.table(spark, sf_dir, "orders"),
    )


@query("active_claims", f"""
WITH {LEDGER1}, pairs AS ({SUPERSEDE_PAIRS})
SELECT knowledge_class, count(*) AS n FROM ledger1 WHERE claim_id NOT IN (SELECT old_id FROM pairs) GROUP BY knowledge_class""")
def active_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ledger_c1(spark, sf_dir)
    pairs = run_sql(
        """SELECT max_by(claim_id, seq) AS new_id, min_by(claim_id, seq) AS old_id, max(seq) AS ord FROM @c
           GROUP BY lower(trim(subject)) HAVING count(*) > 1""",
        c=c,
    )
    return ledger.counts_by(ledger.active(ledger.supersede(c, pairs)), "knowledge_class")
