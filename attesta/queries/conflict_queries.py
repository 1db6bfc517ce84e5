"""Conflict queries: detection, the four strategies, resolutions and claim diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.operators import claim_diff as D
from attesta.operators import conflicts, ledger
from attesta.plans import views as V
from attesta.plans.sqlrun import run_sql
from attesta.queries.base import C1, LEDGER1, query
from attesta.queries.common import ledger_c1, stamped_c1

PAIRS_SQL = LEDGER1 + """,
pairs AS (
  SELECT a.seq AS a_seq, b.seq AS b_seq, a.claim_id AS a_id, b.claim_id AS b_id, a.subject AS a_subject, b.subject AS b_subject, a.object AS a_object, b.object AS b_object,
    a.max_authority AS a_auth, b.max_authority AS b_auth, a.created_at AS a_at, b.created_at AS b_at,
    a.n_supporting AS a_n, b.n_supporting AS b_n, a.truth_score AS a_score, b.truth_score AS b_score,
    abs(a.truth_score - b.truth_score) AS delta, a.subject || ' ' || a.predicate || ': "' || a.object || '" vs "' || b.object || '"' AS description
  FROM ledger1 a JOIN ledger1 b ON lower(trim(a.subject)) = lower(trim(b.subject)) AND a.predicate = b.predicate AND a.seq < b.seq
  WHERE lower(a.object) <> lower(b.object))"""


@query("conflict_detect_within", f"WITH {PAIRS_SQL} SELECT a_id, b_id, description, round(delta, 6) AS score_delta FROM pairs")
def conflict_detect_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.detect_within(ledger_c1(spark, sf_dir)).selectExpr(
        "a_claim_id AS a_id", "b_claim_id AS b_id", "description", "round(score_delta, 6) AS score_delta"
    )


@query("conflict_detect_new_vs_existing", f"""
WITH {C1},
old AS (SELECT fp, arg_min(claim_id, seq) AS claim_id, arg_min(subject, seq) AS subject, arg_min(object, seq) AS object FROM c1 WHERE created_at < TIMESTAMP '1998-01-01' GROUP BY fp),
new AS (SELECT fp, arg_min(claim_id, seq) AS claim_id, arg_min(subject, seq) AS subject, arg_min(object, seq) AS object FROM c1 WHERE created_at >= TIMESTAMP '1998-01-01' GROUP BY fp)
SELECT o.claim_id AS existing_id, n.claim_id AS new_id, n.subject || ' has order status: "' || o.object || '" vs "' || n.object || '"' AS description
FROM old o JOIN new n ON lower(trim(o.subject)) = lower(trim(n.subject)) WHERE lower(o.object) <> lower(n.object)""")
def conflict_detect_new_vs_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stamped_c1(spark, sf_dir)
    old, _ = ledger.add_claims(c.where("created_at < TIMESTAMP_NTZ '1998-01-01'"), V.AS_OF)
    new, _ = ledger.add_claims(c.where("created_at >= TIMESTAMP_NTZ '1998-01-01'"), V.AS_OF)
    return conflicts.detect(new, old).selectExpr("a_claim_id AS existing_id", "b_claim_id AS new_id", "description")


@query("conflict_counts", f"""
WITH {LEDGER1}
SELECT lower(trim(subject)) || '|' || predicate AS ck, count(*) AS n_claims, count(DISTINCT lower(object)) AS n_objects, round(max(truth_score), 6) AS best_score
FROM ledger1 GROUP BY 1 HAVING count(DISTINCT lower(object)) > 1""")
def conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.conflict_counts(ledger_c1(spark, sf_dir)).selectExpr("ck", "n_claims", "n_objects", "round(best_score, 6) AS best_score")


def _register_winners(short: str, strategy: str, order: str) -> None:
    @query(f"conflict_winners_{short}", f"""
WITH {LEDGER1},
k AS (SELECT *, lower(trim(subject)) || '|' || predicate AS ck, lower(object) AS value FROM ledger1),
w AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY {order} DESC, seq) AS no FROM k WHERE ck IN (SELECT ck FROM k GROUP BY ck HAVING count(DISTINCT value) > 1))
SELECT l.ck, w.claim_id AS winner_id, l.claim_id AS loser_id, round(abs(l.truth_score - w.truth_score), 6) AS confidence, abs(l.truth_score - w.truth_score) >= 0.3 AS auto
FROM w l JOIN w ON l.ck = w.ck AND w.no = 1 WHERE l.value <> w.value""")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = conflicts.winners(ledger_c1(spark, sf_dir), strategy)
        return found.selectExpr("ck", "winner_id", "loser_id", "round(confidence, 6) AS confidence", "auto")


for _args in (
    ("authority", "authority_wins", "max_authority"), ("recency", "recency_wins", "created_at"),
    ("majority", "majority_wins", "n_supporting"), ("score", "higher_score", "truth_score"),
):
    _register_winners(*_args)


def _resolve_sql(strategy: str, a_wins: str) -> str:
    return f"""
WITH {PAIRS_SQL}
SELECT a_id, b_id, CASE WHEN delta >= 0.3 THEN CASE WHEN {a_wins} THEN a_id ELSE b_id END END AS winner_id,
  CASE WHEN delta >= 0.3 THEN CASE WHEN {a_wins} THEN b_id ELSE a_id END END AS loser_id,
  CASE WHEN delta >= 0.3 THEN 'auto:{strategy}' ELSE 'manual:pending' END AS resolved_by, round(delta, 6) AS confidence
FROM pairs"""


def _register(short: str, strategy: str, a_wins: str) -> None:
    @query(f"conflict_resolve_{short}", _resolve_sql(strategy, a_wins))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = conflicts.detect_within(ledger_c1(spark, sf_dir))
        return conflicts.resolve(pairs, V.AS_OF, strategy).selectExpr(
            "a_claim_id AS a_id", "b_claim_id AS b_id", "winner_id", "loser_id", "resolved_by", "round(confidence, 6) AS confidence"
        )


_register("authority", "authority_wins", "a_auth >= b_auth")
_register("recency", "recency_wins", "a_at >= b_at")
_register("majority", "majority_wins", "a_n >= b_n")
_register("score", "higher_score", "a_score >= b_score")


@query("conflict_rationale", f"""
WITH {PAIRS_SQL}
SELECT a_id, b_id, CASE WHEN delta < 0.3 THEN 'pending'
  WHEN a_n >= b_n THEN 'Majority: ''' || a_object || ''' has ' || a_n || ' vs ' || b_n || ' supporting sources.'
  ELSE 'Majority: ''' || b_object || ''' has ' || b_n || ' vs ' || a_n || ' supporting sources.' END AS rationale
FROM pairs""")
def conflict_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = conflicts.detect_within(ledger_c1(spark, sf_dir))
    return conflicts.resolve(pairs, V.AS_OF, "majority_wins").selectExpr(
        "a_claim_id AS a_id", "b_claim_id AS b_id", "if(auto, rationale, 'pending') AS rationale"
    )


@query("conflict_resolve_in_order", f"""
WITH RECURSIVE {PAIRS_SQL},
numbered AS (SELECT *, lower(trim(a_subject)) AS g, row_number() OVER (PARTITION BY lower(trim(a_subject)) ORDER BY a_seq, b_seq) AS k FROM pairs),
fold AS (
  SELECT g, 0::BIGINT AS k, []::VARCHAR[] AS linked, NULL::VARCHAR AS a_id, NULL::VARCHAR AS b_id, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM numbered WHERE k = 1
  UNION ALL
  SELECT g, k, CASE WHEN abs(x - y) >= 0.3 THEN list_concat(linked, [a_id, b_id]) ELSE linked END, a_id, b_id, x, y FROM (
    SELECT n.g, n.k, f.linked, n.a_id, n.b_id, a_score * pow(0.9, len(list_filter(f.linked, lambda i: i = n.a_id))) AS x, b_score * pow(0.9, len(list_filter(f.linked, lambda i: i = n.b_id))) AS y
    FROM fold f JOIN numbered n ON n.g = f.g AND n.k = f.k + 1))
SELECT a_id, b_id, CASE WHEN abs(x - y) >= 0.3 THEN CASE WHEN x >= y THEN a_id ELSE b_id END END AS winner_id, CASE WHEN abs(x - y) >= 0.3 THEN CASE WHEN x >= y THEN b_id ELSE a_id END END AS loser_id,
  CASE WHEN abs(x - y) >= 0.3 THEN 'auto:higher_score' ELSE 'manual:pending' END AS resolved_by, round(abs(x - y) * CASE WHEN abs(x - y) >= 0.3 THEN 0.9 ELSE 1 END, 6) AS confidence
FROM fold WHERE k > 0""")
def conflict_resolve_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential resolution: each decision sees the links of the ones before."""
    pairs = conflicts.detect_within(ledger_c1(spark, sf_dir))
    return conflicts.resolve_in_order(pairs, V.AS_OF, "higher_score").selectExpr(
        "a_claim_id AS a_id", "b_claim_id AS b_id", "winner_id", "loser_id", "resolved_by", "round(confidence, 6) AS confidence"
    )


@query("conflict_effects", f"""
WITH {PAIRS_SQL},
auto AS (SELECT CASE WHEN a_score >= b_score THEN a_id ELSE b_id END AS w, CASE WHEN a_score >= b_score THEN b_id ELSE a_id END AS l FROM pairs WHERE delta >= 0.3),
links AS (SELECT w AS id, count(*) AS n FROM (SELECT w FROM auto UNION ALL SELECT l FROM auto) GROUP BY w)
SELECT claim_id, CASE WHEN claim_id IN (SELECT l FROM auto) THEN 'superseded' ELSE status END AS status, coalesce(n, 0) AS n_conflicts
FROM ledger1 LEFT JOIN links ON claim_id = id""")
def conflict_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after automatic resolutions: links counted, losers superseded."""
    c = ledger_c1(spark, sf_dir)
    links, supersede = conflicts.effects(conflicts.resolve(conflicts.detect_within(c), V.AS_OF, "higher_score"))
    out = ledger.supersede(ledger.with_conflict_counts(c, ledger.conflict_links(c, links)), supersede)
    return out.select("claim_id", "status", "n_conflicts")


@query("resolution_events", f"""
WITH {PAIRS_SQL}
SELECT CASE WHEN delta >= 0.3 AND a_score < b_score THEN b_subject ELSE a_subject END AS entity_id,
  CASE WHEN delta >= 0.3 THEN 'auto' ELSE 'manual_pending' END AS resolution, count(*) AS n FROM pairs GROUP BY ALL""")
def resolution_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change events resolutions emit, by entity and kind."""
    res = conflicts.resolve(conflicts.detect_within(ledger_c1(spark, sf_dir)), V.AS_OF, "higher_score")
    return run_sql(
        "SELECT entity_id, get_json_object(payload, '$.resolution') AS resolution, count(*) AS n FROM @e GROUP BY ALL",
        e=conflicts.resolution_events(res),
    )


def _resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resolution table: two rounds of resolution of the same conflicts."""
    pairs = conflicts.detect_within(ledger_c1(spark, sf_dir))
    return run_sql(
        "SELECT *, a_seq AS seq, 1 AS round FROM @x UNION ALL SELECT *, b_seq + 10000000, 2 FROM @y WHERE b_seq % 2 = 0",
        x=conflicts.resolve(pairs, V.AS_OF, "authority_wins"), y=conflicts.resolve(pairs, V.AS_OF, "recency_wins", auto_delta=0.1),
    )


TWO_ROUNDS = PAIRS_SQL + """,
res AS (
  SELECT a_id, b_id, 1 AS round, CASE WHEN delta >= 0.3 THEN CASE WHEN a_auth >= b_auth THEN a_id ELSE b_id END END AS winner_id,
    CASE WHEN delta >= 0.3 THEN 'auto:authority_wins' ELSE 'manual:pending' END AS resolved_by FROM pairs
  UNION ALL
  SELECT a_id, b_id, 2, CASE WHEN delta >= 0.1 THEN CASE WHEN a_at >= b_at THEN a_id ELSE b_id END END,
    CASE WHEN delta >= 0.1 THEN 'auto:recency_wins' ELSE 'manual:pending' END FROM pairs WHERE CAST(substr(b_id, 4) AS BIGINT) % 2 = 0)"""


@query("resolution_stats", f"""
WITH {TWO_ROUNDS}
SELECT count(*) AS total, count_if(winner_id IS NULL) AS pending, count_if(winner_id IS NOT NULL) AS auto_resolved FROM res""")
def resolution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.resolution_stats(_resolutions(spark, sf_dir))


@query("resolution_latest", f"""
WITH {TWO_ROUNDS}
SELECT a_id, b_id, max(round) AS round, arg_max(resolved_by, round) AS resolved_by FROM res GROUP BY a_id, b_id""")
def resolution_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = conflicts.latest_resolution(_resolutions(spark, sf_dir))
    return latest.selectExpr("a_claim_id AS a_id", "b_claim_id AS b_id", "round", "resolved_by")


@query("resolution_filter", f"""
WITH {TWO_ROUNDS}
SELECT round, count(*) AS n FROM res WHERE resolved_by LIKE '%recency%' GROUP BY round""")
def resolution_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conflicts.list_resolutions(_resolutions(spark, sf_dir), resolved_by="recency", limit=None)
    return run_sql("SELECT round, count(*) AS n FROM @r GROUP BY round", r=found)


DIFF_SQL = f"""
WITH {C1},
old AS (SELECT fp, arg_max(claim_id, seq) AS id, arg_max(natural_language, seq) AS nl, arg_max(confidence, seq) AS conf, arg_max(knowledge_class, seq) AS k
        FROM c1 WHERE created_at < TIMESTAMP '1998-07-01' GROUP BY fp),
new AS (SELECT fp, arg_max(claim_id, seq) AS id, arg_max(natural_language, seq) AS nl, arg_max(confidence, seq) AS conf, arg_max(knowledge_class, seq) AS k
        FROM c1 WHERE created_at >= TIMESTAMP '1998-07-01' GROUP BY fp),
diff AS (
  SELECT coalesce(o.fp, n.fp) AS fingerprint, o.id AS old_id, n.id AS new_id,
    CASE WHEN o.fp IS NULL OR n.fp IS NULL THEN ''
         ELSE concat_ws(',', CASE WHEN o.nl <> n.nl THEN 'natural_language' END, CASE WHEN abs(o.conf - n.conf) > 0.05 THEN 'confidence' END,
                CASE WHEN o.k <> n.k THEN 'knowledge_class' END) END AS changed_fields,
    o.fp IS NULL AS is_added, n.fp IS NULL AS is_removed
  FROM old o FULL JOIN new n ON o.fp = n.fp),
kinds AS (SELECT *, CASE WHEN is_added THEN 'added' WHEN is_removed THEN 'removed' WHEN changed_fields <> '' THEN 'modified' ELSE 'unchanged' END AS change FROM diff)
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = V.customer_status(spark, sf_dir)
    return c.where("created_at < TIMESTAMP_NTZ '1998-07-01'"), c.where("created_at >= TIMESTAMP_NTZ '1998-07-01'")


def _claim_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.claim_diff(*_sides(spark, sf_dir))


@query("affected_subjects", DIFF_SQL + """
SELECT subject, count(*) AS n FROM kinds JOIN c1 ON claim_id = coalesce(new_id, old_id) WHERE change <> 'unchanged' GROUP BY subject""")
def affected_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _sides(spark, sf_dir)
    return D.affected_subjects(D.claim_diff(*sides), *sides)


@query("claim_diff", DIFF_SQL + "SELECT fingerprint, old_id, new_id, change, changed_fields FROM kinds")
def claim_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claim_diff(spark, sf_dir).selectExpr("fingerprint", "old_id", "new_id", "change", "array_join(changed_fields, ',') AS changed_fields")


@query("claim_diff_summary", DIFF_SQL + """
SELECT '+' || count_if(change = 'added') || ' new, -' || count_if(change = 'removed') || ' removed, ~' || count_if(change = 'modified') || ' modified' AS summary,
  count_if(change = 'unchanged') AS n_unchanged, TRUE AS has_changes FROM kinds""")
def claim_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff_summary(_claim_diff(spark, sf_dir)).select("summary", "n_unchanged", "has_changes")
