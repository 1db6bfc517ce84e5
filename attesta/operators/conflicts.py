"""Conflicts: claims that give one (subject, predicate) different objects, and how they are settled.

The result of detection is the list of conflicting pairs, so its size is that of the answer. Merge claims first (one
claim per distinct object), so that copies never form pairs; hot subjects are spread over a grid of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from attesta import schema as S
from attesta.functions import text as X
from attesta.functions.score import ts
from attesta.plans import skew
from attesta.plans.sqlrun import run_sql
from attesta.session import cut_lineage

SIDE = ["claim_id", "seq", "subject", "predicate", "object", "natural_language", "created_at", "truth_score", "n_supporting"]


def _keyed(claims: DataFrame) -> DataFrame:
    return claims.selectExpr(
        f"{X.conflict_key('subject', 'predicate')} AS ck", f"{X.norm('object')} AS value", *SIDE,
        "coalesce(max_authority, authority) AS best_authority",
    )


def _pairs(left: DataFrame, right: DataFrame, residual: str, similarity: float) -> DataFrame:
    """Pairs (a from ``left``, b from ``right``) with equal key and conflicting objects."""
    a, b = skew.split_pairs(left, right, "ck", "claim_id", "claim_id")
    cols = SIDE + ["best_authority"]
    return run_sql(
        f"""
        SELECT {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}' for c in cols)}, 'contradictory_value' AS conflict_type, 'detector' AS detected_by
        FROM @aa a JOIN @bb b ON a.ck = b.ck AND a._ci = b._ci AND a._cj = b._cj
        WHERE {residual} AND a.value <> b.value AND {X.token_overlap('a.value', 'b.value')} < {similarity}D
        """,
        aa=a, bb=b,
    )


def described(pairs: DataFrame, who: str) -> DataFrame:
    """Add conflict_id, description and score_delta."""
    return pairs.selectExpr(
        "*", "left(sha2(concat_ws('|', least(a_claim_id, b_claim_id), greatest(a_claim_id, b_claim_id)), 256), 16) AS conflict_id",
        f"""concat({who}_subject, ' ', {who}_predicate, ': "', a_object, '" vs "', b_object, '"') AS description""",
        "abs(a_truth_score - b_truth_score) AS score_delta",
    )


def detect_within(claims: DataFrame, similarity: float = S.CONFLICT_SIMILARITY) -> DataFrame:
    """Conflicts inside one set of claims; a is the earlier claim."""
    k = _keyed(claims)
    return described(_pairs(k, k, "a.seq < b.seq", similarity), "a")


def detect(new: DataFrame, existing: DataFrame, similarity: float = S.CONFLICT_SIMILARITY) -> DataFrame:
    """Conflicts between new and existing claims; a is the existing one. An unordered pair is reported once."""
    found = _pairs(_keyed(existing), _keyed(new), "a.claim_id <> b.claim_id", similarity)
    once = run_sql(
        """
        SELECT p.* FROM (SELECT min_by(struct(*), struct(b_seq, a_seq)) AS p FROM @found
          GROUP BY least(a_claim_id, b_claim_id), greatest(a_claim_id, b_claim_id))
        """,
        found=found,
    )
    return described(once, "b")


def conflict_counts(claims: DataFrame, similarity: float = S.CONFLICT_SIMILARITY) -> DataFrame:
    """Per (subject, predicate): claims and distinct objects; linear in the claims whatever the group sizes."""
    return run_sql(
        """
        SELECT ck, sum(n) AS n_claims, count(*) AS n_objects, max(best) AS best_score
        FROM (SELECT ck, value, count(*) AS n, max(truth_score) AS best FROM @k GROUP BY ck, value)
        GROUP BY ck HAVING count(*) > 1
        """,
        k=_keyed(claims),
    )


# strategy -> what the winner of a group has most of; among equals the earliest wins.
_ORDER = {"authority_wins": "best_authority", "recency_wins": "created_at", "majority_wins": "n_supporting", "higher_score": "truth_score"}


def winners(claims: DataFrame, strategy: str = "authority_wins", similarity: float = S.CONFLICT_SIMILARITY, auto_delta: float = S.AUTO_RESOLVE_DELTA) -> DataFrame:
    """Conflicts as groups: one row for each claim that contradicts the winner of its (subject, predicate).

    Every strategy is an order, so the winner is a maximum and the result is linear in the claims: a subject with a million
    values is a million rows, spread over tasks by its size, where pairs would be 5 x 10^11. ``detect_within`` lists the pairs
    for subjects somebody asks for.
    """
    if strategy not in _ORDER:
        raise ValueError(f"Unknown strategy: {strategy}. Valid: {list(_ORDER)}")
    keyed = _keyed(claims)
    best = run_sql(
        f"""
        SELECT ck, n, w.* FROM (
          SELECT ck, count(*) AS n, min(value) <> max(value) AS differ,
            max_by(struct(claim_id AS winner_id, value AS winner_value, truth_score AS winner_score), struct({_ORDER[strategy]}, -seq)) AS w
          FROM @k GROUP BY ck) WHERE differ
        """,
        k=keyed,
    )
    met = skew.salted_lookup(keyed, best, "ck", "n", "claim_id")
    return run_sql(
        f"""
        SELECT ck, winner_id, claim_id AS loser_id, abs(truth_score - winner_score) AS confidence, abs(truth_score - winner_score) >= {auto_delta}D AS auto
        FROM @m WHERE value <> winner_value AND {X.token_overlap('value', 'winner_value')} < {similarity}D
        """,
        m=met,
    )


# strategy -> (a wins, rationale of the winner w over the loser l); a tie goes to a. The texts of the rationales are fixed values.
_RULES = {
    "authority_wins": (
        "a_best_authority >= b_best_authority",
        "format_string(\"Authority: %.3f vs %.3f. Claim '%s' from higher-authority source wins.\", {w}_best_authority, {l}_best_authority, {w}_object)",
    ),
    "recency_wins": (
        "a_created_at >= b_created_at",
        "format_string(\"Recency: '%s' is newer (%s vs %s).\", {w}_object, cast(cast({w}_created_at AS DATE) AS STRING), cast(cast({l}_created_at AS DATE) AS STRING))",
    ),
    "majority_wins": (
        "a_n_supporting >= b_n_supporting",
        "format_string(\"Majority: '%s' has %d vs %d supporting sources.\", {w}_object, {w}_n_supporting, {l}_n_supporting)",
    ),
    "higher_score": (
        "a_truth_score >= b_truth_score",
        "format_string(\"Score: %.3f vs %.3f. Claim '%s' has higher composite truth score.\", {w}_truth_score, {l}_truth_score, {w}_object)",
    ),
}


def resolve(
    pairs: DataFrame, as_of: str, strategy: str = "authority_wins", auto_delta: float = S.AUTO_RESOLVE_DELTA, handler: str | None = None
) -> DataFrame:
    """One resolution per pair: decided by the strategy when the scores are far enough apart, else pending.

    Scores are those of the pairs, before any of these resolutions takes effect; ``resolve_in_order`` lets each
    decision see the ones before it. ``handler`` names the one pending pairs are escalated to.
    """
    if strategy not in _RULES:
        raise ValueError(f"Unknown strategy: {strategy}. Valid: {list(_RULES)}")
    a_wins, why = _RULES[strategy]
    waiting = f"manual:{handler}" if handler else "manual:pending"
    return run_sql(
        f"""
        SELECT conflict_id, auto, if(auto, if(a_wins, a_claim_id, b_claim_id), null) AS winner_id,
          if(auto, if(a_wins, b_claim_id, a_claim_id), null) AS loser_id,
          if(auto, 'auto:{strategy}', 'manual:pending') AS strategy_used, score_delta AS confidence,
          if(auto, 'auto:{strategy}', '{waiting}') AS resolved_by, {ts(as_of)} AS resolved_at,
          if(auto, if(a_wins, {why.format(w='a', l='b')}, {why.format(w='b', l='a')}),
            format_string('Score delta %.3f below auto-threshold {auto_delta}. Requires manual review.', score_delta)) AS rationale,
          a_claim_id, b_claim_id, a_subject, b_subject, a_truth_score, b_truth_score, description, a_seq, b_seq
        FROM (SELECT *, score_delta >= {auto_delta}D AS auto, {a_wins} AS a_wins FROM @pairs)
        """,
        pairs=pairs,
    )


_FOLD = "ck string, a_seq long, b_seq long, a_claim_id string, b_claim_id string, a_truth_score double, b_truth_score double"


def _folding(auto_delta: float):
    """Adds the links that both claims have before each pair, and whether the pair links them; rows come sorted by (ck, a_seq, b_seq).

    What is remembered is one number for each linked claim of one group; pairs stream through.
    """
    power = [1.0]

    def lowered(score: float | None, n: int) -> float | None:
        while len(power) <= n:
            power.append(S.CONFLICT_FACTOR ** len(power))
        return None if score is None else score * power[n]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, links = None, {}
        for batch in batches:
            a_links, b_links = [], []
            for ck, _, _, a, b, a_score, b_score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ck != group:
                    group, links = ck, {}
                m, n = links.get(a, 0), links.get(b, 0)
                a_links.append(m)
                b_links.append(n)
                x, y = lowered(a_score, m), lowered(b_score, n)
                if x is not None and y is not None and abs(x - y) >= auto_delta:
                    links[a], links[b] = m + 1, n + 1
            columns = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(a_links, pa.int32()), pa.array(b_links, pa.int32())], ["ck", "a_seq", "b_seq", "a_claim_id", "b_claim_id", "a_links", "b_links"])

    return fold


def resolve_in_order(
    pairs: DataFrame, as_of: str, strategy: str = "authority_wins", auto_delta: float = S.AUTO_RESOLVE_DELTA
) -> DataFrame:
    """Resolve pairs in (a_seq, b_seq) order per (subject, predicate), each decision seeing the conflict links of earlier ones.

    One pass: the pairs of a group are sorted on their way to one task and folded there; the links of a claim lower its score by 0.9 each before
    later pairs look at it. Claims of other groups share no links, so groups do not wait for each other.
    """
    keyed = cut_lineage(run_sql(f"SELECT *, {X.conflict_key('a_subject', 'a_predicate')} AS ck FROM @pairs", pairs=pairs))
    narrow = keyed.select([c.split()[0] for c in _FOLD.split(", ")]).repartition("ck").sortWithinPartitions("ck", "a_seq", "b_seq", "a_claim_id", "b_claim_id")
    folded = narrow.mapInArrow(_folding(auto_delta), "ck string, a_seq long, b_seq long, a_claim_id string, b_claim_id string, a_links int, b_links int")
    now = run_sql(
        f"""
        SELECT * EXCEPT (a_truth_score, b_truth_score, score_delta, a_now, b_now), a_now AS a_truth_score, b_now AS b_truth_score, abs(a_now - b_now) AS score_delta
        FROM (
          SELECT p.*, a_truth_score * pow({S.CONFLICT_FACTOR}D, a_links) AS a_now, b_truth_score * pow({S.CONFLICT_FACTOR}D, b_links) AS b_now
          FROM @p p JOIN @f f ON p.a_claim_id = f.a_claim_id AND p.b_claim_id = f.b_claim_id)
        """,
        p=keyed.drop("ck"), f=folded.select("a_claim_id", "b_claim_id", "a_links", "b_links"),
    )
    out = resolve(now, as_of, strategy, auto_delta)
    # an automatic resolution is recorded after its own link lowered both scores
    return run_sql(
        f"SELECT * EXCEPT (confidence), if(auto, confidence * {S.CONFLICT_FACTOR}D, confidence) AS confidence FROM @out", out=out
    )


def effects(resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger changes of automatic resolutions: conflict pairs (a_id, b_id) and supersede pairs (old_id, new_id, ord)."""
    auto = resolutions.where("auto")
    return (
        auto.selectExpr("winner_id AS a_id", "loser_id AS b_id"),
        auto.selectExpr("loser_id AS old_id", "winner_id AS new_id", "struct(a_seq, b_seq) AS ord"),
    )


def resolution_events(resolutions: DataFrame) -> DataFrame:
    """The conflict_detected event of each resolution."""
    return run_sql(
        """
        SELECT 'conflict_detected' AS change_type, resolved_at AS ts, if(auto AND winner_id = b_claim_id, b_subject, a_subject) AS entity_id,
          '' AS source_uri, 'conflict_resolver' AS agent,
          if(auto, to_json(named_struct('resolution', 'auto', 'strategy', substring(strategy_used, 6), 'winner', winner_id, 'loser', loser_id, 'rationale', rationale)),
            to_json(named_struct('resolution', 'manual_pending', 'description', description, 'claim_a', a_claim_id, 'claim_b', b_claim_id))) AS payload
        FROM @r
        """,
        r=resolutions,
    )


def resolutions_from_events(events: DataFrame, as_of: str) -> DataFrame:
    """A pending resolution for each conflict event."""
    return run_sql(
        f"""
        SELECT cast(event_id AS STRING) AS conflict_id, cast(null AS STRING) AS winner_id, cast(null AS STRING) AS loser_id,
          'manual:pending' AS strategy_used, 0D AS confidence, 'manual:pending' AS resolved_by, {ts(as_of)} AS resolved_at,
          concat('Conflict from event: ', coalesce(get_json_object(payload, '$.description'), '')) AS rationale
        FROM @e WHERE change_type = 'conflict_detected'
        """,
        e=events,
    )


def list_resolutions(res: DataFrame, strategy: str | None = None, resolved_by: str | None = None, limit: int | None = 50) -> DataFrame:
    """Newest first; ``strategy`` is compared whole, ``resolved_by`` as a part."""
    if strategy:
        res = res.where(res["strategy_used"] == strategy)
    if resolved_by:
        res = res.where(res["resolved_by"].contains(resolved_by))
    out = res.orderBy(res["resolved_at"].desc(), res["conflict_id"].asc())
    return out if limit is None else out.limit(limit)


def latest_resolution(res: DataFrame, order: str = "seq") -> DataFrame:
    """The last recorded resolution of each conflict."""
    return run_sql(f"SELECT r.* FROM (SELECT max_by(struct(*), {order}) AS r FROM @res GROUP BY conflict_id)", res=res)


def resolution_stats(res: DataFrame) -> DataFrame:
    return run_sql(
        "SELECT count(*) AS total, count_if(winner_id IS NULL) AS pending, count_if(winner_id IS NOT NULL) AS auto_resolved FROM @res", res=res
    )
