"""The claim ledger: merge of equal claims, promotion, decay, retraction, links and bi-temporal reads.

A ledger is two tables. ``claims`` has one row per surviving claim with counts over its evidence; ``evidence`` has one
row per kept piece of evidence, keyed by the claim's ``merge_key``. A claim backed by a third of all artifacts is then
many evidence rows, never one giant array. All counts are partial aggregates, so such a claim costs no more per task.
"""

from __future__ import annotations

import math

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta import schema as S
from attesta.functions import score as SC
from attesta.functions.score import ts
from attesta.plans import skew
from attesta.plans.sqlrun import run_sql
from attesta.session import cut_lineage

CLAIM_FIELDS = [
    "seq", "claim_id", "subject", "predicate", "object", "natural_language", "confidence", "authority", "recency",
    "specificity", "status", "knowledge_class", "created_at", "valid_from", "valid_until", "last_confirmed_at",
    "group_id", "n_conflicts", "fingerprint", "superseded_by", "supersedes",
]
OWN_FIELDS = ["own_sup", "own_ref", "own_auth", "own_sources", "own_first_sup", "own_first_ref"]
PIECE_FIELDS = ["artifact_id", "source_artifact", "source_span"]
EVIDENCE_FIELDS = ["supports", "source_authority", "source_artifact", "author", "source_span", "recorded_at"]
INACTIVE = "('superseded', 'rejected')"
KEY_BUCKETS = 65_536  # hashes of merge keys that are counted to find large keys

@dataclass(frozen=True)
class Promotion:
    score: float = S.PROMOTE_SCORE
    authority: float = S.PROMOTE_AUTHORITY
    sources: int = S.PROMOTE_SOURCES

    @property
    def refuters(self) -> int:
        """A refuting source multiplies the score by 0.7: after so many no score can reach the threshold."""
        return math.floor(math.log(min(self.score, 1.0)) / math.log(0.7)) + 1 if self.score > 0 else 0


def _own_counts() -> str:
    """Counts over a claim's evidence; most claims arrive with one piece, which is looked at without passes over arrays."""
    own = SC.evidence_counts("evidence")
    firsts = "filter(evidence, (e, i) -> array_position(transform(evidence, x -> x.artifact_id), e.artifact_id) = i + 1)"
    named = "evidence[0].artifact_id IS NOT NULL"
    counts = {
        "own_sup": ("if(evidence[0].supports, 1L, 0L)", own["n_supporting"]),
        "own_ref": ("if(NOT evidence[0].supports, 1L, 0L)", own["n_refuting"]),
        "own_auth": ("if(evidence[0].supports, evidence[0].source_authority, null)", own["max_authority"]),
        "own_sources": ("if(evidence[0].supports, 1L, 0L)", own["n_sources"]),
        "own_first_sup": (f"if({named} AND evidence[0].supports, 1L, 0L)", f"cast(size(filter({firsts}, e -> e.supports)) AS BIGINT)"),
        "own_first_ref": (f"if({named} AND NOT evidence[0].supports, 1L, 0L)", f"cast(size(filter({firsts}, e -> NOT e.supports)) AS BIGINT)"),
    }
    return ", ".join(f"if(size(evidence) = 1, {one}, {many}) AS {name}" for name, (one, many) in counts.items())


def arrivals(claims: DataFrame, merge_key: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """Split arriving claims (short nested evidence) into claim rows with own counts and evidence rows."""
    rows = run_sql(f"SELECT {merge_key} AS merge_key, {', '.join(CLAIM_FIELDS)}, {_own_counts()} FROM @claims", claims=claims)
    evidence = run_sql(
        f"""
        SELECT merge_key, seq, claim_id, pos, e.artifact_id, {', '.join('e.' + f for f in EVIDENCE_FIELDS)}
        FROM (SELECT {merge_key} AS merge_key, seq, claim_id, posexplode(evidence) AS (pos, e) FROM @claims)
        """,
        claims=claims,
    )
    return rows, evidence


def as_base(claims: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stored ledger as the first part of the next merge: its evidence counts as each claim's own."""
    oldest = "cast(-9223372036854775808 AS BIGINT) AS seq"
    return claims.select("merge_key", *CLAIM_FIELDS, *OWN_FIELDS), evidence.selectExpr(
        "merge_key", oldest, "claim_id", "pos", "artifact_id", *EVIDENCE_FIELDS
    )


def _steps(rule: Promotion) -> str:
    return (
        f"old_status IN ('candidate', 'unverified') AND n_sources >= {rule.sources} AS corroborated, "
        f"coalesce(max_authority >= {rule.authority}D, false) OR truth_score >= {rule.score}D AS lifted"
    )


def merge(rows: DataFrame, evidence: DataFrame, as_of: str, rule: Promotion = Promotion()) -> tuple[DataFrame, DataFrame]:
    """Fold claims with one ``merge_key`` into the earliest, as if added one by one in ``seq`` order.

    Evidence of a later claim is kept when its artifact is new to the group; confidence is the maximum; the last merge
    sets the confirmation time; the status is promoted after every addition. Returns (claims, evidence).
    """
    first = run_sql(
        f"""
        SELECT merge_key, artifact_id, f.*, seq0 FROM (
          SELECT merge_key, artifact_id, min_by(struct(claim_id, pos, {', '.join(EVIDENCE_FIELDS)}), struct(seq, pos)) AS f, min(seq) AS seq0
          FROM @evidence GROUP BY merge_key, artifact_id)
        """,
        evidence=evidence,
    )
    kept_fields = ", ".join(f"r.{c}" for c in CLAIM_FIELDS if c not in ("confidence", "status", "last_confirmed_at"))
    merged = cut_lineage(run_sql(
        f"""
        WITH per_claim AS (
          SELECT merge_key, seq0, count_if(supports) AS sup, count_if(NOT supports) AS ref, max(if(supports, source_authority, null)) AS auth
          FROM @first GROUP BY merge_key, seq0),
        totals AS (
          SELECT merge_key, sum(sup) AS first_sup, sum(ref) AS first_ref, max(auth) AS first_auth,
            max_by(sup, seq0) AS newest_sup, max(seq0) AS newest_seq, min(seq0) AS oldest_seq
          FROM per_claim GROUP BY merge_key),
        grouped AS (
          SELECT merge_key, min_by(struct({', '.join(CLAIM_FIELDS + OWN_FIELDS)}), seq) AS r,
            max_by(struct(last_confirmed_at), seq).last_confirmed_at AS last_time,
            max(seq) AS last_seq, max(confidence) AS max_conf, count(*) AS n_claims
          FROM @rows GROUP BY merge_key),
        joined AS (
          SELECT g.merge_key, {kept_fields}, max_conf AS confidence, r.status AS old_status, r.last_confirmed_at AS root_time,
            r.own_sup AS root_sup, r.own_ref AS root_ref, r.own_auth AS root_auth,
            n_claims, last_time, last_seq, newest_seq, oldest_seq, coalesce(newest_sup, 0L) AS newest_sup,
            coalesce(first_sup, 0L) AS first_sup, coalesce(first_ref, 0L) AS first_ref,
            r.own_sup + coalesce(first_sup, 0L) - r.own_first_sup AS n_supporting,
            r.own_ref + coalesce(first_ref, 0L) - r.own_first_ref AS n_refuting,
            r.own_sources + coalesce(first_sup, 0L) - r.own_first_sup AS n_sources,
            greatest(r.own_auth, first_auth) AS max_authority
          FROM grouped g LEFT JOIN totals t ON g.merge_key = t.merge_key),
        scored AS (SELECT *, {SC.LEDGER_SCORE} AS truth_score FROM joined)
        SELECT *, {_steps(rule)} FROM scored
        """,
        rows=rows, first=first,
    ))
    # The score can pass the threshold and fall again once refuting evidence arrives: look at earlier moments too.
    open_groups = merged.where("NOT corroborated AND old_status = 'candidate' AND NOT lifted AND n_claims > 1")
    if open_groups.isEmpty():
        judged = merged.selectExpr("*", "false AS passed")
    else:
        passed = passed_earlier(open_groups, rows, first, rule)
        judged = run_sql(
            "SELECT m.*, p.passed FROM @merged m LEFT JOIN @passed p ON m.merge_key = p.merge_key", merged=merged, passed=passed
        )
    return _settled(judged.withColumn("newest_last", judged["newest_seq"] == judged["last_seq"]), as_of, rule), first.withColumnRenamed("seq0", "seq")


def with_first_piece(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with ``first_piece``: artifact, source and span of their earliest evidence, null where there is none."""
    return run_sql(
        f"""
        SELECT c.*, f.first_piece FROM @c c LEFT JOIN (
          SELECT merge_key, min_by(struct({', '.join(PIECE_FIELDS)}), struct(seq, pos)) AS first_piece FROM @e GROUP BY merge_key) f ON c.merge_key = f.merge_key
        """,
        c=claims, e=evidence,
    )


def _settled(judged: DataFrame, as_of: str, rule: Promotion, *more: str) -> DataFrame:
    """Claim rows from groups whose counts, score and steps on the ladder are known."""
    names = [c for c in CLAIM_FIELDS if c not in ("status", "last_confirmed_at")]
    return run_sql(
        f"""
        SELECT merge_key, {', '.join(names)}, n_claims, n_supporting, n_refuting, n_sources, max_authority, truth_score,
          CASE WHEN corroborated THEN 'corroborated'
               WHEN old_status = 'candidate' AND (lifted OR coalesce(passed, false)) THEN 'unverified' ELSE old_status END AS status,
          -- the step to corroborated stamps the time too; a merge stamps the newcomer's time, else now
          CASE WHEN corroborated AND (n_claims = 1 OR (newest_last AND n_sources - newest_sup < {rule.sources})) THEN {ts(as_of)}
               WHEN n_claims > 1 THEN coalesce(last_time, {ts(as_of)}) ELSE root_time END AS last_confirmed_at,
          n_supporting AS own_sup, n_refuting AS own_ref, max_authority AS own_auth, n_sources AS own_sources,
          {', '.join(['first_sup AS own_first_sup', 'first_ref AS own_first_ref', *more])}
        FROM @judged
        """,
        judged=judged,
    )


def passed_earlier(open_groups: DataFrame, rows: DataFrame, first: DataFrame, rule: Promotion) -> DataFrame:
    """Groups (merge_key, passed) whose score reached the threshold at some point before the last addition.

    Between two refuting pieces of evidence the score only grows, so the end of each such segment decides. The first
    ``rule.refuters`` refuting rows per group bound the segments, since after them no score reaches the threshold: the ranked
    filter keeps that many rows per key before the shuffle. No window ever spans a whole group, only its few segments.
    """
    lookup = run_sql(
        f"""
        WITH ranked AS (
          SELECT merge_key, seq0, row_number() OVER (PARTITION BY merge_key ORDER BY seq0) AS rank FROM @first WHERE NOT supports),
        bounds AS (
          SELECT merge_key, collect_list(seq0) AS bounds FROM ranked WHERE rank <= {rule.refuters} GROUP BY merge_key)
        SELECT o.merge_key, n_claims, authority, recency, n_conflicts, oldest_seq, seq AS root_seq, root_sup, root_ref, root_auth, bounds
        FROM @open o LEFT JOIN bounds b ON o.merge_key = b.merge_key
        """,
        first=first, open=open_groups,
    )
    events = run_sql(
        """
        SELECT merge_key, seq, confidence, 0 AS sup, cast(null AS DOUBLE) AS auth FROM @rows
        UNION ALL SELECT merge_key, seq0, null, 1, source_authority FROM @first WHERE supports
        """,
        rows=rows, first=first,
    )
    placed = skew.salted_lookup(events, lookup, "merge_key", "n_claims", "seq")
    score = SC.truth_score_from_counts(
        "conf", "if(segment >= 0, greatest(root_auth, auth), null)", "authority", "recency",
        "if(segment >= 0, root_sup + sup, 0L)", "if(segment >= 0, root_ref + segment, 0L)", "n_conflicts",
    )
    constants = ["authority", "recency", "n_conflicts", "root_sup", "root_ref", "root_auth"]
    return run_sql(
        f"""
        WITH located AS (
          SELECT *, CASE WHEN oldest_seq IS NULL OR seq < oldest_seq THEN -1
                    ELSE coalesce(size(filter(bounds, b -> b > root_seq AND b <= seq)), 0) END AS segment FROM @placed),
        segments AS (
          SELECT merge_key, segment, max(confidence) AS conf, sum(if(seq > root_seq, sup, 0)) AS sup,
            max(if(seq > root_seq, auth, null)) AS auth, {', '.join(f'max({c}) AS {c}' for c in constants)}
          FROM located GROUP BY merge_key, segment),
        so_far AS (
          SELECT merge_key, segment, max(conf) OVER w AS conf, sum(sup) OVER w AS sup, max(auth) OVER w AS auth, {', '.join(constants)}
          FROM segments WINDOW w AS (PARTITION BY merge_key ORDER BY segment ROWS UNBOUNDED PRECEDING))
        SELECT merge_key, max({score} >= {rule.score}D) AS passed FROM so_far GROUP BY merge_key
        """,
        placed=placed,
    )


def large_keys(claims: DataFrame) -> DataFrame | None:
    """The merge keys (merge_key) with more than ``skew.ROWS_PER_TASK`` pieces of evidence; None if there is none.

    Counted by ``KEY_BUCKETS`` hashes first, which moves next to nothing; only keys in heavy buckets are counted one by one.
    """
    bucket = f"pmod(xxhash64(merge_key), {KEY_BUCKETS})"
    sized = claims.selectExpr("merge_key", f"{bucket} AS bucket", "greatest(coalesce(size(evidence), 0), 1) AS n")
    heavy = cut_lineage(run_sql(f"SELECT bucket FROM @s GROUP BY bucket HAVING sum(n) > {skew.ROWS_PER_TASK}", s=sized))
    if heavy.isEmpty():
        return None
    keys = cut_lineage(run_sql(
        f"SELECT merge_key FROM @s s LEFT SEMI JOIN @h h ON s.bucket = h.bucket GROUP BY merge_key HAVING sum(n) > {skew.ROWS_PER_TASK}", s=sized, h=heavy
    ))
    return None if keys.isEmpty() else keys


def merge_small(claims: DataFrame, as_of: str, rule: Promotion, first_piece: bool = False) -> tuple[DataFrame, DataFrame]:
    """``merge`` of arriving claims whose keys have few pieces of evidence each: one shuffle by key, then windows in place.

    Every column runs along with its row, so a reader that takes few columns shuffles only those. Counts over a group need no
    order of arrival; after them only the rows go on that can still decide something: the first claim's, the last one's, and all
    of a group with so few sources that what the score was in between matters. Rows are sorted by a hash of the key first.
    """
    own = _own_counts()
    pieces = run_sql(
        f"""
        SELECT merge_key, {', '.join(CLAIM_FIELDS + OWN_FIELDS)}, pos, e.artifact_id, {', '.join('e.' + f for f in EVIDENCE_FIELDS)} FROM (
          SELECT merge_key, {', '.join(CLAIM_FIELDS)}, {own}, posexplode_outer(evidence) AS (pos, e) FROM @claims)
        """,
        claims=claims,
    ).repartition("merge_key").selectExpr("*", "xxhash64(merge_key) AS h")
    marked = run_sql(
        "SELECT *, pos IS NOT NULL AND row_number() OVER (PARTITION BY h, merge_key, pos IS NULL, artifact_id ORDER BY seq, pos) = 1 AS is_new FROM @p", p=pieces
    )
    score = SC.truth_score_from_counts("conf", "greatest(root_auth, auth)", "root_authority", "root_recency", "(root_sup + sup)", "(root_ref + ref)", "root_conflicts")
    kept_fields = ", ".join(c for c in CLAIM_FIELDS if c not in ("confidence", "status", "last_confirmed_at"))
    judged = run_sql(
        f"""
        WITH counted AS (
          SELECT *, min(seq) OVER whole AS root_seq, max(seq) OVER whole AS last_seq, count_if(coalesce(pos, 0) = 0) OVER whole AS n_claims,
            max(confidence) OVER whole AS max_conf, max_by(last_confirmed_at, seq) OVER whole AS last_time,
            count_if(new_sup) OVER whole AS first_sup, count_if(new_ref) OVER whole AS first_ref, max(if(new_sup, source_authority, null)) OVER whole AS first_auth,
            min_by(struct({', '.join(PIECE_FIELDS)}), if(pos IS NULL, null, struct(seq, pos))) OVER whole AS first_piece
          FROM (SELECT *, is_new AND supports AS new_sup, is_new AND NOT supports AS new_ref FROM @m) WINDOW whole AS (PARTITION BY h, merge_key)),
        -- a group has at least first_sup sources; with enough of them it is corroborated, whatever its score was on the way
        deciding AS (
          SELECT *, seq <=> root_seq AS is_root, seq <=> last_seq AS is_last FROM counted
          WHERE seq <=> root_seq OR seq <=> last_seq OR first_sup < {rule.sources}),
        running AS (
          SELECT *, row_number() OVER w AS no, count_if(new_sup AND is_last) OVER whole AS newest_sup, max(is_new AND is_last) OVER whole AS newest_last,
            -- what is known after each claim: rows of one seq are peers
            max(confidence) OVER so_far AS conf, count_if(new_sup AND NOT is_root) OVER so_far AS sup, count_if(new_ref AND NOT is_root) OVER so_far AS ref,
            max(if(new_sup AND NOT is_root, source_authority, null)) OVER so_far AS auth, first(own_sup) OVER so_far AS root_sup, first(own_ref) OVER so_far AS root_ref,
            first(own_auth) OVER so_far AS root_auth, first(authority) OVER so_far AS root_authority, first(recency) OVER so_far AS root_recency, first(n_conflicts) OVER so_far AS root_conflicts
          FROM deciding WINDOW w AS (PARTITION BY h, merge_key ORDER BY seq),
            whole AS (PARTITION BY h, merge_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
            so_far AS (PARTITION BY h, merge_key ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        roots AS (
          SELECT * FROM (
            SELECT *, max({score} >= {rule.score}D) OVER (PARTITION BY h, merge_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS reached
            FROM running) WHERE no = 1),
        joined AS (
          SELECT merge_key, {kept_fields}, max_conf AS confidence, status AS old_status, last_confirmed_at AS root_time, n_claims, last_time, newest_last, newest_sup,
            first_sup, first_ref, own_sup + first_sup - own_first_sup AS n_supporting, own_ref + first_ref - own_first_ref AS n_refuting,
            own_sources + first_sup - own_first_sup AS n_sources, greatest(own_auth, first_auth) AS max_authority, reached AND n_claims > 1 AS passed, first_piece
          FROM roots),
        scored AS (SELECT *, {SC.LEDGER_SCORE} AS truth_score FROM joined)
        SELECT *, {_steps(rule)} FROM scored
        """,
        m=marked,
    )
    evidence = run_sql(f"SELECT merge_key, artifact_id, claim_id, pos, {', '.join(EVIDENCE_FIELDS)}, seq FROM @m WHERE is_new", m=marked)
    return _settled(judged, as_of, rule, *(["first_piece"] if first_piece else [])), evidence


def add_claims(
    incoming: DataFrame, as_of: str, base: tuple[DataFrame, DataFrame] | None = None,
    rule: Promotion = Promotion(), merge_key: str = "fingerprint", first_piece: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Add arriving claims to a ledger (or to an empty one). With ``first_piece`` claims say what their earliest evidence is."""
    if base is not None:
        rows, evidence = arrivals(incoming, merge_key)
        old_rows, old_evidence = as_base(*base)
        merged, kept = merge(old_rows.unionByName(rows), old_evidence.unionByName(evidence), as_of, rule)
        return with_first_piece(merged, kept) if first_piece else merged, kept
    keyed = incoming.selectExpr(f"{merge_key} AS merge_key", *CLAIM_FIELDS, "evidence")
    large = large_keys(keyed)
    if large is None:
        return merge_small(keyed, as_of, rule, first_piece)
    same = F.col("k.merge_key").eqNullSafe(F.col("l.merge_key"))
    small, big = (keyed.alias("k").join(large.alias("l"), same, how) for how in ("left_anti", "left_semi"))
    claims, evidence = merge_small(small, as_of, rule, first_piece)
    merged, kept = merge(*arrivals(big, "merge_key"), as_of, rule)
    return claims.unionByName(with_first_piece(merged, kept) if first_piece else merged), evidence.unionByName(kept)


def rescored(df: DataFrame) -> DataFrame:
    return run_sql(f"SELECT * EXCEPT (truth_score), {SC.LEDGER_SCORE} AS truth_score FROM @df", df=df)


def decay(claims: DataFrame, as_of: str) -> DataFrame:
    """Age the recency of active claims; adds ``decayed``. A change of 0.001 or less is not written."""
    days = SC.days_between("coalesce(last_confirmed_at, created_at)", ts(as_of))
    return rescored(run_sql(
        f"""
        SELECT * EXCEPT (recency, fresh), if(decayed, round(fresh, 4), recency) AS recency FROM (
          SELECT *, status NOT IN {INACTIVE} AND abs(fresh - recency) > {S.DECAY_WRITE_THRESHOLD} AS decayed
          FROM (SELECT *, pow({SC.decay_rate('knowledge_class')}, {days}) AS fresh FROM @claims))
        """,
        claims=claims,
    ))


def promote_all(claims: DataFrame, as_of: str, rule: Promotion = Promotion()) -> DataFrame:
    """One promotion pass over stored claims; adds ``promoted``."""
    return run_sql(
        f"""
        SELECT * EXCEPT (status, last_confirmed_at, new), new AS status, new <> status AS promoted,
          if(new <> status AND new = 'corroborated', {ts(as_of)}, last_confirmed_at) AS last_confirmed_at
        FROM (SELECT *, CASE WHEN status IN ('candidate', 'unverified') AND n_sources >= {rule.sources} THEN 'corroborated'
                WHEN status = 'candidate' AND (coalesce(max_authority, 0D) >= {rule.authority}D OR {SC.LEDGER_SCORE} >= {rule.score}D)
                THEN 'unverified' ELSE status END AS new FROM @claims)
        """,
        claims=claims,
    )


def set_status(claims: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """Manual status changes (claim_id, new_status); confirmation stamps the time."""
    return run_sql(
        f"""
        SELECT c.* EXCEPT (status, last_confirmed_at), coalesce(new_status, status) AS status,
          if(new_status IN ('owner_confirmed', 'canonical'), {ts(as_of)}, last_confirmed_at) AS last_confirmed_at
        FROM @claims c LEFT JOIN @changes n ON c.claim_id = n.claim_id
        """,
        claims=claims, changes=changes,
    )


def supersede(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """Apply (old_id, new_id, ord): the old claim is superseded, both sides get the link; the last pair wins.

    A pair that names an unknown claim does nothing.
    """
    return run_sql(
        """
        WITH ok AS (
          SELECT p.* FROM @pairs p LEFT SEMI JOIN @claims a ON p.old_id = a.claim_id LEFT SEMI JOIN @claims b ON p.new_id = b.claim_id),
        down AS (SELECT old_id, max_by(new_id, ord) AS by_id FROM ok GROUP BY old_id),
        up AS (SELECT new_id, max_by(old_id, ord) AS prev_id FROM ok GROUP BY new_id)
        SELECT c.* EXCEPT (status, superseded_by, supersedes), if(by_id IS NULL, status, 'superseded') AS status,
          coalesce(by_id, superseded_by) AS superseded_by, coalesce(prev_id, supersedes) AS supersedes
        FROM @claims c LEFT JOIN down ON c.claim_id = old_id LEFT JOIN up ON c.claim_id = new_id
        """,
        claims=claims, pairs=pairs,
    )


def conflict_links(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """Symmetric, distinct conflict links (claim_id, other_id) from pairs (a_id, b_id) of known claims."""
    return run_sql(
        """
        WITH ok AS (
          SELECT p.* FROM @pairs p LEFT SEMI JOIN @claims a ON p.a_id = a.claim_id LEFT SEMI JOIN @claims b ON p.b_id = b.claim_id)
        SELECT DISTINCT l.* FROM (SELECT explode(array(
          named_struct('claim_id', a_id, 'other_id', b_id), named_struct('claim_id', b_id, 'other_id', a_id))) AS l FROM ok)
        """,
        claims=claims, pairs=pairs,
    )


def with_conflict_counts(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Set ``n_conflicts`` from the link table and rescore."""
    return rescored(run_sql(
        """
        SELECT c.* EXCEPT (n_conflicts), coalesce(n, 0L) AS n_conflicts FROM @claims c
        LEFT JOIN (SELECT claim_id, count(*) AS n FROM @links GROUP BY claim_id) l ON c.claim_id = l.claim_id
        """,
        claims=claims, links=links,
    ))


def retract(claims: DataFrame, evidence: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence of the given artifacts (artifact_id) stops supporting; the evidence rows get ``retracted``.

    Returns (claims, evidence). The number of retracted evidence rows is what a caller reports; claims have theirs as ``n_retracted``.
    """
    flipped = run_sql(
        """
        SELECT e.* EXCEPT (supports), supports AND g.artifact_id IS NULL AS supports, supports AND g.artifact_id IS NOT NULL AS retracted
        FROM @evidence e LEFT JOIN (SELECT DISTINCT artifact_id FROM @artifacts) g ON e.artifact_id = g.artifact_id
        """,
        evidence=evidence, artifacts=artifacts,
    )
    changed = ["n_supporting", "n_refuting", "n_sources", "max_authority", *OWN_FIELDS[:4]]
    out = run_sql(
        f"""
        WITH fresh AS (
          SELECT merge_key, count_if(retracted) AS lost, max(if(supports, source_authority, null)) AS auth
          FROM @flipped GROUP BY merge_key HAVING count_if(retracted) > 0),
        counted AS (
          SELECT c.* EXCEPT ({', '.join(changed)}), n_supporting - coalesce(lost, 0L) AS n_supporting,
            n_refuting + coalesce(lost, 0L) AS n_refuting, n_sources - coalesce(lost, 0L) AS n_sources,
            if(lost IS NULL, max_authority, auth) AS max_authority, coalesce(lost, 0L) AS n_retracted
          FROM @claims c LEFT JOIN fresh f ON c.merge_key = f.merge_key)
        SELECT *, n_supporting AS own_sup, n_refuting AS own_ref, max_authority AS own_auth, n_sources AS own_sources FROM counted
        """,
        flipped=flipped, claims=claims,
    )
    return rescored(out), flipped


def list_claims(
    claims: DataFrame, status: str | None = None, group_id: str | None = None, limit: int | None = 50,
    as_of_valid: str | None = None, as_of_transaction: str | None = None,
) -> DataFrame:
    """Best claims first, earlier ones first among equals; filters reach the scan, the limit is a top-k."""
    if status is not None and status not in S.STATUSES:
        raise ValueError(f"Unknown status: {status}. Valid: {list(S.STATUSES)}")
    tests = {"status": status, "group_id": group_id}
    for column, value in tests.items():
        if value is not None:
            claims = claims.where(claims[column] == value)
    if as_of_valid is not None:
        t = ts(as_of_valid)
        claims = claims.where(f"(valid_from IS NULL OR valid_from <= {t}) AND (valid_until IS NULL OR valid_until >= {t})")
    if as_of_transaction is not None:
        claims = claims.where(f"created_at <= {ts(as_of_transaction)}")
    out = claims.orderBy(claims["truth_score"].desc(), claims["seq"].asc())
    return out if limit is None else out.limit(limit)


def active(claims: DataFrame) -> DataFrame:
    return claims.where(f"status NOT IN {INACTIVE}")


def get_claim(claims: DataFrame, claim_id: str) -> DataFrame:
    return claims.where(claims["claim_id"] == claim_id)


def counts_by(claims: DataFrame, column: str) -> DataFrame:
    return run_sql(f"SELECT {column}, count(*) AS n FROM @claims GROUP BY {column}", claims=claims)


def stats(claims: DataFrame) -> DataFrame:
    """One row: claims and their average score (0 for an empty ledger)."""
    return run_sql(
        "SELECT count(*) AS total_claims, round(coalesce(avg(truth_score), 0D), 3) AS avg_truth_score FROM @claims", claims=claims
    )
