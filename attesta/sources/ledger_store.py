"""The ledger as two stored tables, claims and evidence, both in buckets of the merge key, so that what arrives meets only its own buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from attesta.functions import text as X
from attesta.operators import ledger
from attesta.session import cut_lineage
from attesta.sources.snapshots import Snapshots, Transaction

KEY = "merge_key"


def merge_in(tx: Transaction, incoming: DataFrame, as_of: str, rule: ledger.Promotion = ledger.Promotion(), merge_key: str = "fingerprint", decay: bool = False) -> None:
    """Add arriving claims. Reads and writes the buckets they fall into; with ``decay`` also those in which a claim ages by then."""
    store = tx.store
    if store.read("claims") is None:
        claims, evidence = ledger.add_claims(incoming, as_of, None, rule, merge_key)
        tx.write("evidence", evidence, KEY)
        tx.write("claims", ledger.decay(claims, as_of).drop("decayed") if decay else claims, KEY)
        return
    incoming = cut_lineage(incoming)
    buckets = store.touched(incoming, merge_key)
    base = store.read("claims", buckets=buckets), store.read("evidence", buckets=buckets)
    claims, evidence = ledger.add_claims(incoming, as_of, base, rule, merge_key)
    columns = base[0].columns
    tx.replace("evidence", evidence, KEY, buckets)
    if not decay:
        tx.replace("claims", claims.select(*columns), KEY, buckets)
        return
    tx.replace("claims", ledger.decay(claims, as_of).select(*columns), KEY, buckets)
    others = store.read("claims", buckets=[b for b in range(store.buckets) if b not in buckets])
    change(tx, ledger.decay(others, as_of).where("decayed").select(*columns))


def note_groups(tx: Transaction, claims: DataFrame, merge_key: str = "fingerprint") -> None:
    """Record which (subject, predicate) the claims belong to, in buckets of that key, and that these groups wait for a look at their conflicts."""
    rows = cut_lineage(claims.selectExpr(f"{X.conflict_key('subject', 'predicate')} AS ck", f"{merge_key} AS {KEY}").distinct())
    if tx.store.read("groups") is None:
        tx.write("groups", rows, "ck")
    else:
        tx.upsert("groups", rows, ["ck", KEY])
    tx.append("open_groups", rows.select("ck").distinct())


def waiting_claims(store: Snapshots) -> DataFrame | None:
    """The claims of the groups that wait, read from their buckets; None if no group waits."""
    waiting = store.read("open_groups")
    if waiting is None or waiting.isEmpty():
        return None
    waiting = cut_lineage(waiting.distinct())
    members = store.read("groups", buckets=store.touched(waiting, "ck")).join(waiting, "ck", "left_semi").select(KEY).distinct()
    members = cut_lineage(members)
    return store.read("claims", buckets=store.touched(members, KEY)).join(members, KEY, "left_semi")


def change(tx: Transaction, claims: DataFrame) -> int:
    """Put changed claims in the place of those with their merge keys; the number of changed claims."""
    claims = cut_lineage(claims)
    n = claims.count()
    if n:
        tx.upsert("claims", claims, [KEY])
    return n


def retract(tx: Transaction, artifacts: DataFrame) -> int:
    """Retract the evidence of artifacts (artifact_id) in both tables; the number of evidence rows that stopped supporting."""
    store = tx.store
    hit = store.read("evidence").join(artifacts, "artifact_id", "left_semi").select(KEY)
    buckets = store.touched(hit, KEY)
    if not buckets:
        return 0
    claims, evidence = store.read("claims", buckets=buckets), store.read("evidence", buckets=buckets)
    columns = claims.columns, evidence.columns
    claims, evidence = (cut_lineage(x) for x in ledger.retract(claims, evidence, artifacts))
    tx.replace("claims", claims.select(*columns[0]), KEY, buckets)
    tx.replace("evidence", evidence.select(*columns[1]), KEY, buckets)
    return evidence.where("retracted").count()
