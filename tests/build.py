"""Small claim tables for tests."""

from __future__ import annotations

from datetime import datetime

from attesta import schema as S
from attesta.plans.views import NEW_CLAIM

NOW = "2024-06-01 00:00:00"
EVIDENCE = {
    "artifact_id": "a", "episode_id": "", "supports": True, "source_span": "", "source_artifact": "", "author": "", "author_role": "",
    "source_authority": 0.5, "recorded_at": datetime(2024, 1, 1),
}


def ev(artifact="a", supports=True, authority=0.5, **more):
    return tuple({**EVIDENCE, "artifact_id": artifact, "supports": supports, "source_authority": authority, **more}.values())


def claims(spark, rows):
    """rows: dicts with any of the claim columns; the rest gets defaults."""
    types = {f.name: f.dataType.simpleString() for f in S.CLAIM.fields if f.name not in ("conflicts_with", "embedding", "specificity")}
    types["n_conflicts"] = "bigint"
    base = dict(
        seq=0, claim_id="", subject="S", predicate="p", object="o", natural_language="", confidence=0.5, authority=0.5, recency=1.0,
        status="candidate", knowledge_class="process", evidence=[], created_at=datetime(2024, 1, 1), valid_from=None, valid_until=None,
        last_confirmed_at=None, group_id="default", superseded_by=None, supersedes=None, n_conflicts=0,
    )
    data = []
    for i, r in enumerate(rows):
        full = {**base, "seq": i, "claim_id": f"c{i}", **r}
        data.append(tuple(full[k] for k in types))
    df = spark.createDataFrame(data, ", ".join(f"`{k}` {t}" for k, t in types.items()))
    from attesta.functions.text import fingerprint

    return df.selectExpr("*", f"{fingerprint('subject', 'predicate', 'object')} AS fingerprint", "0.5D AS specificity")
