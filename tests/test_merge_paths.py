"""Arriving claims are merged in windows after one shuffle, or by partial aggregates where a key has very many: both give the same ledger."""

import random

from build import NOW, claims, ev

from attesta.operators import ledger
from attesta.plans import skew


def arriving(spark, n=160):
    rnd = random.Random(7)
    rows = []
    for _ in range(n):
        evidence = [ev(f"a{rnd.randrange(12)}", rnd.random() < 0.6, rnd.choice([0.1, 0.4, 0.7])) for _ in range(rnd.choice([0, 1, 1, 2, 3]))]
        rows.append(dict(subject=f"s{rnd.choice([0, 0, 0, 0, rnd.randrange(40)])}", confidence=rnd.choice([0.3, 0.6, 0.9]), evidence=evidence, status=rnd.choice(["candidate", "candidate", "unverified"])))
    return claims(spark, rows)


def both(tables):
    return [sorted(map(str, (r.asDict() for r in t.select(*sorted(t.columns)).collect()))) for t in tables]


def test_both_ways_of_merging_give_one_ledger(spark, monkeypatch):
    df = arriving(spark)
    for sources in (2, 9):
        rule = ledger.Promotion(sources=sources, authority=0.9)
        want = both(ledger.merge(*ledger.arrivals(df), NOW, rule))
        assert both(ledger.add_claims(df, NOW, rule=rule)) == want
        monkeypatch.setattr(skew, "ROWS_PER_TASK", 20)  # s0 is a large key now
        assert ledger.large_keys(df.selectExpr("fingerprint AS merge_key", "evidence")).count() == 1
        assert both(ledger.add_claims(df, NOW, rule=rule)) == want
        monkeypatch.undo()


def test_merge_of_new_claims_shuffles_only_what_is_read(spark):
    """One shuffle of the rows and no checkpoint; columns that nobody asked for stay behind."""
    led, _ = ledger.add_claims(arriving(spark), NOW)
    plan = led.select("claim_id", "n_claims", "status")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "natural_language" not in plan.split("RepartitionByExpression")[0]
    pruned = [line for line in plan.splitlines() if "Project" in line]
    assert not any("source_span" in line for line in pruned[:-1])


def test_retraction_reads_the_evidence_once(spark):
    led, evidence = ledger.add_claims(claims(spark, [dict(evidence=[ev("a"), ev("b")]), dict(subject="T", evidence=[ev("b")])]), NOW)
    after, _ = ledger.retract(led, evidence, spark.createDataFrame([("a",)], "artifact_id string"))
    assert sorted(tuple(r) for r in after.select("subject", "n_retracted", "n_supporting").collect()) == [("S", 1, 1), ("T", 0, 1)]
    plan = after.where("n_retracted > 0").select("claim_id", "n_retracted")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2  # claims and evidence
