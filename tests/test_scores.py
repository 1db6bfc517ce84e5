"""Numbers the scores must give."""

from datetime import datetime, timedelta

import pytest
from build import NOW, claims, ev

from attesta.functions import score as SC
from attesta.operators import authority, ledger

CASES = [
    ("one source", dict(confidence=0.8, evidence=[ev()]), 0.1),
    ("three sources", dict(confidence=0.8, evidence=[ev("a", True, 0.5), ev("b", True, 0.7), ev("c", True, 0.3)]), 0.42),
    ("refuted", dict(confidence=0.8, evidence=[ev("a"), ev("b", False)]), 0.07),
    ("conflicting", dict(confidence=0.8, evidence=[ev()], n_conflicts=1), 0.09),
    ("no evidence", dict(confidence=0.8), 0.04),
    ("only refuted", dict(confidence=0.8, evidence=[ev("a", False)]), 0.0),
]


def test_truth_score(spark):
    df = claims(spark, [c for _, c, _ in CASES])
    score = SC.truth_score("evidence", "confidence", "authority", "recency", "array_repeat(0, cast(n_conflicts AS INT))")
    got = [r[0] for r in df.orderBy("seq").selectExpr(f"{score} AS s").collect()]
    assert got == pytest.approx([w for _, _, w in CASES])
    led, _ = ledger.add_claims(claims(spark, [{**c, "subject": name} for name, c, _ in CASES]), NOW)
    got = {r.subject: r.truth_score for r in led.collect()}
    assert got == pytest.approx({name: w for name, _, w in CASES})


def test_same_claim_twice(spark):
    rows = [dict(subject="A", predicate="is", object="B", confidence=0.6, evidence=[ev("x")]), dict(subject=" a ", predicate="IS", object="b ", confidence=0.8, evidence=[ev("y")])]
    led, evid = ledger.add_claims(claims(spark, rows), NOW)
    (r,) = led.collect()
    assert (r.claim_id, r.n_supporting, r.confidence, r.status) == ("c0", 2, 0.8, "corroborated")
    assert evid.count() == 2
    led, evid = ledger.add_claims(claims(spark, [{**rows[0]}, {**rows[1], "evidence": [ev("x")]}]), NOW)
    assert (led.collect()[0].n_supporting, evid.count()) == (1, 1)


def test_promotion_rules(spark):
    rule = ledger.Promotion(sources=3)
    sources = [dict(evidence=[ev(f"a{i}")]) for i in range(3)]
    status = [ledger.add_claims(claims(spark, sources[:n]), NOW, rule=rule)[0].collect()[0].status for n in (1, 2, 3)]
    assert status == ["candidate", "candidate", "corroborated"]
    strict = ledger.Promotion(score=0.99)
    assert ledger.add_claims(claims(spark, [dict(evidence=[ev("a", True, 0.95)])]), NOW, rule=strict)[0].collect()[0].status == "unverified"
    canonical = claims(spark, [dict(status="canonical", evidence=[ev("a"), ev("b")])])
    led, _ = ledger.add_claims(canonical, NOW)
    assert led.collect()[0].status == "canonical"
    assert ledger.promote_all(led, NOW).collect()[0].status == "canonical"


def test_score_that_passed_and_fell_again(spark):
    """One strong claim, then refutations: the status stays as it was won."""
    rows = [dict(confidence=0.2, evidence=[ev("a", True, 0.7)]), dict(confidence=0.9, evidence=[ev("a")])]
    rows += [dict(evidence=[ev(f"r{i}", False)]) for i in range(4)]
    led, _ = ledger.add_claims(claims(spark, rows), NOW)
    r = led.collect()[0]
    assert r.truth_score < 0.15 and r.status == "unverified"


def test_decay(spark):
    old = datetime(2024, 6, 1) - timedelta(days=30)
    led, _ = ledger.add_claims(claims(spark, [
        dict(subject="a", knowledge_class="stateful", created_at=old), dict(subject="b", knowledge_class="stateful", created_at=old, status="superseded"),
        dict(subject="c", knowledge_class="other", created_at=old),
    ]), NOW)
    got = {r.subject: (r.recency, r.decayed) for r in ledger.decay(led, NOW).collect()}
    assert got == {"a": (round(0.95**30, 4), True), "b": (1.0, False), "c": (round(0.995**30, 4), True)}


def test_bitemporal(spark):
    day = timedelta(days=1)
    now = datetime(2024, 6, 1)
    led, _ = ledger.add_claims(claims(spark, [
        dict(subject="a", valid_from=now - 30 * day, valid_until=now + 30 * day, created_at=now - 10 * day),
        dict(subject="b", valid_from=now - 365 * day, valid_until=now - 100 * day, created_at=now),
    ]), NOW)

    def names(**kw):
        return [r.subject for r in ledger.list_claims(led, **kw).collect()]

    assert names(as_of_valid=NOW) == ["a"]
    assert names(as_of_valid=str(now - 200 * day)) == ["b"]
    assert names(as_of_transaction=str(now - 5 * day)) == ["a"]
    assert names() == ["a", "b"] and names(limit=1) == ["a"]
    with pytest.raises(ValueError):
        ledger.list_claims(led, status="nonsense")


def test_supersede_and_links(spark):
    led, _ = ledger.add_claims(claims(spark, [dict(object="old"), dict(object="new")]), NOW)
    pairs = spark.createDataFrame([("c0", "c1", 1), ("c0", "zzz", 2)], "old_id string, new_id string, ord int")
    got = {r.claim_id: (r.status, r.superseded_by, r.supersedes) for r in ledger.supersede(led, pairs).collect()}
    assert got == {"c0": ("superseded", "c1", None), "c1": ("candidate", None, "c0")}
    twice = spark.createDataFrame([("c0", "c1"), ("c1", "c0"), ("c0", "zzz")], "a_id string, b_id string")
    linked = ledger.with_conflict_counts(led, ledger.conflict_links(led, twice))
    assert [r.n_conflicts for r in linked.collect()] == [1, 1]


def test_retraction(spark):
    led, evid = ledger.add_claims(claims(spark, [dict(confidence=0.8, evidence=[ev("bad")]), dict(subject="T", evidence=[ev("good")])]), NOW)
    after, flipped = ledger.retract(led, evid, spark.createDataFrame([("bad",)], "artifact_id string"))
    got = {r.subject: (r.n_supporting, r.n_refuting, r.truth_score) for r in after.collect()}
    assert got["S"] == (0, 1, 0.0) and got["T"][0] == 1
    assert flipped.where("retracted").count() == 1


def test_authority(spark):
    reg = spark.createDataFrame([("jane", "_default", 0.9), ("src", "finance", 0.9), ("src", "_default", 0.6), ("only", "x", 0.7)], "source string, topic string, weight double")
    asked = spark.createDataFrame([("jane", "any"), ("src", "finance"), ("src", "sports"), ("src", None), ("nobody", "x"), ("only", "y")], "who string, topic string")
    got = [tuple(r) for r in authority.lookup(asked, reg, "who", "topic", "w").collect()]
    assert sorted(got, key=str) == sorted([("jane", "any", 0.9), ("src", "finance", 0.9), ("src", "sports", 0.6), ("src", None, 0.6), ("nobody", "x", 0.5), ("only", "y", 0.5)], key=str)
    new = spark.createDataFrame([("hi", None, 1.5), ("lo", None, -0.3)], "source string, topic string, weight double")
    got = {r.source: r.weight for r in authority.set_weights(reg, new).where("source IN ('hi', 'lo')").collect()}
    assert got == {"hi": 1.0, "lo": 0.0}
    file = spark.createDataFrame([('{"jane": 0.9, "gov": {"_default": 0.7, "trade": 0.95}}',)], "value string")
    got = {(r.source, r.topic): r.weight for r in authority.from_json_text(file).collect()}
    assert got == {("jane", "_default"): 0.9, ("gov", "_default"): 0.7, ("gov", "trade"): 0.95}
