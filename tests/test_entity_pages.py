"""Entity pages: claims and evidence are merged once each, a claim knows its earliest evidence, and no join sorts by an expression."""

from build import NOW
from test_merge_paths import arriving, both

from attesta.operators import ledger, pages
from attesta.plans import skew
from attesta.queries import load, page_queries
from attesta.session import cut_lineage

SF = "/root/testdata/sf0.001"


def test_the_query_merges_once_and_joins_by_columns(spark, monkeypatch):
    plans = []

    def spy(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut_lineage(df)

    monkeypatch.setattr(pages, "cut_lineage", spy)
    monkeypatch.setattr(page_queries, "cut_lineage", spy)
    plans.append(load()[0]["entity_pages"](spark, SF)._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("RepartitionByExpression") for p in plans) == 2  # claims and evidence
    joins = [line for p in plans for line in p.splitlines() if "Join " in line]
    assert joins and not any("lower(" in line or "btrim(" in line for line in joins)


def test_claims_know_their_earliest_evidence(spark, monkeypatch):
    df = arriving(spark)
    for rows_per_task in (skew.ROWS_PER_TASK, 20):  # 20: some keys take the other way of merging
        monkeypatch.setattr(skew, "ROWS_PER_TASK", rows_per_task)
        claims, evidence = ledger.add_claims(df, NOW)
        known, _ = ledger.add_claims(df, NOW, first_piece=True)
        want = both([pages.page_claims(claims, evidence)])
        assert "first_piece" in known.columns and both([pages.page_claims(known, evidence)]) == want


def test_lines_of_shared_pages_odd_names_and_missing_facts(spark):
    columns = "merge_key string, subject string, status string, natural_language string, truth_score double, source string, span string, seq bigint"
    rows = [("k1", "Ada", 0.5), ("k2", " ADA ", 0.25), ("k3", "Bea", 0.5), ("k4", "?!", 0.5), ("k5", None, 0.5), ("k6", "Cid", 0.5)]
    pc = spark.createDataFrame([(k, s, "candidate", f"text {k}", score, "s0", None, i) for i, (k, s, score) in enumerate(rows)], columns)
    pairs = [("k1", f"s{n:02}") for n in range(14)] + [("k2", "s01"), ("k2", "s01"), ("k2", "t"), ("k4", "s01"), ("k5", "s02"), ("k6", "s03")]
    evidence = spark.createDataFrame([(k, s, f"artifact-{s}") for k, s in pairs] + [("k3", None, ""), ("gone", "s01", "x")], "merge_key string, source_artifact string, artifact_id string")
    topical = pc.where("subject <> 'Cid'").selectExpr("*", "'x' AS topic")
    lines = pages.entity_lines(pc, evidence, None, NOW, topical).collect()
    by = {}
    for r in lines:
        by.setdefault((r.path, r.section), []).append(r)
    assert sorted(r.k1 for r in by["entities/ada.md", 1]) == [" ADA ", "Ada"] == sorted(r.k1 for r in by["entities/ada.md", 4])
    assert sorted(r.k1 for r in by["entities/ada.md", 5]) == [f"s{n:02}" for n in range(14)] + ["t"]
    head = next(r.line for r in by["entities/ada.md", 1] if r.k1 == "Ada")
    assert head.count("  - s") == 10 and "  - s09\n" in head and "s10" not in head and "topics:\n  - x" in head
    assert ("entities/bea.md", 4) not in by and ("entities/bea.md", 1) not in by and len(by["entities/bea.md", 2]) == 2
    assert len(by["entities/unnamed.md", 4]) == 2 and [r.k1 for r in by["entities/unnamed.md", 1]] == ["?!"]
    assert sorted(r.k1 for r in by["entities/unnamed.md", 5]) == ["s01", "s02"]
    assert "topics:\n  - general" in by["entities/cid.md", 1][0].line and len(by["entities/cid.md", 4]) == 1 and len(by["entities/cid.md", 5]) == 1
    assert {r.k2 for r in lines if r.section == 4} == {-1.0} and {r.k2 for r in lines if r.section in (1, 5)} == {0.0}
