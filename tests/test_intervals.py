"""Intervals of events against a walk over the tree of triggers."""

import random
from collections import defaultdict

from attesta.operators import changelog

SCHEMA = "event_id bigint, triggered_by bigint"


def walk(rows):
    """event -> (root, depth, all below in depth-first order), for rows without cycles."""
    above, below = dict(rows), defaultdict(list)
    for i, t in sorted(rows):
        below[t].append(i)
    out = {}

    def go(i, root, depth):
        out[i] = (root, depth, [])
        for k in below[i]:
            out[i][2].extend([k, *go(k, root, depth + 1)])
        return out[i][2]

    for i in sorted({t for _, t in rows if t is not None and t not in above} | {i for i, t in rows if t is None}):
        go(i, i, 0)
    return out


def test_equal_to_a_walk(spark):
    rng = random.Random(7)
    rows = [(i, None if rng.random() < 0.1 else 900 if rng.random() < 0.05 else rng.choice([0, rng.randrange(max(i, 1))]) if i else None) for i in range(120)]
    want = walk(rows)
    events = spark.createDataFrame(rows + [(None, 3), (5, dict(rows)[5])], SCHEMA)
    got = {r.event_id: r for r in changelog.intervals(events).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, r in got.items():
        inside = sorted((o.enter, o.event_id) for o in got.values() if o.root_id == r.root_id and r.enter < o.enter and o.leave < r.leave)
        assert (r.root_id, r.depth, [e for _, e in inside]) == want[i]
    assert [r.event_id for r in changelog.chain(events, 0).collect()] == want[0][2]


def test_long_chain_and_empty_log(spark):
    n = 20_000
    events = spark.range(n).selectExpr("id AS event_id", "nullif(id - 1, -1) AS triggered_by")
    spans = changelog.intervals(events)
    assert spans.where(f"depth <> event_id OR root_id <> 0 OR leave - enter <> 2 * ({n} - event_id) - 1").isEmpty() and spans.count() == n
    assert changelog.intervals(events.limit(0)).isEmpty()


def test_cycles_are_opened_above_their_smallest_id(spark):
    events = spark.createDataFrame([(4, 2), (2, 3), (3, 4), (9, 3), (1, 9), (7, 7), (5, None), (6, 5)], SCHEMA)
    got = {r.event_id: (r.root_id, r.depth) for r in changelog.intervals(events).collect()}
    # 2 set off 4, 4 set off 3, 3 set off 2 and 9
    assert got == {2: (2, 0), 4: (2, 1), 3: (2, 2), 9: (2, 3), 1: (2, 4), 7: (7, 0), 5: (5, 0), 6: (5, 1)}


def test_rounds_move_only_what_leads_out_of_a_batch(spark, monkeypatch):
    written = []
    cut = changelog.cut_lineage
    monkeypatch.setattr(changelog, "cut_lineage", lambda df: (written.append(cut(df)), written[-1])[1])
    n = 30_000
    events = spark.range(n).selectExpr("id AS event_id", "if(id % 50 = 0, null, id - 1 - id % 50 div 2) AS triggered_by")
    want = walk([tuple(r) for r in events.collect()])
    got = {r.event_id: r for r in changelog.intervals(events).collect()}
    assert {i: (r.root_id, r.depth, (r.leave - r.enter) // 2) for i, r in got.items()} == {i: (root, depth, len(below)) for i, (root, depth, below) in want.items()}
    moved = [df.count() for df in written if "next_id" in df.columns]
    assert moved[0] == 2 * n and sum(moved[1:]) < n / 10, moved


def test_ids_of_text_in_any_order(spark):
    rng = random.Random(11)
    rows = [(i, rng.randrange(i) if i and rng.random() < 0.95 else None) for i in range(400)]
    rng.shuffle(rows)
    name = {i: f"{(i * 7919) % 997:03d}-é" for i, _ in rows} | {None: None}
    got = {r.event_id: (r.root_id, r.depth, (r.leave - r.enter) // 2) for r in changelog.intervals(spark.createDataFrame([(name[i], name[t]) for i, t in rows], "event_id string, triggered_by string")).collect()}
    assert got == {name[i]: (name[root], depth, len(below)) for i, (root, depth, below) in walk(rows).items()}
