"""The change log: reads over events, causal chains, and routing of events to handlers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.functions.score import ts
from attesta.plans.ordered import ordered_index
from attesta.plans.sqlrun import run_sql
from attesta.session import cut_lineage


def since(events: DataFrame, at: str, types: list[str] | None = None) -> DataFrame:
    """Events strictly after a time, of some types."""
    out = events.where(f"ts > {ts(at)}")
    return out.where(out["change_type"].isin(*types)) if types else out


def for_source(events: DataFrame, uri: str) -> DataFrame:
    return events.where(events["source_uri"] == uri)


def recent(events: DataFrame, limit: int = 50) -> DataFrame:
    """The last events, newest first."""
    return events.orderBy(events["seq"].desc()).limit(limit)


def recent_minutes(events: DataFrame, minutes: int, as_of: str, limit: int = 50) -> DataFrame:
    out = events.where(f"ts > {ts(as_of)} - make_dt_interval(0, 0, {minutes})").orderBy("seq").limit(limit)
    return out.selectExpr("seq", "ts", "change_type", "coalesce(nullif(entity_id, ''), source_uri) AS about")


def entity_history(events: DataFrame, name: str, limit: int = 30) -> DataFrame:
    """Events whose payload or entity mentions a name, oldest first; the payload is shortened for display."""
    low = X.lit(name.lower())
    hit = f"contains(lower(payload), {low}) OR contains(lower(entity_id), {low})"
    return events.where(hit).orderBy("seq").limit(limit).selectExpr("seq", "ts", "change_type", "left(payload, 120) AS payload")


def lineage(events: DataFrame) -> DataFrame:
    """For every event: the root that set it off, its depth and the path of ids from the root.

    Pointer doubling: each round joins events with their current ancestor and so doubles the distance covered; a chain
    of depth d needs log2(d) rounds. Events that reached their root leave the loop, and so do events whose path would
    meet itself: on a cycle it ends before the first id that comes again.
    """
    running = cut_lineage(events.selectExpr(
        "event_id", "triggered_by AS above", "if(triggered_by IS NULL, 0, 1) AS depth", "array(event_id) AS path"
    ))
    finished = running.where("above IS NULL")
    table = running
    running = running.where("above IS NOT NULL")
    while not running.isEmpty():
        joined = cut_lineage(run_sql(
            """
            SELECT event_id, if(closed, null, above) AS above, if(closed, depth, further) AS depth, if(closed, path, longer) AS path FROM (
              SELECT r.event_id, a.above, r.depth, r.path, r.depth + coalesce(a.depth, 0) AS further, concat(coalesce(a.path, array(r.above)), r.path) AS longer,
                array_contains(r.path, r.above) OR coalesce(arrays_overlap(a.path, r.path), false) AS closed
              FROM @r r LEFT JOIN @t a ON r.above = a.event_id)
            """,
            r=running, t=table,
        ))
        finished = finished.unionByName(joined.where("above IS NULL"))
        table = finished.unionByName(joined.where("above IS NOT NULL"))
        running = joined.where("above IS NOT NULL")
    return finished.selectExpr("event_id", "path[0] AS root_id", "depth", "path")


def intervals(events: DataFrame) -> DataFrame:
    """For every event: its root, depth and the interval (enter, leave) of numbers that holds the intervals of all it set off.

    Each tree of triggers is walked once around: an event is entered, what it set off is walked in the order of ids, it is left. That walk is a list with two elements an event;
    pointer doubling gives every element its distance from the end of the list and the balance of entered and left events up to there, which is the depth. No path is built: a
    chain of n events is 2 n narrow rows in log2(2 n) rounds. Events set off others soon after, so elements are sorted by id first and walks shortened within
    each batch of neighbours; rounds are for what leads out of a batch and move only that and the elements it leads to. Numbers count up to -1, where the root is left.

    The first of several triggers of one id counts; rows without an id have no interval. A trigger that is not in the log is a root without a row. A cycle is opened above its smallest id.
    """
    kind = events.schema["event_id"].dataType.simpleString()
    nodes = cut_lineage(run_sql(
        f"""
        WITH e AS (SELECT event_id, min(triggered_by) AS above FROM @e WHERE event_id IS NOT NULL GROUP BY event_id)
        SELECT event_id, above, true AS logged FROM e
        UNION ALL
        SELECT DISTINCT a.above, cast(null AS {kind}), false FROM e a LEFT ANTI JOIN e b ON a.above = b.event_id WHERE a.above IS NOT NULL
        """,
        e=events,
    ))
    arcs, rest = _ranked(nodes, kind)
    if not rest.isEmpty():
        stuck = nodes.join(rest.select("event_id").distinct(), "event_id", "left_semi")
        arcs = arcs.unionByName(_ranked(_opened(stuck), kind)[0])
    return run_sql(
        """
        SELECT d.event_id, d.root_id, -d.balance AS depth, -d.rank AS enter, -u.rank AS leave FROM @d d JOIN @u u ON d.event_id = u.event_id
        LEFT SEMI JOIN @n n ON d.event_id = n.event_id
        """,
        d=arcs.where("NOT up"), u=arcs.where("up"), n=nodes.where("logged"),
    )


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of walks, led on to the last element of their walk in the same batch; those that go round in the batch stay as they are."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        ids = pc.unique(t["event_id"])
        code = pc.index_in(t["event_id"], ids).to_numpy() * 2 + t["up"].to_numpy()
        to = pc.fill_null(pc.index_in(t["next_id"], ids, skip_nulls=True), -1).to_numpy()
        place = np.full(2 * len(ids), -1)
        place[code] = np.arange(len(code))
        nxt = np.where(to < 0, -1, place[np.maximum(to, 0) * 2 + pc.fill_null(t["next_up"], False).to_numpy()])
        end = np.where(nxt < 0, np.arange(len(nxt)), nxt)
        rank, balance = t["rank"].to_numpy(), t["balance"].to_numpy()
        steps, gained = np.where(nxt < 0, 0, rank), np.where(nxt < 0, 0, balance)
        for _ in range(len(end).bit_length()):
            steps, gained, end = steps + steps[end], gained + gained[end], end[end]
        led = (nxt >= 0) & (nxt[end] < 0)
        at = pa.array(np.where(led, end, np.arange(len(end))))
        columns = {c: t[c].take(at) for c in ("next_id", "next_up", "root_id")}
        columns["rank"] = pa.chunked_array([np.where(led, steps + rank[end], rank)])
        columns["balance"] = pa.chunked_array([np.where(led, gained + balance[end], balance)])
        yield from pa.table([columns.get(c, t[c]) for c in t.column_names], names=t.column_names).combine_chunks().to_batches()


def _ranked(nodes: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The elements of the walks that end, with rank, balance and root, and those of walks without an end."""
    kids = cut_lineage(ordered_index(nodes.where("above IS NOT NULL").select("event_id", "above"), ["above"], [F.col("event_id")]))
    elements = run_sql(
        f"""
        SELECT n.event_id, false AS up, coalesce(k.event_id, n.event_id) AS next_id, k.event_id IS NULL AS next_up, 1L AS rank, 1L AS balance, cast(null AS {kind}) AS root_id
        FROM @n n LEFT JOIN @k k ON k.above = n.event_id AND k.ord = 1
        UNION ALL
        SELECT n.event_id, true, coalesce(s.event_id, n.above), s.event_id IS NULL, 1L, -1L, if(n.above IS NULL, n.event_id, null)
        FROM @n n LEFT JOIN @k k ON n.event_id = k.event_id LEFT JOIN @k s ON s.above = k.above AND s.ord = k.ord + 1
        """,
        n=nodes, k=kids,
    )
    table = cut_lineage(elements.repartitionByRange("event_id").sortWithinPartitions("event_id").mapInArrow(_shortened, elements.schema))
    finished, running = table.where("next_id IS NULL"), table.where("next_id IS NOT NULL")
    # what finished elements others lead to; those nobody leads to are done
    met = cut_lineage(run_sql("SELECT f.* FROM @f f LEFT SEMI JOIN @r r ON f.event_id = r.next_id AND f.up = r.next_up", f=finished, r=running))
    table = met.unionByName(running)
    for _ in range((2 * nodes.count()).bit_length() + 1):
        if running.isEmpty():
            break
        joined = cut_lineage(run_sql(
            """
            SELECT r.event_id, r.up, t.next_id, t.next_up, r.rank + t.rank AS rank, r.balance + t.balance AS balance, t.root_id
            FROM @r r JOIN @t t ON r.next_id = t.event_id AND r.next_up = t.up
            """,
            r=running, t=table,
        ))
        done, running = joined.where("next_id IS NULL"), joined.where("next_id IS NOT NULL")
        finished, met = finished.unionByName(done), met.unionByName(done)
        table = met.unionByName(running)
    return finished, running


def _opened(stuck: DataFrame) -> DataFrame:
    """Events that lead into cycles, with each cycle opened above its smallest id.

    After as many steps up as there are events every event has come to a cycle, and an event on a cycle has been all around it.
    """
    steps = stuck.selectExpr("event_id", "above AS to", "event_id AS least")
    for _ in range(stuck.count().bit_length()):
        steps = cut_lineage(run_sql(
            "SELECT a.event_id, b.to, least(a.least, b.least) AS least FROM @s a JOIN @s b ON a.to = b.event_id", s=steps
        ))
    heads = steps.where("event_id = least").join(steps.selectExpr("to AS event_id").distinct(), "event_id", "left_semi").selectExpr("event_id", "true AS head")
    return cut_lineage(stuck.join(heads, "event_id", "left").selectExpr("event_id", "if(head, null, above) AS above"))


def chain(events: DataFrame, event_id: int | str) -> DataFrame:
    """What an event set off, directly and indirectly, in depth-first order: the events whose interval lies in its own."""
    start = X.lit(event_id) if isinstance(event_id, str) else str(event_id)
    spans = intervals(events)
    return run_sql(
        # the start is one row: ids are unique in ``spans``
        f"""
        SELECT /*+ BROADCAST(x) */ s.* FROM @s s JOIN (SELECT root_id, enter, leave FROM @s WHERE event_id = {start}) x
          ON s.root_id = x.root_id AND s.enter > x.enter AND s.leave < x.leave
        ORDER BY s.enter
        """,
        s=spans,
    )


def route(events: DataFrame, handlers: DataFrame) -> DataFrame:
    """(event, handler) deliveries: global handlers (change_type NULL) first, then those of the event's type.

    ``handlers`` has (handler_name, change_type, only_type, position); ``only_type`` is what the handler accepts.
    """
    return run_sql(
        """
        SELECT e.event_id, e.change_type, e.payload, h.handler_name, if(h.change_type IS NULL, 0, 1) AS stage, h.position
        FROM @e e JOIN (
          SELECT *, explode(if(change_type IS NULL, (SELECT collect_set(change_type) FROM @e), array(change_type))) AS routed FROM @h) h
          ON e.change_type = h.routed
        WHERE h.only_type IS NULL OR h.only_type = e.change_type
        """,
        e=events, h=handlers,
    )


def dispatch(deliveries: DataFrame, handlers: dict[str, Callable[[dict], str]]) -> DataFrame:
    """Run registered callbacks: adds (success, action_taken, details) to each delivery.

    A callback gets the delivery as a dict and returns what it did; an exception is kept as a result and stops nothing.
    Deliveries without a callback are skipped. Results are written before they are used, so that reading them again
    calls nobody; a task that is run again calls again, as callbacks outside Spark must expect.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                call = handlers.get(row["handler_name"])
                try:
                    out.append((call is not None, "skipped" if call is None else str(call(row)), ""))
                except Exception as ex:  # noqa: BLE001 - callbacks may raise anything
                    out.append((False, "failed", str(ex)[:500]))
            yield pdf.assign(**{c: [o[k] for o in out] for k, c in enumerate(("success", "action_taken", "details"))})

    fields = deliveries.schema.simpleString()[len("struct<"):-1] + ",success:boolean,action_taken:string,details:string"
    return cut_lineage(deliveries.mapInPandas(run, fields))


def claim_events(claims: DataFrame, as_of: str) -> DataFrame:
    """claim_added for every extracted claim."""
    return run_sql(
        f"""
        SELECT 'claim_added' AS change_type, {ts(as_of)} AS ts, subject AS entity_id, source_uri,
          to_json(named_struct('predicate', predicate, 'object', object)) AS payload, '' AS agent FROM @c
        """,
        c=claims,
    )


# Report part -> (change type, field that names the entity).
ENRICHMENT = {
    "entity_merges": ("entity_merged", "canonical"), "relationships": ("relationship_discovered", "subject"),
    "conflicts": ("conflict_detected", None), "gaps": ("gap_detected", "entity"),
}


def enrichment_events(report: DataFrame, as_of: str) -> DataFrame:
    """Events of an enrichment report with rows (part, payload JSON)."""
    kinds = " ".join(f"WHEN '{part}' THEN '{kind}'" for part, (kind, _) in ENRICHMENT.items())
    names = " ".join(f"WHEN '{part}' THEN get_json_object(payload, '$.{field}')" for part, (_, field) in ENRICHMENT.items() if field)
    return run_sql(
        f"""
        SELECT CASE part {kinds} END AS change_type, {ts(as_of)} AS ts, coalesce(CASE part {names} END, '') AS entity_id,
          '' AS source_uri, payload, 'graph_population_agent' AS agent FROM @r
        """,
        r=report,
    )
