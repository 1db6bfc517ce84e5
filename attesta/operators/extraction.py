"""Claim extraction: prompts, calls to an outside extractor, parsing of its answers, and the cache in between.

The extractor is a plug-in: any callable that takes a prompt and returns JSON text. It runs inside tasks, with a
bounded number of calls at a time, pacing, retries and a timeout per call. Answers are written before they are used, so
a lost executor never pays twice for a finished partition.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, wait

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta import schema as S
from attesta.functions import dates
from attesta.functions import text as X
from attesta.plans.sqlrun import run_sql
from attesta.session import cut_lineage

PROMPT_CHARS = 8000  # what one call reads; longer content becomes several prompts
# Texts in an error that make it worth another try.
TRANSIENT = ("429", "rate_limit", "500", "502", "503", "timeout")

RESPONSE = (
    "struct<claims:array<struct<subject:string,predicate:string,object:string,natural_language:string,confidence:double,"
    "knowledge_class:string,valid_from:string,valid_until:string,source_span:string,references:array<string>,"
    "entity_aliases:array<struct<alias:string,canonical:string>>>>>"
)


def prompts(chunks: DataFrame, limit: int = PROMPT_CHARS) -> DataFrame:
    """The prompts of each chunk (source_type, title, author, source_artifact, dated, content), numbered by ``part``.

    A prompt has at most ``limit`` characters of content. Longer content is split where white space allows, and nothing is left out
    but the white space at a split; a run of ``limit`` characters without any is cut there.
    """
    parts = f"regexp_extract_all(content, '(?s)(?:.{{1,{limit}}}(?=\\\\s|$)|.{{1,{limit}}})', 0)"
    split = chunks.where(f"{X.ws_trim('content')} <> ''").selectExpr("*", f"posexplode({parts}) AS (part, _piece)")
    return split.where(f"{X.ws_trim('_piece')} <> ''").selectExpr(
        *chunks.columns, "part",
        f"""concat('Source: ', source_type, '\\nTitle: ', title, '\\nAuthor: ', author, '\\nFilename: ', source_artifact, '\\nDate: ', dated,
            '\\n\\nContent:\\n', _piece) AS prompt""",
    )


def is_transient(error: str) -> bool:
    low = error.lower()
    return any(mark in low for mark in TRANSIENT)


def call_extractor(
    prompts_df: DataFrame, extract: Callable[[str], str], max_concurrent: int = 8, rate_per_minute: int | None = 500, retries: int = 3,
    backoff: float = 1.0, timeout: float = 30.0, tasks: int | None = 8,
) -> DataFrame:
    """Add (response, error, latency_ms) to prompts.

    ``max_concurrent`` calls and ``rate_per_minute`` are shared out over ``tasks`` partitions; with ``tasks`` None (a rule that runs in the
    task itself) the partitions stay as they are and nothing is paced. A task keeps its share of calls in flight; a call that has
    not answered in time is given up, and those that wait behind it go on in a new thread.
    """
    paced = tasks is not None and rate_per_minute is not None
    interval = 60.0 * tasks / max(rate_per_minute, 1) if paced else 0.0
    width = max(1, -(-max_concurrent // (tasks or 1))) if tasks else 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = answer_all(list(pdf["prompt"])) if tasks else [direct(text) for text in pdf["prompt"]]
            out = pd.DataFrame(rows, columns=["response", "error", "latency_ms"], index=pdf.index)
            yield pdf.assign(**{c: out[c].astype(object) for c in out})

    def direct(text: str) -> tuple[str | None, str | None, int]:
        try:
            return extract(text), None, 0
        except Exception as ex:  # noqa: BLE001 - the rule decides what it raises
            return None, str(ex)[:500], 0

    def answer_all(texts: list[str]) -> list[tuple[str | None, str | None, int]]:
        """Each call has a thread and a deadline of its own; at most ``width`` are in flight."""
        results: list = [None] * len(texts)
        due = [(0.0, k, 0) for k in range(len(texts))]  # earliest start, text, tries so far
        flying: dict[Future, tuple[int, int, float]] = {}
        next_start = 0.0
        while due or flying:
            now = time.monotonic()
            ready = min(due, default=None)
            if ready and len(flying) < width and max(ready[0], next_start) <= now:
                due.remove(ready)
                future: Future = Future()
                threading.Thread(target=call, args=(future, texts[ready[1]]), daemon=True).start()
                flying[future] = (ready[1], ready[2], now)
                next_start = now + interval
                continue
            ends = [began + timeout for _, _, began in flying.values()]
            if ready and len(flying) < width:
                ends.append(max(ready[0], next_start))
            wait(flying, timeout=max(0.0, min(ends) - now), return_when=FIRST_COMPLETED) if flying else time.sleep(max(0.0, min(ends) - now))
            now = time.monotonic()
            for future, (k, tries, began) in list(flying.items()):
                late = now - began >= timeout
                if not future.done() and not late:
                    continue
                del flying[future]
                if future.done() and future.exception() is None:
                    results[k] = (future.result(), None, int((now - began) * 1000))
                    continue
                error = f"Timeout after {tries + 1} attempts" if not future.done() else str(future.exception())[:500]
                if tries < retries and (not future.done() or is_transient(error)):
                    due.append((now + backoff * 2 ** tries, k, tries + 1))
                else:
                    results[k] = (None, error, int((now - began) * 1000))
        return results

    def call(future: Future, text: str) -> None:
        try:
            future.set_result(extract(text))
        except Exception as ex:  # noqa: BLE001 - the service decides what it raises
            future.set_exception(ex)

    fields = prompts_df.schema.simpleString()[len("struct<"):-1] + ",response:string,error:string,latency_ms:int"
    dealt = prompts_df.repartition(tasks) if tasks else prompts_df
    return cut_lineage(dealt.mapInPandas(run, fields))


def call_stats(results: DataFrame) -> DataFrame:
    return run_sql(
        """
        SELECT *, coalesce(total_latency_ms div nullif(succeeded, 0L), 0L) AS avg_latency_ms FROM (
          SELECT count(*) AS total_jobs, count_if(error IS NULL) AS succeeded, count_if(error IS NOT NULL) AS failed,
            coalesce(sum(if(error IS NULL, latency_ms, 0)), 0L) AS total_latency_ms FROM @r)
        """,
        r=results,
    )


def parse_responses(results: DataFrame) -> DataFrame:
    """Claims of JSON answers (artifact_id, source_artifact, author, response); broken answers give none.

    Every entity alias becomes a claim of its own. Unknown classes count as 'process'; dates are parsed leniently.
    """
    classes = ", ".join(f"'{c}'" for c in S.KNOWLEDGE_CLASSES)
    return run_sql(
        f"""
        WITH answers AS (
          SELECT artifact_id, source_artifact, author, explode(from_json(response, '{RESPONSE}').claims) AS c FROM @r WHERE response IS NOT NULL),
        stated AS (
          SELECT artifact_id, source_artifact, author, c.subject, c.predicate, c.object, c.natural_language, c.confidence,
            if(c.knowledge_class IN ({classes}), c.knowledge_class, 'process') AS knowledge_class,
            {dates.parse_date('c.valid_from')} AS valid_from, {dates.parse_date('c.valid_until')} AS valid_until, c.source_span FROM answers),
        aliases AS (
          SELECT artifact_id, source_artifact, author, a.alias, 'is alias of', a.canonical, concat(a.alias, ' is an alias for ', a.canonical), 0.95D, 'stable',
            cast(null AS TIMESTAMP_NTZ), cast(null AS TIMESTAMP_NTZ), source_span
          FROM (SELECT artifact_id, source_artifact, author, c.source_span, explode(c.entity_aliases) AS a FROM answers))
        SELECT * FROM stated UNION ALL SELECT * FROM aliases
        """,
        r=results,
    )


def sentence_extractor(prompt: str) -> str:
    """A rule instead of a model: 'X <verb> Y.' sentences become claims. For tests and for runs without a service."""
    import json
    import re

    body = re.sub(r"(?m)^#{1,6}\s.*$", "", prompt.split("Content:\n", 1)[-1])
    found = []
    for sentence in re.split(r"(?<=[.!?])\s+", body):
        m = re.match(r"^\s*(.{2,80}?)\s+(is|are|owns|uses|requires|supports|has)\s+(.{1,200}?)[.!?]?\s*$", sentence, re.S)
        if m:
            s, p, o = (" ".join(g.split()) for g in m.groups())
            found.append({
                "subject": s, "predicate": p, "object": o, "natural_language": f"{s} {p} {o}.", "confidence": 0.6,
                "knowledge_class": "process", "source_span": sentence.strip(), "entity_aliases": [],
            })
    return json.dumps({"claims": found})


def claims_from(parsed: DataFrame, as_of: str) -> DataFrame:
    """Parsed answers as arriving claims (nested evidence, ids and order from content)."""
    from attesta.plans.ordered import assign_seq
    from attesta.plans.views import NEW_CLAIM, one_evidence

    ev = one_evidence("artifact_id", "true", "source_artifact", "author", "0.5D", "source_span", f"TIMESTAMP_NTZ '{as_of}'")
    order = [F.col(c) for c in ("artifact_id", "subject", "predicate", "object", "natural_language")]
    return run_sql(
        f"""
        SELECT seq, left(sha2(concat_ws('|', artifact_id, seq, subject, predicate, object), 256), 32) AS claim_id, subject, predicate, object,
          natural_language, confidence, knowledge_class, valid_from, valid_until, TIMESTAMP_NTZ '{as_of}' AS created_at, {ev} AS evidence,
          author, source_artifact, {NEW_CLAIM}
        FROM @p
        """,
        p=assign_seq(parsed, order),
    )
