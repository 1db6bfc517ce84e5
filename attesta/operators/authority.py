"""Source authority: a registry table (source, topic, weight) and its lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame

from attesta import schema as S
from attesta.functions.score import clamp01
from attesta.plans.sqlrun import run_sql

DEFAULT_TOPIC = "_default"


def lookup(df: DataFrame, registry: DataFrame, source: str, topic: str | None = None, out: str = "source_authority") -> DataFrame:
    """Weight of ``source`` for ``topic``: exact topic, else the source's default, else 0.5.

    Both registry sides have one row per key, so the row count never grows. Neither is broadcast by hand; the
    optimizer does so when the registry's size allows.
    """
    exact, exact_join = "null", ""
    if topic is not None:
        exact = "t.weight"
        exact_join = f"LEFT JOIN (SELECT * FROM @registry WHERE topic <> '{DEFAULT_TOPIC}') t ON d.{source} = t.source AND d.{topic} = t.topic"
    return run_sql(
        f"""
        SELECT d.*, coalesce({exact}, b.weight, {S.DEFAULT_AUTHORITY}D) AS {out} FROM @df d
        LEFT JOIN (SELECT * FROM @registry WHERE topic = '{DEFAULT_TOPIC}') b ON d.{source} = b.source {exact_join}
        """,
        df=df, registry=registry,
    )


def stamp(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Write registry weights into the evidence of claims that carry one author (column ``author``).

    Evidence without an author keeps its weight.
    """
    found = lookup(claims, registry, "author", out="_weight")
    fields = ", ".join(
        f"'{f}', if(coalesce(e.author, '') <> '', _weight, e.{f})" if f == "source_authority" else f"'{f}', e.{f}"
        for f in S.EVIDENCE.fieldNames()
    )
    return run_sql(
        f"SELECT * EXCEPT (evidence, _weight), transform(evidence, e -> named_struct({fields})) AS evidence FROM @found", found=found
    )


def set_weights(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert (source, topic, weight) rows; weights are clamped to 0..1. A flat weight is topic ``_default``."""
    return run_sql(
        f"""
        WITH new AS (SELECT source, coalesce(topic, '{DEFAULT_TOPIC}') AS topic, {clamp01('weight')} AS weight FROM @changes)
        SELECT r.source, r.topic, r.weight FROM @registry r LEFT ANTI JOIN new n ON r.source = n.source AND r.topic = n.topic
        UNION ALL SELECT * FROM new
        """,
        registry=registry, changes=changes,
    )


def remove(registry: DataFrame, source: str, topic: str | None = None) -> DataFrame:
    """Drop a source, or one of its topics."""
    hit = registry["source"] == source
    return registry.where(~(hit if topic is None else hit & (registry["topic"] == topic)))


def topics_of(registry: DataFrame) -> DataFrame:
    """Configured topics per source, sorted, without the default."""
    return run_sql(
        f"SELECT source, array_sort(collect_set(topic)) AS topics FROM @registry WHERE topic <> '{DEFAULT_TOPIC}' GROUP BY source",
        registry=registry,
    )


def from_json_text(df: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a registry file: each value is a number (flat) or an object of topic -> number."""
    return run_sql(
        f"""
        SELECT source, explode(if(startswith(raw, '{{'), from_json(raw, 'map<string,double>'), map('{DEFAULT_TOPIC}', try_cast(raw AS DOUBLE))))
          AS (topic, weight)
        FROM (SELECT explode(from_json({column}, 'map<string,string>')) AS (source, raw) FROM @df)
        """,
        df=df,
    )
