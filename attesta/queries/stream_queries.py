"""Streaming queries, drained with availableNow so that they can be compared with a batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from attesta.plans import views as V
from attesta.plans.sqlrun import run_sql
from attesta.queries.base import LEDGER1, query
from attesta.queries.common import stamped_c1
from attesta.session import checkpoint_dir, cut_lineage, run_folder
from attesta.streaming import ingest
from attesta.streaming.claim_state import claim_changes


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = V.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.selectExpr("event_id", "ts", f"{V.pick('event_type', V.EVENT_CHANGE, 'gap_detected')} AS change_type", "value")


def _drain(stream: DataFrame, mode: str) -> DataFrame:
    """The stream's whole result, written by foreachBatch to the shared folder and read back."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/attesta-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    q = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    if mode == "complete":  # the last batch holds the whole result
        return run_sql("SELECT * FROM @o WHERE batch = (SELECT max(batch) FROM @o)", o=out)
    return out


@query("stream_event_windows", """
SELECT date_trunc('day', ts) AS day, CASE event_type WHEN 'signup' THEN 'document_added' WHEN 'view' THEN 'claim_added' WHEN 'click' THEN 'claim_merged' WHEN 'purchase' THEN 'claim_promoted' ELSE 'conflict_detected' END AS change_type,
  count(*) AS n FROM events GROUP BY ALL""")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event counts of the stream. Time and windows are UTC."""
    counts = _drain(ingest.event_windows(_event_stream(spark, sf_dir)), "complete")
    return counts.selectExpr("cast(window.start AS TIMESTAMP_NTZ) AS day", "change_type", "n")


@query("stream_ingest_counts", "SELECT event_type AS kind, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a stream delivers, counted per kind after ingest."""
    schema = V.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return run_sql(
        "SELECT event_type AS kind, count(*) AS n, round(sum(value), 2) AS total FROM @e GROUP BY event_type", e=_drain(raw, "append")
    )


@query("stream_claim_promotions", f"""
WITH {LEDGER1}
SELECT fp AS fingerprint, status, n_supporting FROM ledger1 WHERE status <> 'candidate'""")
def stream_claim_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the orders arrive in three parts; the state store holds what is known of each, and promotions come out.

    The last promotion of a claim is its status, and a stored ledger of the same claims says how many sources it has in the end.
    """
    claims = cut_lineage(stamped_c1(spark, sf_dir))
    inbox = f"{run_folder(spark)}/claims-{uuid.uuid4().hex}"
    edges = claims.selectExpr("approx_percentile(seq, array(0.33, 0.66)) AS p").first().p or [0, 0]
    for part in (f"seq <= {edges[0]}", f"seq > {edges[0]} AND seq <= {edges[1]}", f"seq > {edges[1]}"):
        claims.where(part).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(claims.schema).parquet(inbox)
    changes = _drain(claim_changes(stream), "append")
    return run_sql(
        """
        WITH last AS (SELECT merge_key, max_by(new_status, seq) AS status FROM @c GROUP BY merge_key),
        counted AS (SELECT fingerprint, count(DISTINCT artifact_id) AS n FROM (SELECT fingerprint, explode(evidence.artifact_id) AS artifact_id FROM @a) GROUP BY fingerprint)
        SELECT fingerprint, status, n AS n_supporting FROM last JOIN counted ON merge_key = fingerprint
        """,
        c=changes, a=claims,
    )
