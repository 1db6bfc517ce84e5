"""Tables several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.operators import authority, ledger
from attesta.plans import views as V
from attesta.session import cut_lineage


def stamped_c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authority.stamp(V.customer_status(spark, sf_dir), V.authority_registry(spark))


def ledger_c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 merged, promoted, decayed and scored: written once, then read like a stored ledger."""
    claims, _ = ledger.add_claims(stamped_c1(spark, sf_dir), V.AS_OF)
    return cut_lineage(ledger.decay(claims, V.AS_OF))
