"""What outside calls (parsers, embedders) gave, stored under the kind of call and a hash of what the call was given."""

from __future__ import annotations

from pyspark.sql import DataFrame

from attesta.plans.sqlrun import run_sql
from attesta.sources.snapshots import Snapshots, Transaction

ENTRIES, VERSIONS = "content_cache", "content_versions"
SCHEMA = "cache_key string, kind string, value string"


class ContentCache:
    """Entries lie in buckets of their key, so a look reads the buckets of the keys asked for. ``versions`` names the version of what makes a kind;
    entries of a kind with another version are removed before the first look."""

    def __init__(self, store: Snapshots, versions: dict[str, str]) -> None:
        self.store, self.versions = store, versions
        self._checked: set[str] = set()

    def key(self, kind: str, given: str) -> str:
        """SQL of the key for the SQL of what is given (text or bytes)."""
        return f"concat('{kind}:', sha2({given}, 256))"

    def check(self, kind: str) -> None:
        """Remove the entries of a kind if its version changed; this commits, so call it before a transaction that looks into the kind."""
        if kind in self._checked:
            return
        spark, wanted = self.store.spark, self.versions.get(kind, "")
        known = self.store.read(VERSIONS)
        old = {} if known is None else {r.kind: r.version for r in known.collect()}  # one row a kind
        if old.get(kind) != wanted:
            if kind in old:
                self.invalidate(kind)
            self.store.write(VERSIONS, spark.createDataFrame(sorted((old | {kind: wanted}).items()), "kind string, version string"))
        self._checked.add(kind)

    def find(self, kind: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with a ``cache_key`` that has an entry, with its ``value``, and the other rows."""
        self.check(kind)
        if self.store.read(ENTRIES) is None:
            return rows.selectExpr("*", "cast(null AS STRING) AS value").limit(0), rows
        entries = self.store.read(ENTRIES, buckets=self.store.touched(rows, "cache_key")).select("cache_key", "value")
        return rows.join(entries, "cache_key"), rows.join(entries.select("cache_key"), "cache_key", "left_anti")

    def keep(self, tx: Transaction, kind: str, rows: DataFrame) -> None:
        """Store (cache_key, value), one entry a key; rows without a value are left out."""
        once = run_sql(f"SELECT cache_key, '{kind}' AS kind, min(value) AS value FROM @r WHERE value IS NOT NULL GROUP BY cache_key", r=rows)
        if self.store.read(ENTRIES) is None and ENTRIES not in tx.changed:
            tx.write(ENTRIES, once, "cache_key")
        else:
            tx.upsert(ENTRIES, once, ["cache_key"])

    def invalidate(self, kind: str | None = None, keys: DataFrame | None = None) -> int:
        """Remove the entries of a kind, those of ``keys`` (cache_key), or all; the number of removed entries."""
        entries = self.store.read(ENTRIES)
        if entries is None:
            return 0
        before = entries.count()
        if keys is not None:
            self.store.delete(ENTRIES, keys.select("cache_key").distinct())
        else:
            self.store.write(ENTRIES, entries.where(f"kind <> '{kind}'" if kind else "false"), "cache_key")
        return before - self.store.read(ENTRIES).count()

    def counts(self) -> dict[str, int]:
        entries = self.store.read(ENTRIES)
        return {} if entries is None else {r["kind"]: r["count"] for r in entries.groupBy("kind").count().collect()}
