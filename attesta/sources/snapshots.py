"""Tables as immutable Parquet folders, published by one manifest for each commit.

A commit may write several tables: their data goes to new folders first, then one small manifest that names the folders of every table is
put in place under the next number. Readers see all tables of a commit or none of them, and a writer that dies leaves folders nobody
names (``vacuum`` removes them). A table with a key is cut into buckets by a hash of it, and an update writes only the buckets that hold changed rows. Old
commits can be read until they are vacuumed. One writer at a time: a number that is taken already stops the later one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.plans.sqlrun import run_sql
from attesta.session import cut_lineage

BUCKETS = 64
#: An append-only table with more folders than this is written together.
MOST_PARTS = 32
_BUCKET = "_bucket"


class CommitConflict(RuntimeError):
    """Another writer has published the commit that this one was about to be."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        if self.root.startswith("file:"):
            self.fs, self.base = LocalFileSystem(), "/" + self.root[5:].lstrip("/")
        else:
            self.fs, self.base = FileSystem.from_uri(self.root) if "://" in self.root else (LocalFileSystem(), self.root)
        # rows were dealt by the number of the first commit: it stays
        self.buckets = self.manifest().get("buckets", buckets)

    # --- manifests ---

    def commits(self) -> list[int]:
        found = self.fs.get_file_info(FileSelector(f"{self.base}/commits", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.type == FileType.File and f.base_name.endswith(".json") and f.base_name[:-5].isdigit())

    def manifest(self, commit: int | None = None) -> dict:
        """Tables of a commit (the last one): schema, version, folders of each."""
        if commit is None:
            found = self.commits()
            if not found:
                return {"commit": 0, "tables": {}}
            commit = found[-1]
        with self.fs.open_input_stream(f"{self.base}/commits/{commit:012d}.json") as file:
            return json.loads(file.read())

    def _publish(self, manifest: dict) -> None:
        """Put the next manifest in place whole: it is written under another name and moved."""
        path = f"{self.base}/commits/{manifest['commit']:012d}.json"
        self.fs.create_dir(f"{self.base}/commits", recursive=True)
        draft = f"{self.base}/commits/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as file:
            file.write(json.dumps(manifest).encode())
        if self.fs.get_file_info(path).type != FileType.NotFound:
            self.fs.delete_file(draft)
            raise CommitConflict(f"commit {manifest['commit']} was published by another writer")
        self.fs.move(draft, path)

    # --- reads ---

    def versions(self, table: str) -> list[int]:
        """Versions of a table that can be read, oldest first."""
        return sorted({e["version"] for n in self.commits() if (e := self.manifest(n)["tables"].get(table))})

    def _entry(self, table: str, version: int | None = None) -> dict | None:
        if version is None:
            return self.manifest()["tables"].get(table)
        entries = (self.manifest(n)["tables"].get(table) for n in reversed(self.commits()))
        return next((e for e in entries if e and e["version"] == version), None)

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """A table, or those buckets of it; None if it was never written."""
        entry = self._entry(table, version)
        return None if entry is None else self._load(entry, buckets)

    def _load(self, entry: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        paths = entry["parts"] if entry["key"] is None else [p for b, p in entry["parts"].items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def bucket_of(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """The buckets of the rows: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket_of(key)).distinct().collect())

    # --- writes ---

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Writes to several tables that are published together when the block ends, or not at all."""
        tx = Transaction(self)
        yield tx
        tx.publish()

    def write(self, table: str, df: DataFrame, key: str | None = None) -> int:
        with self.transaction() as tx:
            tx.write(table, df, key)
        return self.manifest()["tables"][table]["version"]

    def append(self, table: str, df: DataFrame) -> None:
        with self.transaction() as tx:
            tx.append(table, df)

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> int:
        """Replace rows with the same keys, add the others."""
        with self.transaction() as tx:
            tx.upsert(table, rows, keys)
        return self.manifest()["tables"][table]["version"]

    def delete(self, table: str, keys: DataFrame) -> int:
        with self.transaction() as tx:
            tx.delete(table, keys)
        entry = self._entry(table)
        return entry["version"] if entry else 0

    def vacuum(self, keep: int = 20) -> int:
        """Forget all but the last ``keep`` commits and remove data that no remaining one names; the number of removed folders."""
        old = self.commits()[:-keep] if keep else []
        for n in old:
            self.fs.delete_file(f"{self.base}/commits/{n:012d}.json")
        named = {p.split("/")[1] for n in self.commits() for e in self.manifest(n)["tables"].values() for p in (e["parts"] if e["key"] is None else e["parts"].values())}
        gone = [f for f in self.fs.get_file_info(FileSelector(f"{self.base}/data", allow_not_found=True)) if f.base_name not in named]
        for f in gone:
            self.fs.delete_dir(f.path)
        return len(gone)


class Transaction:
    """Tables as the last commit has them, and the folders written since."""

    def __init__(self, store: Snapshots) -> None:
        self.store, self.last = store, store.manifest()
        self.changed: dict[str, dict] = {}

    def _put(self, table: str, df: DataFrame, key: str | None, parts: dict | list) -> None:
        old = self.last["tables"].get(table)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
        self.changed[table] = {"schema": json.loads(schema.json()), "version": old["version"] + 1 if old else 1, "key": key, "parts": parts}

    def _save(self, df: DataFrame, key: str | None) -> dict | list:
        """Write to a new folder: one path, or the path of each bucket that has rows."""
        folder = f"data/{uuid.uuid4().hex}"
        if key is None:
            df.write.parquet(f"{self.store.root}/{folder}")
            return [folder]
        # a bucket with one hot key is split into several files, small ones are put together
        dealt = df.withColumn(_BUCKET, self.store.bucket_of(key)).hint("rebalance", _BUCKET)
        dealt.write.partitionBy(_BUCKET).parquet(f"{self.store.root}/{folder}")
        found = self.store.fs.get_file_info(FileSelector(f"{self.store.base}/{folder}"))
        return {f.base_name.split("=")[1]: f"{folder}/{f.base_name}" for f in found if f.base_name.startswith(f"{_BUCKET}=")}

    def _current(self, table: str) -> dict | None:
        return self.changed.get(table) or self.last["tables"].get(table)

    def write(self, table: str, df: DataFrame, key: str | None = None) -> None:
        """The whole table anew. The frame may read the last commit."""
        self._put(table, df, key, self._save(df, key))

    def replace(self, table: str, df: DataFrame, key: str, buckets: list[int]) -> None:
        """The rows of ``buckets`` anew; ``df`` has rows of these buckets only."""
        entry = self._current(table)
        if entry is None or entry["key"] != key:
            raise ValueError(f"{table} is not kept by {key}")
        kept = {b: p for b, p in entry["parts"].items() if int(b) not in buckets}
        self._put(table, df, key, kept | self._save(df, key))

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows to a table without a key (change log, resolutions, audit)."""
        entry = self._current(table)
        if entry is None:
            return self.write(table, df)
        if entry["key"] is not None:
            raise ValueError(f"{table} is kept by {entry['key']}: use upsert")
        df = df.select(*T.StructType.fromJson(entry["schema"]).names)
        parts = entry["parts"]
        if len(parts) >= MOST_PARTS:
            parts = self._save(self.store._load(entry), None)
        self._put(table, df, None, parts + self._save(df, None))

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        entry = self._current(table)
        if entry is None:
            return self.write(table, rows)
        if entry["key"] in keys:
            rows = cut_lineage(rows)
            buckets = self.store.touched(rows, entry["key"])
            self.replace(table, upsert(self.store._load(entry, buckets), rows, keys), entry["key"], buckets)
        else:
            self.write(table, upsert(self.store._load(entry), rows, keys), entry["key"])

    def delete(self, table: str, keys: DataFrame) -> None:
        entry = self._current(table)
        if entry is None:
            return
        if entry["key"] in keys.columns:
            buckets = self.store.touched(keys, entry["key"])
            self.replace(table, self.store._load(entry, buckets).join(keys, keys.columns, "left_anti"), entry["key"], buckets)
        else:
            self.write(table, self.store._load(entry).join(keys, keys.columns, "left_anti"), entry["key"])

    def publish(self) -> None:
        if self.changed:
            self.store._publish({"commit": self.last["commit"] + 1, "buckets": self.store.buckets, "tables": self.last["tables"] | self.changed})


def upsert(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    on = " AND ".join(f"o.{k} <=> n.{k}" for k in keys)
    return run_sql(f"SELECT o.* FROM @old o LEFT ANTI JOIN @rows n ON {on}", old=old, rows=rows).unionByName(rows.select(*old.columns))


def append_jsonl(df: DataFrame, path: str) -> None:
    """Audit records as JSON lines."""
    df.selectExpr("*", "current_timestamp() AS audit_recorded_at").write.mode("append").json(path)
