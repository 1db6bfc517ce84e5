"""Session defaults and the one way lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "attesta", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; cluster sizes stay with the cluster's own configuration."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; only a local session may get a temporary one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        named = tempfile.mkdtemp(prefix="attesta-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


_run_folders: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """The folder of this driver below the checkpoint folder; it is removed when the driver ends."""
    base = checkpoint_dir(spark)
    if base not in _run_folders:
        if not _run_folders:
            atexit.register(_remove_run_folders)
        _run_folders[base] = f"{base}/attesta-run-{uuid.uuid4().hex}"
    return _run_folders[base]


def _remove_run_folders() -> None:
    for path in _run_folders.values():
        with contextlib.suppress(Exception):  # a store that is gone by then, or that only Spark reaches
            fs, inner = FileSystem.from_uri(path if ":" in path else f"file://{path}")
            fs.delete_dir(inner)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    The result survives the loss of executors, columns that depend on the partitioning (row ids) keep one value, and
    what follows reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
