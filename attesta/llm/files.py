"""Arrays in the shared folder that workers map into memory."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import SparkSession

from attesta.session import run_folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below that of this driver in the shared checkpoint folder, as a path that the driver and all workers can open.

    Memory-mapped models need a folder that is mounted on all machines; other stores are refused.
    """
    at = urlparse(run_folder(spark))
    if at.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted spark.checkpoint.dir, not {at.scheme}:")
    path = f"{unquote(at.path)}/{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def save_arrays(folder: str, **arrays: np.ndarray) -> None:
    for name, array in arrays.items():
        np.save(f"{folder}/{name}.npy", array)


def map_arrays(folder: str, *names: str) -> list[np.ndarray]:
    return [np.load(f"{folder}/{name}.npy", mmap_mode="r") for name in names]
