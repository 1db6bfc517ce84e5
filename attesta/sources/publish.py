"""Publishing file actions through a client; the client is a plug-in made inside each task."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame


class PublishClient(Protocol):
    def commit(self, message: str, actions: list[dict]) -> str:
        """Carry out file actions (path, action, content) as one commit and return its id."""


def api_base(url: str) -> str:
    """SQL: scheme and host of a project address."""
    return f"concat(parse_url({url}, 'PROTOCOL'), '://', parse_url({url}, 'AUTHORITY'), '/api/v4')"


def escaped_path(path: str) -> str:
    """SQL: a file path as one address segment."""
    return f"replace({path}, '/', '%2F')"


def publish(actions: DataFrame, make_client: Callable[[], PublishClient]) -> DataFrame:
    """Commit batches (batch, message, path, action, content); returns (batch, commit_id, n).

    A batch has at most 500 actions, so a group is bounded. Committing the same file twice gives the same file, which
    makes a repeated task harmless.
    """
    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        client = make_client()
        rows = pdf.sort_values("path")[["path", "action", "content"]].to_dict("records")
        commit = client.commit(pdf["message"].iloc[0], rows)
        return pd.DataFrame({"batch": [int(pdf["batch"].iloc[0])], "commit_id": [commit], "n": [len(rows)]})

    return actions.groupBy("batch").applyInPandas(send, "batch long, commit_id string, n long")


def _place(folder: str) -> tuple[FileSystem, str]:
    """The file system of a folder (a local path or any URI that pyarrow opens) and the path in it."""
    return FileSystem.from_uri(folder) if ":" in folder else (LocalFileSystem(), os.path.abspath(folder))


def _part_name(path: str, part: int) -> str:
    stem, ext = os.path.splitext(path)
    return path if part == 0 else f"{stem}.part{part}{ext}"


def write_pages(parts: DataFrame, folder: str) -> DataFrame:
    """Write page parts (path, part, content) as files below ``folder``; returns (path, part, bytes).

    Part 0 has the page's own name, later parts get ``.partN`` before the extension. ``folder`` is a URI that all machines reach, or a path
    mounted on them; each file is written by the task that holds it.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _place(folder)
        for pdf in batches:
            sizes = []
            for path, part, content in zip(pdf["path"], pdf["part"], pdf["content"]):
                target = f"{root}/{_part_name(path, part)}"
                fs.create_dir(os.path.dirname(target), recursive=True)
                data = content.encode("utf-8")
                with fs.open_output_stream(target) as f:
                    f.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"path": list(pdf["path"]), "part": list(pdf["part"]), "bytes": sizes}).astype({"path": object})

    return parts.select("path", "part", "content").mapInPandas(write, "path string, part int, bytes long")


def delete_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Remove all files of the given pages (path) below ``folder``; returns (path, files). Files that are gone already do not matter."""
    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _place(folder)
        for pdf in batches:
            counts = []
            for path in pdf["path"]:
                part = 0
                while fs.get_file_info(f"{root}/{_part_name(path, part)}").type == FileType.File:
                    fs.delete_file(f"{root}/{_part_name(path, part)}")
                    part += 1
                counts.append(part)
            yield pd.DataFrame({"path": list(pdf["path"]), "files": counts}).astype({"path": object})

    return pages.select("path").mapInPandas(remove, "path string, files long")
