"""Files as artifacts: recursive scan with an extension list, content hashes and parse routing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta import schema as S
from attesta.functions import text as X
from attesta.operators.documents import changed_since, parse_best
from attesta.plans.ordered import assign_seq
from attesta.plans.sqlrun import run_sql
from attesta.session import cut_lineage
from attesta.sources.json_arrays import open_path, read_objects, write_objects

# Extensions a scan takes up, those a parser may be asked for, and those read as plain text.
SCAN_EXTENSIONS = (
    ".txt", ".md", ".markdown", ".rst", ".json", ".yaml", ".yml", ".csv", ".tsv", ".xml", ".html", ".htm", ".tex",
    ".py", ".js", ".ts", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".sh", ".toml", ".ini", ".cfg", ".conf", ".log",
    ".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".wav", ".mp3", ".jpg", ".jpeg", ".png", ".zip", ".msg", ".eml",
)
PARSE_EXTENSIONS = (*SCAN_EXTENSIONS, ".gif", ".bmp", ".tiff")
PLAIN_EXTENSIONS = (
    ".txt", ".md", ".markdown", ".rst", ".py", ".js", ".ts", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".sh", ".toml", ".ini", ".cfg", ".conf", ".log",
)
#: Bytes that are no text: without a parser for their type such files make no claims.
BINARY_EXTENSIONS = (".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".wav", ".mp3", ".jpg", ".jpeg", ".png", ".zip", ".msg", ".gif", ".bmp", ".tiff")
#: A parse below this quality is tried again with the next parser of its type.
GOOD_PARSE = 0.2
STATE = "source_uri string, content_hash string, modified timestamp, length bigint"
Parser = Callable[[bytes, str], str]
STATE_FILE = ".hashes.json"
# Media types by extension; anything else counts as text/plain.
MEDIA_TYPES = {
    ".md": "text/markdown", ".html": "text/html", ".htm": "text/html", ".csv": "text/csv", ".json": "application/json", ".pdf": "application/pdf",
    ".xml": "text/xml", ".py": "text/x-python", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".zip": "application/zip",
}
SUFFIX = "lower(regexp_extract(path, r'(\\.[^./]+)$', 1))"


def _in(values: Iterable[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def can_parse(path: str = "path") -> str:
    return f"{SUFFIX.replace('path', path)} IN {_in(PARSE_EXTENSIONS)}"


def artifacts_of(files: DataFrame, root: str) -> DataFrame:
    """Artifact rows of binary file rows (path, modificationTime, length, content), batch or stream. Only files that are no text keep their ``content``; their body is empty."""
    types = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in MEDIA_TYPES.items())
    base = root.rstrip("/") + "/"
    rel = f"substring(path, instr(path, {X.lit(base)}) + {len(base)})"
    binary = f"{SUFFIX} IN {_in(BINARY_EXTENSIONS)}"
    text_hash = f"if({binary}, sha2(content, 256), sha2(make_valid_utf8(cast(content AS STRING)), 256))"
    return files.where(_wanted()).selectExpr(
        f"left(sha2(concat(path, sha2(content, 256)), 256), 32) AS artifact_id", "'local_file' AS source_type", "path AS source_uri",
        f"{rel} AS title", f"if({binary}, '', make_valid_utf8(cast(content AS STRING))) AS body", "'' AS author", "cast(modificationTime AS TIMESTAMP_NTZ) AS content_created_at",
        f"left({text_hash}, 16) AS content_hash", "length AS file_size", f"CASE {SUFFIX} {types} ELSE 'text/plain' END AS mime_type", f"{SUFFIX} AS suffix",
        f"if({binary}, content, null) AS content",
    )


def _wanted() -> str:
    return f"{SUFFIX} IN {_in(SCAN_EXTENSIONS)} AND NOT endswith(path, '/{STATE_FILE}')"


def _fetching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of listed files, one file at a time."""
    for batch in batches:
        for k, path in enumerate(batch.column(0).to_pylist()):
            with open_path(path) as file:
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns), pa.array([file.read()], pa.binary())], ["path", "modificationTime", "length", "content"])


def scan(spark: SparkSession, root: str, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New and changed files under ``root`` against the saved state; returns (artifacts, next state).

    Files are listed; only those whose time or length is not that of the state are read, by the tasks that hash them. The state has (source_uri, content_hash, modified,
    length). Bytes of text files that are no UTF-8 are read as replacement characters.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(_wanted()).select("path", "modificationTime", "length")
    if state is None:
        state = spark.createDataFrame([], STATE)
    touched = run_sql(
        "SELECT l.* FROM @l l LEFT JOIN @s s ON l.path = s.source_uri WHERE NOT (l.modificationTime <=> s.modified AND l.length <=> s.length)", l=listed, s=state
    )
    found = cut_lineage(artifacts_of(touched.mapInArrow(_fetching, "path string, modificationTime timestamp, length bigint, content binary"), root))
    changed = changed_since(found, state)
    following = run_sql(
        """
        SELECT l.path AS source_uri, coalesce(f.content_hash, s.content_hash) AS content_hash, l.modificationTime AS modified, l.length
        FROM @l l LEFT JOIN @f f ON l.path = f.source_uri LEFT JOIN @s s ON l.path = s.source_uri
        UNION ALL SELECT s.source_uri, s.content_hash, s.modified, s.length FROM @s s LEFT ANTI JOIN @l l ON s.source_uri = l.path
        """,
        l=listed, f=found.select("source_uri", "content_hash"), s=state,
    )
    return changed, following


def _parsing(parsers: dict[str, list[Parser]], attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for suffix, content, path in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                try:
                    out.append(parsers[suffix][attempt](content, path))
                except Exception:  # noqa: BLE001  a parser that fails on a file leaves it to the next one
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["artifact_id", "markdown"])

    return run


def parse(artifacts: DataFrame, parsers: dict[str, list[Parser]] | None = None, known_parses: DataFrame | None = None) -> DataFrame:
    """Markdown of each artifact: plain text as it is, HTML turned into Markdown, and what the ``parsers`` of a suffix make of its bytes.

    Adds (markdown, backend, source_format, word_count, tables_detected). The first parser of a type gets all its files, the next one only those without a parse or with
    one of a quality below ``GOOD_PARSE``; the better parse is kept, for files of text their plain reading too. Files that are no text and
    have no parse are left out. ``known_parses`` (artifact_id, backend, markdown) are taken as they are, without a call.
    """
    parsers = parsers or {}
    whole = artifacts
    if known_parses is not None:
        artifacts = artifacts.join(known_parses.select("artifact_id"), "artifact_id", "left_anti")
    html = "suffix IN ('.html', '.htm')"
    plain = run_sql(
        f"""
        SELECT artifact_id, CASE WHEN {html} THEN 'html' WHEN suffix IN {_in(PLAIN_EXTENSIONS)} THEN 'text' ELSE 'fallback' END AS backend, 99 AS priority,
          CASE WHEN {html} THEN {X.html_to_markdown('body')} ELSE body END AS markdown FROM @a WHERE suffix NOT IN {_in(BINARY_EXTENSIONS)}
        """,
        a=artifacts,
    )
    known = _in(parsers) if parsers else "('')"
    todo = artifacts.where(f"suffix IN {known}").selectExpr("artifact_id", "suffix", "coalesce(content, encode(body, 'UTF-8')) AS content", "source_uri")
    made = None
    for attempt in range(max(map(len, parsers.values()), default=0)):
        able = _in([s for s, p in parsers.items() if len(p) > attempt])
        new = cut_lineage(todo.where(f"suffix IN {able}").mapInArrow(_parsing(parsers, attempt), "artifact_id string, markdown string"))
        new = new.where("markdown IS NOT NULL").selectExpr("artifact_id", f"concat('parser:', {attempt}) AS backend", f"{attempt} AS priority", "markdown")
        made = new if made is None else made.unionByName(new)
        good = new.where(f"{X.quality_score('markdown', X.table_markers('markdown'))} >= {GOOD_PARSE}D").select("artifact_id")
        todo = todo.join(good, "artifact_id", "left_anti")
    if made is None:
        best = plain.select("artifact_id", "backend", "markdown")
    else:
        asked = artifacts.where(f"suffix IN {known}").select("artifact_id")
        tried = made.unionByName(plain.join(asked, "artifact_id", "left_semi")).withColumn("tables", F.expr(X.table_markers("markdown")))
        best = parse_best(tried, "artifact_id").select("artifact_id", "backend", "markdown").unionByName(plain.join(asked, "artifact_id", "left_anti").select("artifact_id", "backend", "markdown"))
    if known_parses is not None:
        best = best.unionByName(known_parses.select("artifact_id", "backend", "markdown"))
    return run_sql(
        f"""
        SELECT a.*, b.markdown, b.backend, {X.word_count('b.markdown')} AS word_count, {X.table_markers('b.markdown')} AS tables_detected, substring(suffix, 2) AS source_format
        FROM @a a JOIN @b b ON a.artifact_id = b.artifact_id
        """,
        a=whole.drop("content"), b=best,
    )


def manual_text(spark: SparkSession, title: str, body: str, author: str = "") -> DataFrame:
    """One artifact from text typed in by hand."""
    row = spark.createDataFrame([(title, body, author)], "title string, body string, author string")
    return row.selectExpr(
        "left(sha2(concat(title, body), 256), 32) AS artifact_id", "'manual' AS source_type", "'' AS source_uri", "title", "body", "author"
    )


def json_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON array files, or JSON lines (ledger, change log, resolutions), with a fixed schema.

    Rows that cannot be read keep their text in ``_corrupt_record``; ``unreadable`` counts them.
    """
    return read_objects(spark, path, schema).withColumnRenamed("_corrupt", "_corrupt_record").drop("_path", "_at")


def unreadable(table: DataFrame) -> int:
    return table.where("_corrupt_record IS NOT NULL").count()


def _in_order(rows: DataFrame) -> DataFrame:
    """Readable rows; ``seq`` follows their place in the file, files by name."""
    return assign_seq(rows.where("_corrupt IS NULL").drop("seq", "_corrupt"), [F.col("_path"), F.col("_at")])


def claims_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Claims of ledger files: JSON arrays of objects with ``id`` and times in ISO form; ``seq`` is the order in the files."""
    return _in_order(read_objects(spark, path, S.CLAIM, {"claim_id": "id"})).select(*S.CLAIM.names)


def claims_to_json(claims: DataFrame, path: str) -> None:
    """Claims as JSON array files in the layout that ``claims_from_json`` reads, in the order of ``seq``."""
    write_objects(claims.orderBy("seq").drop("seq").withColumnRenamed("claim_id", "id"), path)


def events_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Change log files: arrays of objects with ``id`` and ``timestamp``; a payload that is an object is kept as its text."""
    return _in_order(read_objects(spark, path, S.EVENT, {"event_id": "id", "ts": "timestamp"})).select(*S.EVENT.names)


def events_to_json(events: DataFrame, path: str) -> None:
    named = events.orderBy("seq").drop("seq").withColumnsRenamed({"event_id": "id", "ts": "timestamp"})
    write_objects(named, path)


def resolutions_from_json(spark: SparkSession, path: str) -> DataFrame:
    return _in_order(read_objects(spark, path, S.RESOLUTION)).select(*S.RESOLUTION.names)


def resolutions_to_json(resolutions: DataFrame, path: str) -> None:
    write_objects(resolutions.orderBy("seq").drop("seq"), path)
