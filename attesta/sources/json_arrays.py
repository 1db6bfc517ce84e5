"""JSON array files of any size, read object by object in parallel, and tables written as such files.

A file is cut into byte ranges. Where a range begins, nobody knows whether it is inside a string or how deep; so a first pass notes for
every range how many quotes it holds and how it changes the depth, once for each way it may begin. Running sums over the ranges of a file
then give the true beginnings, and a second pass takes the objects that begin in each range and reads on to their ends. Files are opened by tasks
through their paths; a file with one object per line is read in the same way, a level less deep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE_BYTES = 32 << 20
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1
_BLANK = np.zeros(256, bool)
_BLANK[[*b" \t\r\n,"]] = True


def open_path(path: str):
    """A file of a task, by the path that Spark gives it."""
    if path.startswith("file:"):
        return LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    fs, inner = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)
    return fs.open_input_file(inner)


def _escaped_before(file, at: int) -> bool:
    """Whether the byte at ``at`` is escaped: an odd number of backslashes stands before it."""
    n = 0
    while at - n > 0:
        file.seek(at - n - 1)
        if file.read(1) != b"\\":
            break
        n += 1
    return n % 2 == 1


def _strings(data: np.ndarray, inside: bool, escaped: bool) -> np.ndarray:
    """Whether each byte is in a string, its first quote included and its last not, given how the data begins."""
    slash = np.flatnonzero(data == 92)
    quote = data == 34
    if len(slash):
        # in a run of backslashes every second one escapes what follows
        first = np.ones(len(slash), bool)
        first[1:] = np.diff(slash) != 1
        run = np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))
        odd = (np.arange(len(slash)) - run) % 2 == 0
        if escaped and slash[0] == 0:
            odd[run == 0] ^= True
        after = slash[odd] + 1
        quote[after[after < len(data)]] = False
    if escaped and len(data) and data[0] != 92:
        quote[0] = False
    return (np.cumsum(quote, dtype=np.int64) + int(inside)) % 2 == 1


def _depths(data: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """The depth after each byte, counted from 0 at the beginning."""
    return np.cumsum(np.where(strings, 0, _STEP[data]), dtype=np.int64)


def _summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ranges (path, first, last, size): parity of quotes, and the change of depth if it begins outside or inside a string; whether the file is an array."""
    for batch in batches:
        out: list[tuple] = []
        for path, first, last, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with open_path(path) as file:
                escaped = _escaped_before(file, first)
                file.seek(0)
                head = file.read(min(size, 4096)).lstrip(b"\xef\xbb\xbf \t\r\n")
                file.seek(first)
                data = np.frombuffer(file.read(last - first), np.uint8)
            outside, inside = (_strings(data, x, escaped) for x in (False, True))
            change = [int(np.where(s, 0, _STEP[data]).sum()) for s in (outside, inside)]
            out.append((path, first, last, size, int(outside[-1]) if len(data) else 0, *change, head.startswith(b"[")))
        names = ["path", "first", "last", "size", "parity", "outside", "inside", "is_array"]
        kinds = [pa.string(), *[pa.int64()] * 3, *[pa.int64()] * 3, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(8)], names)


def _elements(data: np.ndarray, in_string: bool, escaped: bool, depth: int, base: int) -> np.ndarray:
    """Which bytes belong to elements: all that is deeper than the base, and what is neither blank nor the bracket of the array itself at the base."""
    strings = _strings(data, in_string, escaped)
    after = _depths(data, strings) + depth
    before = np.concatenate([[depth], after[:-1]])
    return (before > base) | (before == base) & (strings | ~_BLANK[data] & (after >= base))


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path``, ``at`` and ``object`` of the elements that begin in ranges (path, first, last, size, in_string, depth, base)."""
    for batch in batches:
        for path, first, last, size, in_string, depth, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with open_path(path) as file:
                escaped = _escaped_before(file, first)
                file.seek(max(first - 1, 0))
                before = file.read(min(first, 1))
                # whether the byte before the range belongs to an element
                open_ = in_string or depth > base or (depth == base and first > 0 and not _BLANK[before[0]] and not (base == 1 and before == b"["))
                data, end, more = bytearray(file.read(last - first)), last, 1 << 16
                if first == 0 and data[:3] == b"\xef\xbb\xbf":
                    data[:3] = b"   "
                while True:
                    mask = np.concatenate([[open_], _elements(np.frombuffer(bytes(data), np.uint8), in_string, escaped, depth, base), [False]])
                    starts, ends = (np.flatnonzero(x) for x in (mask[1:] & ~mask[:-1], mask[:-1] & ~mask[1:]))
                    starts = starts[starts < last - first]
                    complete = not len(starts) or ends[np.searchsorted(ends, starts[-1], side="right")] < len(data)
                    if complete or end >= size:
                        break
                    data += file.read(min(more, size - end))
                    end, more = min(end + more, size), more * 2
            stop = ends[np.searchsorted(ends, starts, side="right")]
            texts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(starts.tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts), pa.string()), pa.array(starts + first, pa.int64()), pa.array(texts, pa.string())], ["path", "at", "object"])


def json_objects(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path``, ``at`` (byte) and ``object`` (text) of each element of the JSON array files at ``path`` (a file, folder or pattern), or of each line of JSON lines.

    An element that is no object, or is cut off by the end of the file, is returned as it stands. An empty file or array has no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").selectExpr("path", "length AS size")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("first"), "size")
    ranges = ranges.select("path", "first", F.least(F.col("first") + range_bytes, "size").alias("last"), "size").repartition("path", "first")
    summed = ranges.mapInArrow(_summing, "path string, first long, last long, size long, parity long, outside long, inside long, is_array boolean")
    before = W.partitionBy("path").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    begun = summed.withColumn("in_string", F.coalesce(F.sum("parity").over(before) % 2, F.lit(0)) == 1)
    begun = begun.withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    begun = begun.withColumns({"depth": F.coalesce(F.sum("change").over(before), F.lit(0)), "base": F.when(F.col("is_array"), 1).otherwise(0).cast("long")})
    return begun.select("path", "first", "last", "size", "in_string", "depth", "base").repartition("path", "first").mapInArrow(_reading, "path string, at long, object string")


def _wire(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _wire(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_wire(kind.elementType))
    return T.StringType() if isinstance(kind, T.TimestampNTZType) else kind


def _typed(expr: str, kind: T.DataType) -> str:
    """SQL that turns a value as it is in the file into the type of the table: a zone is honoured, then dropped, since times are UTC."""
    if isinstance(kind, T.TimestampNTZType):
        return f"try_cast(try_cast({expr} AS TIMESTAMP) AS TIMESTAMP_NTZ)"
    if isinstance(kind, T.StructType):
        return f"if({expr} IS NULL, null, named_struct(" + ", ".join(f"'{f.name}', {_typed(f'{expr}.{f.name}', f.dataType)}" for f in kind.fields) + "))"
    if isinstance(kind, T.ArrayType) and _wire(kind) != kind:
        return f"transform({expr}, e -> {_typed('e', kind.elementType)})"
    return expr


def read_objects(spark: SparkSession, path: str, schema: T.StructType, names: dict[str, str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The objects at ``path`` as rows of ``schema`` with ``_path``, ``_at`` and ``_corrupt`` (the text of an element that is no such object, else null).

    ``names`` has other names that columns have in files; either is read.
    """
    names = names or {}
    wire = T.StructType([*_wire(schema).fields, *[T.StructField(n, _wire(schema[c].dataType)) for c, n in names.items()], T.StructField("_corrupt", T.StringType())])
    parsed = json_objects(spark, path, range_bytes).select("path", "at", F.from_json("object", wire, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "object")
    columns = []
    for f in schema.fields:
        raw = f"coalesce(r.{f.name}, r.{names[f.name]})" if f.name in names else f"r.{f.name}"
        columns.append(f"{_typed(raw, f.dataType)} AS {f.name}")
    return parsed.selectExpr(*columns, "path AS _path", "at AS _at", "if(startswith(ltrim(object), '{'), r._corrupt, object) AS _corrupt")


def _bracketing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = True
    for batch in batches:
        lines = batch.column(0).to_pylist()
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([("[" if first and not k else ",") + x for k, x in enumerate(lines)])], ["value"])
            first = False
    if not first:
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])


def write_objects(df: DataFrame, path: str) -> None:
    """``df`` as JSON array files below ``path``, one for each task that has rows; times in ISO form with microseconds and Z, nulls written."""
    options = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "ignoreNullFields": "false"}
    df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), options).alias("value")).mapInArrow(_bracketing, "value string").write.mode("overwrite").text(path)
