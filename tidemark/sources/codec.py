"""The two binary record formats: encoded by column expressions, decoded from whole files.

Table entry: key length (u32, big-endian), key, value length, value, tombstone byte; trailer: time (i64) and, in version 2,
file number (u64), both little-endian. Log record: type byte (1: tombstone), key length and value length (u32,
little-endian), key, value. A tombstone has no value.
"""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 1 << 30


def _big(n: Column) -> Column:
    return F.lpad(F.hex(n), 8, "0")


def _little(n: Column, digits: int = 8) -> Column:
    whole = F.lpad(F.hex(n), digits, "0")
    return F.concat(*[F.substring(whole, k, 2) for k in range(digits - 1, 0, -2)])


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def entry_hex() -> Column:
    """A table entry of columns key, val, tombstone."""
    val = F.when(F.col("tombstone"), F.lit("")).otherwise(_text("val"))
    return F.concat(
        _big(F.octet_length("key")), F.hex(F.col("key").cast("binary")), _big(F.octet_length(val)), F.hex(val.cast("binary")), F.when(F.col("tombstone"), "01").otherwise("00")
    )


def record_hex() -> Column:
    """A log record of columns key, val, tombstone."""
    val = F.when(F.col("tombstone"), F.lit("")).otherwise(_text("val"))
    return F.concat(
        F.when(F.col("tombstone"), "01").otherwise("00"), _little(F.octet_length("key")), _little(F.octet_length(val)), F.hex(F.col("key").cast("binary")), F.hex(val.cast("binary"))
    )


def encoded_tables(tables: DataFrame, version: int = 2) -> DataFrame:
    """(file_number, level, content): each table as one file's bytes, entries in key order; the trailer's time is the newest
    seq."""
    rows = tables.groupBy("file_number").agg(
        F.sort_array(F.collect_list(F.struct("key", entry_hex().alias("hex")))).alias("rows"), F.max("seq").alias("ts"), F.max("level").alias("level")
    )
    trailer = _little(F.col("ts"), 16)
    if version == 2:
        trailer = F.concat(trailer, _little(F.col("file_number"), 16))
    return rows.select("file_number", "level", F.unhex(F.concat(F.array_join("rows.hex", ""), trailer)).alias("content"))


def encoded_log(log: DataFrame, segment: Column) -> DataFrame:
    """(segment, content): the log's records of each segment in order of seq."""
    rows = log.groupBy(segment.alias("segment")).agg(F.sort_array(F.collect_list(F.struct("seq", record_hex().alias("hex")))).alias("rows"))
    return rows.select("segment", F.unhex(F.array_join("rows.hex", "")).alias("content"))


def decode_entries(data: bytes, version: int = 2) -> tuple[list[tuple[str, str | None, bool]], int, int | None]:
    """Entries, time and file number of a table file; raises ValueError where bytes are missing."""
    size = 16 if version == 2 else 8
    if len(data) < size:
        raise ValueError("a table file is shorter than its trailer")
    body, at, out = data[: len(data) - size], 0, []

    def piece() -> bytes:
        nonlocal at
        if at + 4 > len(body):
            raise ValueError("a table entry is cut off")
        (n,) = struct.unpack_from(">I", body, at)
        if at + 4 + n > len(body):
            raise ValueError("a table entry is cut off")
        at += 4 + n
        return body[at - n : at]

    while at < len(body):
        key, val = piece(), piece()
        if at >= len(body):
            raise ValueError("a table entry is cut off")
        dead = body[at] != 0
        at += 1
        out.append((key.decode(), None if dead else val.decode(), dead))
    time = struct.unpack_from("<q", data, len(data) - size)[0]
    return out, time, struct.unpack_from("<Q", data, len(data) - 8)[0] if version == 2 else None


def decode_records(data: bytes) -> list[tuple[str, str | None, bool]]:
    """Records of a log file; a cut-off last record is ignored, an impossible length raises ValueError."""
    at, out = 0, []
    while at + 9 <= len(data):
        kind, n, m = struct.unpack_from("<BII", data, at)
        if n > LONGEST or m > LONGEST:
            raise ValueError("a log record's length is impossible")
        if at + 9 + n + m > len(data):
            break
        key, val = data[at + 9 : at + 9 + n], data[at + 9 + n : at + 9 + n + m]
        out.append((key.decode(), None if kind == 1 else val.decode(), kind == 1))
        at += 9 + n + m
    return out


def read_tables(files: DataFrame, version: int = 2, number: str | None = None, level: str | None = None) -> DataFrame:
    """Entries of a DataFrame with a `content` column, such as spark.read.format("binaryFile") gives. Version 1 has no file
    number inside; `number` names a column that has it. `level` names a column to carry along."""

    def run(frames):
        for frame in frames:
            for given, at, data in zip(frame["number"], frame["level"], frame["content"]):
                rows, time, own = decode_entries(bytes(data), version)
                out = pd.DataFrame(rows, columns=["key", "val", "tombstone"]).assign(ts=time, file_number=given if number else own)
                yield out.assign(level=at) if level else out

    given, at = F.col(number) if number else F.lit(None), F.col(level) if level else F.lit(None)
    kind = "key string, val string, tombstone boolean, ts bigint, file_number bigint" + (", level int" if level else "")
    return files.select(given.cast("long").alias("number"), at.cast("int").alias("level"), "content").mapInPandas(run, kind)


def read_log(files: DataFrame, segment: str = "segment") -> DataFrame:
    """Records of log files with their place in the segment."""

    def run(frames):
        for frame in frames:
            for name, data in zip(frame[segment], frame["content"]):
                rows = decode_records(bytes(data))
                yield pd.DataFrame(rows, columns=["key", "val", "tombstone"]).assign(segment=name, place=range(len(rows)))

    return files.select(segment, "content").mapInPandas(run, "key string, val string, tombstone boolean, segment bigint, place bigint")


def open_tables(spark, path: str, version: int = 2) -> DataFrame:
    """Entries of all table files at a path or glob; a missing, empty or cut-off file raises."""
    return read_tables(spark.read.format("binaryFile").load(path), version)


def open_log(spark, path: str) -> DataFrame:
    """Records of all log files wal-<id> at a path or glob; segment is the id."""
    files = spark.read.format("binaryFile").load(path)
    return read_log(files.withColumn("segment", F.regexp_extract("path", r"wal-(\d+)$", 1).cast("long")))


def write_files(files: DataFrame, folder: str, name: Column) -> DataFrame:
    """Writes each `content` as a file of that name in a folder (a URI that pyarrow knows, or a shared path), from the tasks
    that hold it; gives (path, bytes). A file appears whole: it is written beside and then moved, so a task may run again."""

    def run(frames):
        for frame in frames:
            system, base = FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
            for file, data in zip(frame["name"], frame["content"]):
                path, draft = f"{base}/{file}", f"{base}/_{file.replace('/', '-')}.{uuid.uuid4().hex}"
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(draft) as out:
                    out.write(bytes(data))
                system.move(draft, path)
            yield pd.DataFrame({"path": [f"{base}/{file}" for file in frame["name"]], "bytes": [len(x) for x in frame["content"]]})

    return files.select(name.cast("string").alias("name"), "content").mapInPandas(run, "path string, bytes bigint")


def write_tables(tables: DataFrame, folder: str, version: int = 2) -> DataFrame:
    """A file table-<number> for each table."""
    return write_files(encoded_tables(tables, version), folder, F.concat(F.lit("table-"), F.col("file_number").cast("string")))


def write_levels(tables: DataFrame, folder: str, version: int = 2) -> DataFrame:
    """A file level-<level>/table-<number> for each table."""
    name = F.concat(F.lit("level-"), F.col("level").cast("string"), F.lit("/table-"), F.col("file_number").cast("string"))
    return write_files(encoded_tables(tables, version), folder, name)


def open_levels(spark, folder: str, most: int, version: int = 2) -> DataFrame:
    """Entries with the level of all files level-<level>/table-<number> in a folder, up to level `most`; folders and files of
    other names are left out."""
    found = spark.read.format("binaryFile").load(f"{folder}/level-*/table-*")
    level, number = (F.regexp_extract("path", r"/level-([0-9]+)/table-([0-9]+)$", k) for k in (1, 2))
    files = found.where(level != "").select(level.cast("int").alias("level"), number.cast("long").alias("number"), "content")
    return read_tables(files.where(F.col("level") <= most), version, "number", "level")


def write_log(log: DataFrame, segment: Column, folder: str) -> DataFrame:
    """A file wal-<segment> for each segment of the log, as open_log reads it."""
    return write_files(encoded_log(log, segment), folder, F.concat(F.lit("wal-"), F.col("segment").cast("string")))
