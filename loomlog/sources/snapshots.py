"""Rotating binary snapshots: file scan and record cutter."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomlog.functions import fixed_values as fixed
from loomlog.schemas import SNAPSHOT, ddl
from loomlog.session import bounded_batches
from loomlog.sources.changed_files import CHANGED, stream_changes

RECORD_COLUMNS = (
    "record_index INT, record_offset INT, record_bytes BINARY, meta_fields ARRAY<STRING>, "
    "message_bytes BINARY, message_text STRING, parse_status STRING, parse_error STRING"
)
FILE_COLUMNS = (
    "path STRING, source_file STRING, window_id INT, rotation_index INT, file_mtime TIMESTAMP, "
    "file_size BIGINT, file_hash STRING"
)


# Records after which a task hands on what it has cut.
FRAME_RECORDS = 2_000


def check_slots(slots: int) -> int:
    if not 0 <= slots <= fixed.MAX_SLOTS:
        raise ValueError(f"slots must be between 0 and {fixed.MAX_SLOTS}")
    return slots


def shape_snapshots(files: DataFrame, windows: Sequence[int] = (1, 2), slots: int = fixed.MAX_SLOTS) -> DataFrame:
    """Keep watched files by name and describe them. Works on batch and streaming file rows."""
    name = F.element_at(F.split("path", "/"), -1)
    window = F.regexp_extract(F.col("source_file"), fixed.SNAPSHOT_NAME, 1).try_cast("int")
    rotation = F.regexp_extract(F.col("source_file"), fixed.SNAPSHOT_NAME, 2).try_cast("int")
    return (
        files.withColumn("source_file", name)
        .withColumns({"window_id": window, "rotation_index": rotation})
        .filter(F.col("window_id").isin(*windows) & (F.col("rotation_index") < check_slots(slots)))
        .select(
            "path", "source_file", "window_id", "rotation_index",
            F.col("modificationTime").alias("file_mtime"),
            F.col("length").alias("file_size"),
            F.sha1("content").alias("file_hash"),
            "content",
        )
    )


def scan_snapshots(
    spark: SparkSession, path: str, windows: Sequence[int] = (1, 2), slots: int = fixed.MAX_SLOTS
) -> DataFrame:
    """All watched snapshot files under a folder (sub-folders included)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.log")
    return shape_snapshots(files.load(path), windows, slots)


def stream_snapshots(
    spark: SparkSession, landing: str, windows: Sequence[int] = (1, 2), slots: int = fixed.MAX_SLOTS,
    files_per_batch: int = 1000,
) -> DataFrame:
    """The same scan as a stream of files that land once; see :func:`stream_rewritten` for files that are rewritten."""
    files = (
        spark.readStream.format("binaryFile").schema(ddl(SNAPSHOT))
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.log")
        .option("maxFilesPerTrigger", files_per_batch)
    )
    return shape_snapshots(files.load(landing), windows, slots)


def stream_rewritten(
    spark: SparkSession, folder: str, windows: Sequence[int] = (1, 2), slots: int = fixed.MAX_SLOTS,
    listings: str | None = None,
) -> DataFrame:
    """The same scan as a stream of files that are rewritten in place: a changed file comes again, an unchanged one never.

    Many folders need ``listings``, see :func:`stream_changes`.
    """
    changed = stream_changes(spark, folder, listings=listings).filter(F.col("change") == CHANGED).drop("change")
    return shape_snapshots(changed, windows, slots)


_HIDDEN = re.compile(b"[" + re.escape(bytes(fixed.CONTROL_PREFIXES)) + rb"](?s:.)?|\x00")


def _visible(message: bytes) -> bytes:
    """Message bytes without NUL, and without control bytes and the byte after each."""
    return _HIDDEN.sub(b"", message)


def cut_records(content: bytes) -> Iterator[tuple]:
    """Records of one snapshot; a file without a full header gives one row without an index."""
    header, count = fixed.HEADER_BYTES, fixed.META_FIELDS
    if len(content) < header:
        yield None, None, None, None, None, None, "error", f"shorter than the {header}-byte header"
        return
    starts = set()
    for index in range(fixed.HEADER_OFFSETS):
        offset = int.from_bytes(content[2 * index : 2 * index + 2], "little")
        if not header <= offset < len(content):
            continue
        # An offset may point into a record: its start is behind the NUL before it.
        start = max(content.rfind(b"\0", header, offset) + 1, header)
        if start in starts or start >= len(content):
            continue
        starts.add(start)
        stop = content.find(b"\0", start)
        body = content[start:] if stop < 0 else content[start : stop + 1]
        parts = body.split(b",", count)
        whole = len(parts) > count
        meta = [p.decode("ascii", "replace").replace("�", "?") for p in parts[:-1]]
        message = parts[-1] if whole else b""
        error = None
        if not whole:
            error = f"fewer than {count} meta fields"
        elif stop < 0:
            error = "no NUL at the end of the record"
        text = _visible(message).decode(fixed.TEXT_ENCODING, "replace")
        yield index, offset, body, meta, message, text, "error" if error else "success", error


def _cut_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in RECORD_COLUMNS.split(", ")]
    for files in frames:
        about = files.drop(columns="content")
        shaped = lambda rows: pd.DataFrame(rows, columns=[*about.columns, *names]).astype(
            {"record_index": "Int32", "record_offset": "Int32"}
        )
        rows = []
        for facts, content in zip(about.itertuples(index=False, name=None), files["content"]):
            rows += [(*facts, *record) for record in cut_records(content)]
            if len(rows) >= FRAME_RECORDS:
                yield shaped(rows)
                rows = []
        yield shaped(rows)


def explode_snapshot_records(snapshots: DataFrame) -> DataFrame:
    """One row per record. Files are small (16-bit offsets), so a row of bytes fits any task.

    A task holds files of a bounded number of bytes at a time, and hands records on as soon as there are some thousand.
    """
    bounded_batches(snapshots.sparkSession)
    return snapshots.mapInPandas(_cut_files, f"{FILE_COLUMNS}, {RECORD_COLUMNS}")
