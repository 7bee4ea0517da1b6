"""Raw records, snapshot files and JSON lines derived from the derived log."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomlog.functions import fixed_values as fixed
from loomlog.functions.hashing import raw_record_id
from loomlog.plans.derived import derived_log
from loomlog.session import bounded_batches
from loomlog.sources.session_store import opened_root

# Each line is seen in one or two windows, and some sightings are read twice. Plain SQL over a log
# line and the sighting number k (0, 1, 2), read alike by Spark and DuckDB.
SIGHTED = "k = 0 OR (k = 1 AND read_index % 2 = 0) OR (k = 2 AND read_index % 3 = 0)"
WINDOW = "CASE WHEN k = 1 THEN 2 ELSE 1 END"
FILE = f"CAST({WINDOW} AS STRING) || '_' || CAST(read_index % 20 AS STRING) || '.log'"
# Texts of different length, some of them no decimal numbers: the comparison depends on arrival.
HINT = (
    "CASE WHEN read_index % 11 = 0 THEN CASE k WHEN 0 THEN '9' WHEN 1 THEN '1a' ELSE '10' END"
    " WHEN read_index % 5 = 0 THEN NULL"
    " ELSE CAST(100 + read_index % 900 - k * 7 AS STRING) END"
)
# The same body in the same file and place is the same raw record, so the third sighting repeats the first.
BODY = "COALESCE(event_group, '') || ',' || visible_text"
RAW_COLUMNS = {
    "session_id": "session_id",
    "source_file": FILE,
    "window_id": WINDOW,
    "record_index": "CAST(read_index % 50 AS INT)",
    "event_group": "event_group",
    "sequence_hint": HINT,
    "visible_text": "visible_text",
    "body": BODY,
    "file_mtime": "first_seen_at + k * INTERVAL '1' SECOND",
    "first_seen_at": "first_seen_at + k * INTERVAL '1' SECOND",
    "message_time_text": "message_time_text",
    "is_marker": "is_marker",
    "marker_keyword": "marker_keyword",
    "parse_status": "CASE WHEN read_index % 41 = 0 THEN 'error' ELSE 'success' END",
}
RAW_SELECTED = ",\n".join(f"{sql} AS {name}" for name, sql in RAW_COLUMNS.items())
RAW_CTE = f"""raw AS MATERIALIZED (SELECT *, sha1(source_file || CAST(record_index AS STRING) || body) AS raw_record_id
FROM (SELECT {RAW_SELECTED} FROM (SELECT *, unnest([0, 1, 2]) AS k FROM log) WHERE {SIGHTED}))"""


def derived_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records of the derived log, duplicates included."""
    sightings = derived_log(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    raw = sightings.filter(F.expr(SIGHTED)).select(*[F.expr(sql).alias(n) for n, sql in RAW_COLUMNS.items()])
    return raw.withColumns(
        {
            "raw_record_id": raw_record_id("source_file", "record_index", F.encode("body", "UTF-8")),
            "message_time_precision": F.lit(None).cast("string"),
        }
    )


LINES_PER_FILE = 40


def _file(lines: list[dict]) -> bytes:
    """Bytes of one snapshot file from its lines (40 numbers at most)."""
    body, offsets = [], []
    at = fixed.HEADER_BYTES
    for line in lines:
        offsets.append(at)
        meta = [b"0"] * fixed.META_FIELDS
        meta[fixed.META_COLOR] = b"80ff00aa"
        meta[fixed.META_GROUP] = (line["event_group"] or "").encode("ascii")
        meta[fixed.META_SEQUENCE] = (line["hint"] or "").encode("ascii")
        message = b"\x1e\x01" + line["visible_text"].encode(fixed.TEXT_ENCODING) + b"\x7f1"
        body.append(b",".join(meta) + b"," + message + b"\0")
        at += len(body[-1])
    header = b"".join(o.to_bytes(2, "little") for o in offsets).ljust(fixed.HEADER_BYTES, b"\0")
    return header + b"".join(body)


def _pack_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content = [_file(lines) for lines in batch.column("lines").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), batch.column("modificationTime"), pa.array(map(len, content), pa.int64()),
             pa.array(content, pa.binary())],
            names=["path", "modificationTime", "length", "content"],
        )


def derived_snapshots(spark: SparkSession, sf_dir: str, chosen: Column | None = None) -> DataFrame:
    """Binary snapshot files holding the derived log, 40 line numbers to a file; ``chosen`` of the ``file_no``, or all.

    Lines without a number have no file.
    """
    bounded_batches(spark)
    lines = derived_log(spark, sf_dir).withColumn("file_no", F.floor(F.col("read_index") / LINES_PER_FILE))
    lines = lines.filter(F.col("file_no").isNotNull() if chosen is None else chosen)
    line = F.struct(
        "read_index", "event_group", F.col("sequence_hint_min").cast("string").alias("hint"), "visible_text", "first_seen_at"
    )
    files = lines.groupBy("file_no").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    number = lambda value: value.cast("string")
    path = F.concat(
        F.lit("/log/"), number(F.floor(F.col("file_no") / 20)), F.lit("/"), number(1 + F.pmod("file_no", F.lit(2))), F.lit("_"),
        number(F.pmod("file_no", F.lit(20))), F.lit(".log"),
    )
    return files.select(
        path.alias("path"), F.col("lines")[0]["first_seen_at"].alias("modificationTime"), "lines"
    ).mapInArrow(_pack_files, "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")


def _write_files(frames: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    """Write files under ``root``; a file is whole or not there when it is looked at."""
    for files in frames:
        for path, content in zip(files["path"], files["content"]):
            system, target, _ = opened_root(f"{root}/{path.lstrip('/')}")
            system.create_dir(posixpath.dirname(target), recursive=True)
            hidden = f"{target}.{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as stream:
                stream.write(content)
            system.move(hidden, target)
        yield pd.DataFrame({"files": [len(files)]})


def put_files(files: DataFrame, root: str) -> int:
    """Write binary files (``path``, ``content``) under a shared folder, over those that are there; returns their number."""
    put = files.select("path", "content").mapInPandas(lambda frames: _write_files(frames, root), "files BIGINT")
    return put.agg(F.sum("files")).first()[0] or 0


# One JSON line per event, every tenth of them broken.
JSON_LINE = """CASE WHEN event_id % 10 = 7 THEN '{"session_id": "s' || CAST(event_id AS STRING)
ELSE '{"schema_version":"1.0","session_id":"s' || CAST(event_id AS STRING)
 || '","window_id":' || CAST(1 + event_id % 2 AS STRING)
 || ',"record_index":' || CAST(event_id AS STRING)
 || ',"meta_fields":["m1","' || event_type || '"],"display":{"color_code":"'
 || CASE event_id % 3 WHEN 0 THEN '80ff00aa' WHEN 1 THEN '00aaff' ELSE 'none' END
 || '"},"visible_text":"\\\\u3042 ' || event_type || '","parse_status":null,"props":' || props || '}' END"""


def derived_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text lines made from the events, with their line numbers."""
    from loomlog.plans.derived import read_table

    events = read_table(spark, sf_dir, "events")
    line = F.expr(JSON_LINE.replace("\\\\u", "\\\\\\\\u"))
    return events.select((F.col("event_id") + 1).alias("line_number"), line.alias("line"))
