"""Column layouts. Inputs are always read with one of these, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())


RAW_RECORD = {
    "schema_version": "STRING",
    "raw_record_id": "STRING",
    "session_id": "STRING",
    "first_seen_at": "TIMESTAMP",
    "source_file": "STRING",
    "window_id": "INT",
    "rotation_index": "INT",
    "file_mtime": "TIMESTAMP",
    "file_size": "BIGINT",
    "file_hash": "STRING",
    "record_index": "INT",
    "record_offset": "INT",
    "raw_record_hash": "STRING",
    "meta_fields": "ARRAY<STRING>",
    "event_group": "STRING",
    "sequence_hint": "STRING",
    "message_token_count": "STRING",
    "display": "STRUCT<color_code: STRING>",
    "raw_message_hex": "STRING",
    "visible_text": "STRING",
    "message_time_text": "STRING",
    "message_time_precision": "STRING",
    "message_unix_time_hint": "BIGINT",
    "message_time_at": "TIMESTAMP",
    "is_marker": "BOOLEAN",
    "marker_keyword": "STRING",
    "parse_status": "STRING",
    "parse_error": "STRING",
}

# As stored in JSON lines: the long-like fields are read as text and coerced afterwards.
CANONICAL_JSON = {
    "schema_version": "STRING",
    "canonical_record_id": "STRING",
    "session_id": "STRING",
    "order": "STRING",
    "first_seen_at": "TIMESTAMP",
    "last_seen_at": "TIMESTAMP",
    "source_windows": "ARRAY<INT>",
    "source_files": "ARRAY<STRING>",
    "source_raw_record_ids": "ARRAY<STRING>",
    "event_group": "STRING",
    "sequence_hint_min": "STRING",
    "sequence_hint_max": "STRING",
    "visible_text": "STRING",
    "message_time_text": "STRING",
    "message_time_precision": "STRING",
    "is_marker": "BOOLEAN",
    "marker_keyword": "STRING",
    "canonical_key": "STRING",
}

SESSION_JSON = {
    "schema_version": "STRING",
    "raw_schema_version": "STRING",
    "canonical_schema_version": "STRING",
    "collector_version": "STRING",
    "session_id": "STRING",
    "status": "STRING",
    "started_at": "TIMESTAMP",
    "ended_at": "TIMESTAMP",
    "temp_dir": "STRING",
    "output_dir": "STRING",
    "encoding": "STRING",
    "timezone": "STRING",
    "watch_files": "ARRAY<STRING>",
    "manually_completed_at": "TIMESTAMP",
}

STATS_JSON = {
    "raw_records_written": "BIGINT",
    "canonical_records_written": "BIGINT",
    "duplicate_raw_records_skipped": "BIGINT",
    "duplicate_canonical_records_skipped": "BIGINT",
    "baseline_records_skipped": "BIGINT",
    "parse_errors": "BIGINT",
    "decode_errors": "BIGINT",
    "gap_warnings": "BIGINT",
    "last_seen_at": "TIMESTAMP",
}

EXCLUSIONS_JSON = {
    "schema_version": "INT",
    "records": "ARRAY<STRUCT<session_id: STRING, canonical_record_id: STRING>>",
    "groups": "ARRAY<STRUCT<session_id: STRING, event_group: STRING>>",
}

ALIAS_JSON = {
    "schema_version": "INT",
    "session_id": "STRING",
    "alias": "STRING",
}

SNAPSHOT = {
    "path": "STRING",
    "modificationTime": "TIMESTAMP",
    "length": "BIGINT",
    "content": "BINARY",
}

# What the analysis operators read. `read_index` is the position in the stored log: it settles ties.
LOG_COLUMNS = {
    "session_id": "string",
    "session_folder": "string",
    "canonical_record_id": "string",
    "event_group": "string",
    "order": "bigint",
    "read_index": "bigint",
    "sequence_hint_min": "bigint",
    "visible_text": "string",
    "message_time_text": "string",
    "first_seen_at": "timestamp",
    "last_seen_at": "timestamp",
    "is_marker": "boolean",
    "marker_keyword": "string",
}


def as_log(df: DataFrame) -> DataFrame:
    """Give any line table the columns the analysis operators expect, keeping the others.

    A missing ``read_index`` is taken from ``order``; other missing columns become null.
    """
    have = set(df.columns)
    if not {"session_id", "event_group", "visible_text"} <= have:
        raise ValueError("a log needs at least session_id, event_group and visible_text")
    added = {}
    for name, kind in LOG_COLUMNS.items():
        if name in have:
            continue
        if name == "read_index" and "order" in have:
            added[name] = F.col("order").cast("bigint")
        elif name == "session_folder":
            added[name] = F.col("session_id")
        elif name == "is_marker":
            added[name] = F.lit(False)
        else:
            added[name] = F.lit(None).cast(kind)
    return df.withColumns(added) if added else df
