"""SHA-1 keys. The bytes hashed are part of the stored format and must not change."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomlog.functions.text import col


def canonical_key(event_group: Column | str, text: Column | str) -> Column:
    return F.sha1(F.concat(F.coalesce(col(event_group), F.lit("")), F.coalesce(col(text), F.lit(""))))


def body_hash(record_bytes: Column | str) -> Column:
    """Identity of a record body, whatever file or slot it was read from."""
    return F.sha1(col(record_bytes))


def raw_record_id(file_name: Column | str, record_index: Column | str, record_bytes: Column | str) -> Column:
    prefix = F.encode(F.concat(col(file_name), col(record_index).cast("string")), "UTF-8")
    return F.sha1(F.concat(prefix, col(record_bytes)))
