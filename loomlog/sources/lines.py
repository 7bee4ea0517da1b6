"""JSON lines in and out: canonical logs, raw records, and the flat view of raw records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomlog.functions.numbers import flex_long
from loomlog.functions.text import css_color, is_blank
from loomlog.operators.collection import CANONICAL_KEYS, arrival, with_source_ids
from loomlog.operators.scans import dense_order
from loomlog.schemas import CANONICAL_JSON, RAW_RECORD, ddl
from loomlog.sources.documents import as_json, misfits, parse_document, types_of

CANONICAL_FILE = "canonical_records.jsonl"
RAW_FILE = "raw_records.jsonl"
# The types that values may have in a stored line.
_KINDS = {"STRING": ("STRING",), "TIMESTAMP": ("STRING", "TIMESTAMP"), "BOOLEAN": ("BOOLEAN",)}
_LONGS = ("order", "sequence_hint_min", "sequence_hint_max")
CANONICAL_TYPES = {
    n: ("BIGINT", "STRING") if n in _LONGS else _KINDS.get(kind, ("ARRAY",)) for n, kind in CANONICAL_JSON.items()
}
META_COLUMNS = tuple(f"meta{i}" for i in range(1, 22))
FLAT_COLUMNS = (
    "schema_version", "raw_record_id", "session_id", "first_seen_at", "source_file", "window_id",
    "rotation_index", "file_mtime", "file_size", "file_hash", "record_index", "record_offset",
    "raw_record_hash", *META_COLUMNS, "event_group", "sequence_hint", "message_token_count",
    "display.color_code", "raw_message_hex", "visible_text", "message_time_text",
    "message_time_precision", "is_marker", "marker_keyword", "parse_status", "parse_error",
)


def folder_of(path: Column | str) -> Column:
    """Folder of a file, spelled alike whether the path comes from a scan or from the file index."""
    plain = F.replace(F.regexp_replace(path, "^file:/+", "file:/"), F.lit("%20"), F.lit(" "))
    return F.regexp_extract(plain, "^(.*)/[^/]*$", 1)


def read_lines(spark: SparkSession, paths: str | Sequence[str], name: str) -> DataFrame:
    """Text lines with their file, folder and place.

    ``paths`` are session folders, or a root holding them. ``read_index`` grows along each file:
    the start of the file split plus the row within it, which never reaches the next split.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    text = reader.text(list(paths) if not isinstance(paths, str) else paths)
    row = F.monotonically_increasing_id()
    return text.select(
        F.regexp_replace("value", "^\ufeff", "").alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        row.alias("row_id"),
    ).withColumns(
        {
            "session_folder": folder_of("file_path"),
            "read_index": F.col("block_start") + F.col("row_id").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )


def number_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add the 1-based line number to the ``wanted`` lines, from counts per file split."""
    splits = lines.groupBy("file_path", "block_start").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("row_id").alias("_first")
    )
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    return wanted.join(starts, ["file_path", "block_start"]).withColumn(
        "line_number", F.col("_offset") + F.col("row_id") - F.col("_first") + 1
    ).drop("_rows", "_first", "_offset")


def read_canonical(
    spark: SparkSession, paths: str | Sequence[str], hint_mode: str = "decimal_then_hex"
) -> tuple[DataFrame, DataFrame]:
    """(log, line errors) of one or many session folders.

    Keys may be in any case; comments and trailing commas are allowed. Blank lines are skipped; lines that are no object
    or hold a value of a wrong type come back as errors with their number and text.
    """
    lines = read_lines(spark, paths, CANONICAL_FILE)
    filled = lines.filter(~is_blank("line"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    document = filled.withColumn("_document", parse_document("line"))
    fitting = F.size(misfits(types_of("_document"), CANONICAL_TYPES)) == 0
    parsed = document.withColumn(
        "_r", F.when(fitting, F.from_json(F.to_json("_document"), ddl({**CANONICAL_JSON, "_bad": "STRING"}), options))
    ).drop("_document")
    good = parsed.filter(F.col("_r").isNotNull() & F.col("_r._bad").isNull())
    log = good.select("_r.*", "session_folder", "read_index").drop("_bad").withColumns(
        {
            **{n: flex_long(n, hint_mode) for n in ("order", "sequence_hint_min", "sequence_hint_max")},
            "is_marker": F.coalesce("is_marker", F.lit(False)),
        }
    )
    bad = parsed.filter(F.col("_r").isNull() | F.col("_r._bad").isNotNull())
    errors = number_lines(lines, bad).select(
        "session_folder", "line_number", "line", F.lit("unreadable_json").alias("message")
    )
    return log, errors


def canonical_documents(log: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Canonical lines as lines of a store, in order; ``session_folder`` names the folder."""
    full = log if sources is None else with_source_ids(log, sources)
    shown = [n for n in CANONICAL_JSON if n in full.columns]
    return full.select(
        "session_folder", F.lit(CANONICAL_FILE).alias("file"), F.col("order").cast("bigint").alias("place"),
        as_json(full, shown).alias("line"),
    )


def raw_documents(raw: DataFrame) -> DataFrame:
    """Raw records as lines of a store, in the order of their arrival."""
    shown = [n for n in RAW_RECORD if n in raw.columns]
    placed = dense_order(raw, [arrival(raw), "raw_record_id"], ["session_folder"], "place")
    return placed.select("session_folder", F.lit(RAW_FILE).alias("file"), "place", as_json(placed, shown).alias("line"))


def write_canonical(log: DataFrame, path: str, sources: DataFrame | None = None, fmt: str = "json") -> None:
    """Full replace, one folder per session, lines in order.

    With ``sources`` the record ids are written inline, and in long form as a table under ``<path>_sources``.
    """
    full = log if sources is None else with_source_ids(log, sources)
    stored = [n for n in CANONICAL_JSON if n in full.columns]
    spread = full.select(*stored).repartitionByRange("session_id", "order").sortWithinPartitions("session_id", "order")
    spread.write.mode("overwrite").partitionBy("session_id").format(fmt).save(path)
    if sources is not None:
        sources.select(*CANONICAL_KEYS, "raw_record_id").write.mode("overwrite").partitionBy("session_id").parquet(
            path.rstrip("/") + "_sources"
        )


def read_canonical_table(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """What :func:`write_canonical` wrote."""
    reader = spark.read.format(fmt)
    return (reader.schema(ddl(CANONICAL_JSON)) if fmt == "json" else reader).load(path)


def write_raw(raw: DataFrame, path: str, fmt: str = "json") -> None:
    """Append raw records; nulls are left out of the JSON."""
    stored = raw.select(*[n for n in RAW_RECORD if n in raw.columns])
    writer = stored.write.mode("append").partitionBy("session_id").format(fmt)
    (writer.option("ignoreNullFields", True) if fmt == "json" else writer).save(path)


def read_raw(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw records as written by :func:`write_raw`, or plain JSON-lines session folders."""
    reader = spark.read.schema(ddl(RAW_RECORD)).option("recursiveFileLookup", fmt == "jsonl")
    if fmt == "jsonl":
        return reader.option("pathGlobFilter", RAW_FILE).json(path)
    return reader.format(fmt).load(path)


def decode_escapes(text: Column) -> Column:
    """Turn literal ``\\uXXXX`` runs left in a text into their characters, via a JSON string."""
    quoted = F.concat(F.lit('{"t":"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"}'))
    revived = F.regexp_replace(quoted, r"\\\\u([0-9a-fA-F]{4})", r"\\u$1")
    decoded = F.from_json(F.regexp_replace(revived, "[\\x00-\\x1f]", " "), "t STRING").getField("t")
    return F.when(F.regexp_like(text, F.lit(r"\\u[0-9a-fA-F]{4}")), F.coalesce(decoded, text)).otherwise(text)


def extra_columns(parsed: DataFrame) -> list[str]:
    """Keys beyond the base columns, found by one aggregate over the data (names only)."""
    known = {*FLAT_COLUMNS, "meta_fields", "display"}
    keys = parsed.select(F.explode(F.map_keys("_all")).alias("k")).distinct().filter(~F.col("k").isin(*known))
    return sorted(r.k for r in keys.collect())


def flatten_raw(spark: SparkSession, paths: str | Sequence[str], name: str = RAW_FILE, extras: bool = True) -> DataFrame:
    """Raw JSON lines as one flat text table: base columns first, then whatever else occurs.

    ``meta_fields`` becomes ``meta1..meta21``, ``display`` is flattened, other nested values stay JSON
    text, missing values are empty, and a bad line becomes a row with ``parse_status = error``.
    """
    lines = read_lines(spark, paths, name)
    return flatten_lines(number_lines(lines, lines.filter(~is_blank("line"))), extras)


def flatten_lines(lines: DataFrame, extras: bool = True) -> DataFrame:
    """The flat table of JSON text in ``line`` (with ``line_number``)."""
    parsed = lines.withColumns(
        {
            "_all": F.from_json("line", "MAP<STRING,STRING>", {"mode": "PERMISSIVE"}),
            "_nested": F.from_json("line", "meta_fields ARRAY<STRING>, display MAP<STRING,STRING>"),
        }
    )
    ok = F.col("_all").isNotNull() & F.rlike(F.col("line"), F.lit(r"^\s*\{[\s\S]*\}\s*$"))
    more = extra_columns(parsed) if extras else []

    def value(column: str) -> Column:
        if column in META_COLUMNS:
            found = F.get(F.col("_nested.meta_fields"), META_COLUMNS.index(column))
        elif column.startswith("display."):
            found = F.col("_nested.display")[column.removeprefix("display.")]
        else:
            found = F.col("_all")[column]
        found = F.coalesce(found, F.lit(""))
        return decode_escapes(found) if column == "visible_text" else found

    shown = {c: F.when(ok, value(c)).otherwise(F.lit("")) for c in (*FLAT_COLUMNS, *more)}
    shown["parse_status"] = F.when(ok, value("parse_status")).otherwise("error")
    shown["parse_error"] = F.when(ok, value("parse_error")).otherwise("unreadable_json")
    return parsed.select(
        F.col("line_number").cast("string").alias("__line_number"),
        *[c.alias(n) for n, c in shown.items()],
        F.when(~ok, F.col("line")).otherwise("").alias("raw_line"),
    )


def replay(flat: DataFrame, window: int) -> DataFrame:
    """Lines of one window with the colour they were shown in."""
    text = F.when(F.col("visible_text") == "", "\u00a0").otherwise(F.col("visible_text"))
    return flat.filter(F.col("window_id") == F.lit(str(window))).select(
        "__line_number", "record_index", text.alias("text"), css_color("`display.color_code`").alias("color")
    )
