"""From raw records to canonical lines: projection, duplicate removal, merging, ordering, counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomlog.functions.hashing import body_hash, canonical_key, raw_record_id
from loomlog.functions.numbers import long_or_null, meta_number
from loomlog.functions.text import detect_marker, is_blank, normalize_text
from loomlog.functions.times import extract_message_time
from loomlog.functions import fixed_values as fixed
from loomlog.operators.scans import dense_order
from loomlog.session import Keep

RAW_VERSION = "1.0"
CANONICAL_VERSION = "1.0"
# Where a raw record stands in the order of arrival: file time, file name, path, place in the file.
ARRIVAL = ("file_mtime", "source_file", "path", "record_index")
CANONICAL_KEYS = ["session_id", "canonical_key"]
RAW_KEYS = ["session_id", "raw_record_id"]
# Length of the slices in which hints are folded when their order depends on arrival.
FOLD_SECONDS = 60


def arrival(raw: DataFrame) -> Column:
    return F.struct(*[c for c in ARRIVAL if c in raw.columns])


def snapshot_order(snapshots: DataFrame) -> DataFrame:
    """Snapshots in processing order."""
    return snapshots.orderBy("file_mtime", "source_file", "path")


def _meta(index: int) -> Column:
    return F.get(F.col("meta_fields"), index)


def project_raw(
    records: DataFrame,
    session_id: Column | str,
    seen_at: Column | None = None,
    marker_prefix: str | None = fixed.MARKER_PREFIX,
) -> DataFrame:
    """Raw-record columns from cut records (see the snapshot source)."""
    sid = F.lit(session_id) if isinstance(session_id, str) else session_id
    shaped = records.filter(F.col("record_index").isNotNull()).withColumns(
        {
            "visible_text": normalize_text("message_text"),
            "message_unix_time_hint": meta_number(_meta(fixed.META_UNIX_TIME)),
        }
    )
    shaped = shaped.withColumns(
        {
            "_time": extract_message_time("visible_text"),
            "_keyword": detect_marker("visible_text", marker_prefix),
        }
    )
    color = _meta(fixed.META_COLOR)
    hint = F.col("message_unix_time_hint")
    return shaped.select(
        F.lit(RAW_VERSION).alias("schema_version"),
        raw_record_id("source_file", "record_index", "record_bytes").alias("raw_record_id"),
        sid.alias("session_id"),
        (seen_at if seen_at is not None else F.col("file_mtime")).alias("first_seen_at"),
        "source_file",
        "window_id",
        "rotation_index",
        "file_mtime",
        "file_size",
        "file_hash",
        "record_index",
        "record_offset",
        body_hash("record_bytes").alias("raw_record_hash"),
        "meta_fields",
        _meta(fixed.META_GROUP).alias("event_group"),
        _meta(fixed.META_SEQUENCE).alias("sequence_hint"),
        _meta(fixed.META_TOKENS).alias("message_token_count"),
        F.when(~is_blank(color), F.struct(color.alias("color_code"))).alias("display"),
        F.hex("message_bytes").alias("raw_message_hex"),
        "visible_text",
        F.col("_time.text").alias("message_time_text"),
        F.col("_time.precision").alias("message_time_precision"),
        "message_unix_time_hint",
        F.when(hint > 0, F.timestamp_seconds(hint)).alias("message_time_at"),
        F.col("_keyword").isNotNull().alias("is_marker"),
        F.col("_keyword").alias("marker_keyword"),
        "parse_status",
        "parse_error",
        "path",
    )


def drop_baseline(records: DataFrame, baseline: DataFrame) -> DataFrame:
    """Leave out records whose body was there before the start, whatever slot it has moved to."""
    known = baseline.select(F.col("raw_record_hash").alias("_body")).distinct()
    name = "raw_record_hash" if "raw_record_hash" in records.columns else None
    body = F.col(name) if name else body_hash("record_bytes")
    return records.withColumn("_body", body).join(known, "_body", "left_anti").drop("_body")


def dedupe_raw(raw: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """First arrival of every raw record of a session; none of those whose keys are in ``known``.

    ``min_by`` merges before the shuffle, so a record copied into a third of all rows costs one row
    per input task. Known keys meet the records in the same shuffle.
    """
    fields = [n for n in raw.columns if n not in RAW_KEYS]
    first = F.min_by(F.struct(*fields), arrival(raw)).alias("_first")
    if known is None:
        return raw.groupBy(*RAW_KEYS).agg(first).select(*_unpacked(raw, fields))
    marked = raw.withColumn("_known", F.lit(False)).unionByName(
        known.select(*RAW_KEYS, F.lit(True).alias("_known")), allowMissingColumns=True
    )
    firsts = marked.groupBy(*RAW_KEYS).agg(first, F.bool_or("_known").alias("_known"))
    return firsts.filter(~F.col("_known")).select(*_unpacked(raw, fields))


def _unpacked(raw: DataFrame, fields: list[str]) -> list[Column]:
    return [F.col(f"_first.`{n}`") if n in fields else F.col(n) for n in raw.columns]


def valid_records(raw: DataFrame) -> DataFrame:
    """Only cleanly parsed records become canonical lines."""
    return raw.filter(F.col("parse_status") == "success")


_LINE_FIELDS = (
    "event_group", "visible_text", "message_time_text", "message_time_precision", "is_marker", "marker_keyword",
)


# What merging reads of a raw record, and the keys by which records are known.
_MERGED = {
    "session_id", "raw_record_id", "first_seen_at", "window_id", "source_file", "sequence_hint", "parse_status",
    *_LINE_FIELDS, *ARRIVAL,
}


def line_columns(raw: DataFrame) -> DataFrame:
    """Raw records without what :func:`canonicalize` does not read, so that bodies and meta fields are not shuffled."""
    return raw.select(*[c for c in raw.columns if c in _MERGED])


# What is left of a line's parts, besides ``_first``, when they are merged.
_SETTLED = (
    *CANONICAL_KEYS, "last_seen_at", "source_windows", "source_files", "record_count", "order", "sequence_hint_min",
    "sequence_hint_max", "_regular",
)


def _as_parts(raw: DataFrame) -> DataFrame:
    """Raw records in the shape in which lines are merged."""
    return valid_records(raw).select(
        "session_id",
        line_key().alias("canonical_key"),
        "first_seen_at",
        F.col("first_seen_at").alias("last_seen_at"),
        F.array("window_id").alias("source_windows"),
        F.array("source_file").alias("source_files"),
        F.col("sequence_hint").alias("low"),
        F.col("sequence_hint").alias("high"),
        *_LINE_FIELDS,
        F.lit(1).cast("bigint").alias("record_count"),
        arrival(raw).alias("first_arrival"),
        F.lit(None).cast("bigint").alias("order"),
        F.lit(1).alias("_round"),
    )


def _state_parts(state: DataFrame) -> DataFrame:
    """Canonical lines merged earlier: they come before everything new."""
    return state.select(
        *CANONICAL_KEYS,
        "first_seen_at", "last_seen_at", "source_windows", "source_files",
        F.col("sequence_hint_min").alias("low"),
        F.col("sequence_hint_max").alias("high"),
        *_LINE_FIELDS,
        "record_count", "first_arrival", "order",
        F.lit(0).alias("_round"),
    )


def canonicalize(
    raw: DataFrame, state: DataFrame | None = None, slice_seconds: int = FOLD_SECONDS, keep: Keep | None = None
) -> DataFrame:
    """Merge raw records that show the same text in the same group of a session.

    The first arrival supplies the fields. Windows and files become sorted distinct lists: their
    number is bounded by the two windows and their slots. Raw record ids are not, so they stay in
    long form, see :func:`canonical_sources`. ``state`` holds lines merged before (with ``order``).
    ``keep`` writes what lines are before their hints are folded, and the folded hints: so neither is worked out again by
    those who read the lines more than once, and only lines whose hints were folded are shuffled once more.
    """
    parts = _as_parts(raw)
    if state is not None:
        parts = parts.unionByName(_state_parts(state))
    parts = parts.withColumns(
        {
            "_at": F.struct("_round", "first_arrival"),
            "_low": long_or_null("low"),
            "_high": long_or_null("high"),
        }
    )
    earliest = lambda text, number: F.min_by(text, F.when(number.isNotNull(), F.struct(number, F.col("_at"))))
    plain = lambda text: F.regexp_like(text, F.lit("^[0-9A-Za-z]*$"))
    merged = parts.groupBy(*CANONICAL_KEYS).agg(
        F.min_by(F.struct("first_seen_at", "first_arrival", *_LINE_FIELDS), F.col("_at")).alias("_first"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_windows")))).alias("source_windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_files")))).alias("source_files"),
        F.sum("record_count").alias("record_count"),
        F.max("order").alias("order"),
        F.count("low").alias("_hints"),
        F.count(F.when(F.col("_low").isNotNull() & F.col("_high").isNotNull(), 1)).alias("_numbers"),
        F.count(F.coalesce("_low", "_high")).alias("_any_numbers"),
        F.min(F.least(F.char_length("low"), F.char_length("high"))).alias("_short"),
        F.max(F.greatest(F.char_length("low"), F.char_length("high"))).alias("_long"),
        F.bool_and(plain(F.col("low")) & plain(F.col("high"))).alias("_plain"),
        F.min("low").alias("_text_min"),
        F.max("high").alias("_text_max"),
        earliest("low", F.col("_low")).alias("_number_min"),
        # Bitwise not turns the order around without overflow; the earlier arrival still wins a tie.
        earliest("high", F.bitwise_not("_high")).alias("_number_max"),
    )
    all_numbers = F.col("_hints") == F.col("_numbers")
    no_numbers = F.col("_any_numbers") == 0
    # Unsigned texts of one length compare alike as numbers and as text, so the order is total.
    one_length = (F.col("_short") == F.col("_long")) & F.col("_plain")
    settled = merged.withColumns(
        {
            "_regular": F.coalesce(all_numbers | no_numbers | one_length, F.lit(True)),
            "sequence_hint_min": F.when(all_numbers, F.col("_number_min")).otherwise(F.col("_text_min")),
            "sequence_hint_max": F.when(all_numbers, F.col("_number_max")).otherwise(F.col("_text_max")),
        }
    )
    if keep:
        settled = keep(settled.select("_first", *_SETTLED), "settled")
    irregular = settled.filter(~F.col("_regular"))
    folded = fold_hints(parts, irregular.select(*CANONICAL_KEYS), slice_seconds)
    if keep:
        joined = irregular.join(keep(folded, "folded"), CANONICAL_KEYS, "left")
        joined = joined.unionByName(settled.filter("_regular"), allowMissingColumns=True)
    else:
        joined = settled.join(folded, CANONICAL_KEYS, "left")
    return (
        joined
        .withColumns(
            {
                "sequence_hint_min": F.coalesce("folded_min", "sequence_hint_min"),
                "sequence_hint_max": F.coalesce("folded_max", "sequence_hint_max"),
            }
        )
        .select(
            F.lit(CANONICAL_VERSION).alias("schema_version"),
            F.col("canonical_key").alias("canonical_record_id"),
            "session_id",
            F.col("_first.first_seen_at").alias("first_seen_at"),
            "last_seen_at",
            "source_windows",
            "source_files",
            "sequence_hint_min",
            "sequence_hint_max",
            *[F.col(f"_first.{n}").alias(n) for n in _LINE_FIELDS],
            "canonical_key",
            "record_count",
            F.col("_first.first_arrival").alias("first_arrival"),
            "order",
        )
    )


# --- hints whose order depends on arrival ------------------------------------------------------
# Two numbers compare as numbers, any other pair as text. Over mixed texts of different length this
# is not transitive: 9 < 10, "10" < "1a", "1a" < "9". The range of such hints is what a fold in the
# order of arrival ends with, so it is folded in slices of time that know their effect on any state.

def _number(text: str) -> int | None:
    try:
        return int(text)
    except ValueError:
        return None


def _replaces(state: str, number: int | None, word: str | None, text: str | None, want_min: bool) -> bool:
    """Is any value of a set before (or, for the maximum, behind) ``state``?

    The set is given by its extreme number, its extreme text that is no number, and its extreme text.
    """
    ahead = lambda new, old: new is not None and (new < old if want_min else new > old)
    own = _number(state)
    return ahead(text, state) if own is None else ahead(number, own) or ahead(word, state)


def _runs(values: list[str], want_min: bool) -> list[tuple]:
    """What a stretch of hints does to a state: ``(result, number, word, text)`` per run.

    The first run with a value that replaces the state gives the result; if none does, the state
    stays. Without a state the result of the first run holds.
    """
    best = min if want_min else max
    extreme = lambda old, new: new if old is None else old if new is None else best(old, new)
    numbers = [_number(v) for v in values]
    ends: list[str] = [""] * len(values)
    rest = (None, None, None)
    for at in reversed(range(len(values))):
        value, number = values[at], numbers[at]
        ends[at] = value
        if _replaces(value, *rest, want_min):
            then = at + 1
            while not _replaces(value, numbers[then], None if numbers[then] is not None else values[then], values[then], want_min):
                then += 1
            ends[at] = ends[then]
        rest = (extreme(rest[0], number), extreme(rest[1], None if number is not None else value), extreme(rest[2], value))
    runs: list[list] = []
    for value, number, end in zip(values, numbers, ends):
        if not runs or runs[-1][0] != end:
            runs.append([end, None, None, None])
        run = runs[-1]
        run[1:] = [extreme(run[1], number), extreme(run[2], None if number is not None else value), extreme(run[3], value)]
    return [(end, None if number is None else str(number), word, text) for end, number, word, text in runs]


RUN_COLUMNS = (
    "session_id STRING, canonical_key STRING, slice BIGINT, side STRING, run INT, result STRING, number STRING, word STRING, text STRING"
)


def _slice_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of each slice. Slices come one behind the other, each in order; ``nth`` is 1 at its first row.

    Most slices hold a few hints, so they are not handed over one by one.
    """
    names = [c.split()[0] for c in RUN_COLUMNS.split(", ")]
    shaped = lambda rows: pd.DataFrame(rows, columns=names).astype({"slice": "Int64"})
    low: list[str] = []
    high: list[str] = []
    key = None

    def settled() -> Iterator[tuple]:
        for side, values in (("low", low), ("high", high)):
            for place, run in enumerate(_runs(values, side == "low")):
                yield (*key, side, place, *run)

    for frame in frames:
        done = []
        for session, line, part, least, most, nth in zip(
            *(frame[c] for c in (*CANONICAL_KEYS, "slice", "low", "high", "nth"))
        ):
            if nth == 1:
                if key is not None:
                    done += settled()
                key, low, high = (session, line, None if pd.isna(part) else int(part)), [], []
            low.append(least)
            high.append(most)
        yield shaped(done)
    if key is not None:
        yield shaped(list(settled()))


def _chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Take each key through its slices; ``nth`` is 1 at the first run of a key and side."""
    names = ["session_id", "canonical_key", "side", "value"]
    key = state = None
    settled = False
    for frame in frames:
        done = []
        for row in frame.itertuples(index=False):
            if row.nth == 1:
                if key is not None:
                    done.append((*key, state))
                key, state, settled = (row.session_id, row.canonical_key, row.side), row.result, True
            elif row.run == 0:
                settled = False
            number = None if row.number is None else int(row.number)
            if not settled and _replaces(state, number, row.word, row.text, row.side == "low"):
                state, settled = row.result, True
        yield pd.DataFrame(done, columns=names)
    if key is not None:
        yield pd.DataFrame([(*key, state)], columns=names)


def fold_hints(parts: DataFrame, irregular: DataFrame, slice_seconds: int = FOLD_SECONDS) -> DataFrame:
    """Hint range of keys that mix decimal and other texts of different length.

    A slice is a key within a minute of file time, so even a key that fills the log is spread over
    many tasks; only a few runs per slice are then chained per key, in order.
    """
    minute = F.floor(F.unix_seconds(F.col("first_arrival.file_mtime")) / slice_seconds)
    before_all = F.lit(-(2**62)).cast("bigint")
    rows = (
        parts.filter(F.col("low").isNotNull())
        .join(irregular, CANONICAL_KEYS, "left_semi")
        .withColumn("slice", F.when(F.col("_round") == 0, before_all).otherwise(minute))
    )
    inside = Window.partitionBy(*CANONICAL_KEYS, "slice").orderBy("_at")
    runs = (
        rows.select(*CANONICAL_KEYS, "slice", "low", "high", F.row_number().over(inside).alias("nth"))
        .mapInPandas(_slice_runs, RUN_COLUMNS)
    )
    # The window keeps a key together and in order. A plain repartition could be dropped by adaptive
    # execution, because nothing downstream is known to need it.
    along = Window.partitionBy(*CANONICAL_KEYS, "side").orderBy("slice", "run")
    chained = runs.withColumn("nth", F.row_number().over(along)).mapInPandas(
        _chain, "session_id STRING, canonical_key STRING, side STRING, value STRING"
    )
    side = lambda name: F.max(F.when(F.col("side") == name, F.col("value")))
    return chained.groupBy(*CANONICAL_KEYS).agg(side("low").alias("folded_min"), side("high").alias("folded_max"))


def line_key() -> Column:
    """The canonical key of a raw record's line."""
    return canonical_key("event_group", "visible_text")


def canonical_sources(raw: DataFrame) -> DataFrame:
    """Which raw records each canonical line came from: distinct pairs, in long form."""
    return (
        valid_records(raw)
        .select("session_id", line_key().alias("canonical_key"), "raw_record_id")
        .distinct()
    )


def with_source_ids(canonical: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``source_raw_record_ids`` as the stored format has it: always the complete list."""
    nested = sources.groupBy(*CANONICAL_KEYS).agg(
        F.array_sort(F.collect_list("raw_record_id")).alias("source_raw_record_ids")
    )
    return canonical.join(nested, CANONICAL_KEYS, "left")


def assign_order(canonical: DataFrame, last: int = 0) -> DataFrame:
    """Dense ``order`` from ``last + 1`` per session, by first arrival."""
    return dense_order(canonical.drop("order"), ["first_arrival", "canonical_key"], ["session_id"], "order", start=last)


def combine_sessions(log: DataFrame) -> DataFrame:
    """One log out of several: by first seen, session, old order, then reading order; dense from 1.

    The old order is kept as ``session_order``. ``read_index`` becomes the place in the combined log, so that ties of
    other sort keys never depend on places in different files.
    """
    old = log.withColumnRenamed("order", "session_order")
    by = [
        F.col("first_seen_at").isNull(), F.col("first_seen_at"),
        F.col("session_id"),
        F.col("session_order").isNull(), F.col("session_order"),
        *[F.col(c) for c in ("session_folder", "read_index") if c in log.columns],
    ]
    return dense_order(old, by, name="order").withColumn("read_index", F.col("order") - 1)


def collection_stats(records: DataFrame, raw: DataFrame, deduped: DataFrame, canonical: DataFrame,
                     baseline_skipped: DataFrame | None = None) -> DataFrame:
    """One row of counters for a run. Every input is counted by its own scalar aggregate."""
    spark = records.sparkSession
    count = lambda df: df.select(F.count(F.lit(1))).scalar()
    errors = records.select(F.count_if(F.col("parse_status") == "error")).scalar()
    broken = raw.select(F.count_if(F.col("visible_text").contains("�"))).scalar()
    skipped = count(baseline_skipped) if baseline_skipped is not None else F.lit(0).cast("bigint")
    seen = valid_records(raw).select(F.max("first_seen_at")).scalar()
    return spark.range(1).select(
        count(deduped).alias("raw_records_written"),
        count(canonical).alias("canonical_records_written"),
        (count(raw) - count(deduped)).alias("duplicate_raw_records_skipped"),
        (count(valid_records(deduped)) - count(canonical)).alias("duplicate_canonical_records_skipped"),
        skipped.alias("baseline_records_skipped"),
        errors.alias("parse_errors"),
        broken.alias("decode_errors"),
        F.lit(0).cast("bigint").alias("gap_warnings"),
        seen.alias("last_seen_at"),
    )


def fingerprint(log: DataFrame) -> DataFrame:
    """One row that changes when the lines change: count and order-free sums over a digest of what is shown.

    The digest's first 24 hex digits are summed in four parts of 24 bits, which no number of lines makes overflow.
    """
    column = lambda name: F.col(name).cast("string") if name in log.columns else F.lit(None).cast("string")
    shown = [
        column("session_id"), column("order"), F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        column("sequence_hint_min"), column("sequence_hint_max"), column("visible_text"),
    ]
    digest = F.sha1(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("\x1e")) for c in shown)))
    part = lambda n: F.conv(F.substring(F.col("_digest"), 6 * n + 1, 6), 16, 10).cast("bigint")
    return log.select("order", digest.alias("_digest")).agg(
        F.count(F.lit(1)).alias("lines"), F.max("order").alias("last_order"),
        *(F.sum(part(n)).alias(f"hash{n + 1}") for n in range(4)),
    )
