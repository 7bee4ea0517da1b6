"""Ranges of a log: endpoints, validation, markers, the resolved analysis time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomlog.functions import fixed_values as fixed
from loomlog.functions.text import area_name
from loomlog.functions.times import parse_message_time
from loomlog.schemas import as_log

BASE_DATE = "2000-01-01 00:00:00"


@dataclass(frozen=True)
class Endpoint:
    """``log_start``, ``log_end`` or ``marker``; a marker carries the facts of its line."""

    kind: str
    order: int | None = None
    keyword: str | None = None
    message_time_text: str | None = None
    first_seen_at: str | None = None
    has_marker: bool = True

    @classmethod
    def marker(cls, order, keyword=None, message_time_text=None, first_seen_at=None) -> "Endpoint":
        seen = None if first_seen_at is None else str(first_seen_at)
        return cls("marker", order, keyword, message_time_text, seen)


LOG_START = Endpoint("log_start")
LOG_END = Endpoint("log_end")


@dataclass(frozen=True)
class Selection:
    start: Endpoint = LOG_START
    end: Endpoint = LOG_END

    @property
    def after(self) -> int | None:
        return self.start.order if self.start.kind == "marker" else None

    @property
    def before(self) -> int | None:
        return self.end.order if self.end.kind == "marker" else None


def validate_range(selection: Selection) -> list[str]:
    """Codes of everything wrong with a selection; empty when it can run."""
    problems = []
    if selection.start.kind not in ("log_start", "marker"):
        problems.append("start_kind")
    if selection.end.kind not in ("marker", "log_end"):
        problems.append("end_kind")
    for side, point in (("start", selection.start), ("end", selection.end)):
        if point.kind == "marker" and not point.has_marker:
            problems.append(f"{side}_marker_missing")
        elif point.kind == "marker" and point.order is None:
            problems.append(f"{side}_order_missing")
    if selection.after is not None and selection.before is not None and selection.before <= selection.after:
        problems.append("end_not_after_start")
    return problems


def select_range(log: DataFrame, selection: Selection = Selection(), drop_area_changes: bool = True) -> DataFrame:
    """Lines strictly inside the selection, without markers and (by default) area changes.

    The bounds are literals on ``order``, so they reach the Parquet scan.
    """
    problems = validate_range(selection)
    if problems:
        raise ValueError("invalid range: " + ", ".join(problems))
    lines = log
    if selection.after is not None:
        lines = lines.filter(F.col("order") > F.lit(selection.after))
    if selection.before is not None:
        lines = lines.filter(F.col("order") < F.lit(selection.before))
    lines = lines.filter(~F.coalesce(F.col("is_marker"), F.lit(False)))
    return lines.filter(area_name("visible_text").isNull()) if drop_area_changes else lines


def select_slice(log: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Lines ``[start, end)`` of a log with dense order 1..n, counted from 0, without markers.

    Area changes stay in: this is the range of the live view.
    """
    begin = max(start, 0)
    lines = log.filter(F.col("order") > F.lit(begin))
    if end is not None:
        lines = lines.filter(F.col("order") <= F.lit(max(end, begin)))
    return lines.filter(~F.coalesce(F.col("is_marker"), F.lit(False)))


def order_range(lines: DataFrame) -> DataFrame:
    """One row: first and last order, null when a line of the range has none, and a label."""
    first, last = F.min("order"), F.max("order")
    whole = F.count(F.lit(1)) == F.count("order")
    label = F.concat(F.format_number(first, 0), F.lit(" – "), F.format_number(last, 0))
    return lines.agg(
        first.alias("first_order"),
        F.when(whole, last).alias("last_order"),
        F.coalesce(F.when(whole, label), F.lit("-")).alias("label"),
    )


def markers(log: DataFrame) -> DataFrame:
    """Marker lines; sort with :func:`order_lines`."""
    return as_log(log).filter("is_marker").select(
        "session_id", "order", "read_index", "marker_keyword", "visible_text", "message_time_text", "first_seen_at"
    )


def order_lines(lines: DataFrame) -> DataFrame:
    return lines.orderBy(F.asc_nulls_last("order"), "read_index")


def end_markers(marker_lines: DataFrame, start_order: int | None) -> DataFrame:
    """Markers that may end a range begun at ``start_order`` (all of them when nothing is chosen)."""
    return marker_lines if start_order is None else marker_lines.filter(F.col("order") > F.lit(start_order))


def _at(seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(BASE_DATE))) + seconds)


def _point(at: Column, precision: Column, estimated: bool) -> Column:
    return F.when(
        at.isNotNull(),
        F.struct(at.alias("at"), precision.alias("precision"), F.lit(estimated).alias("estimated")),
    )


def _end_second(parsed: Column) -> Column:
    """A minute counts to its last second when it ends a range."""
    return parsed.getField("seconds") + F.when(parsed.getField("precision") == "minute", 59).otherwise(0)


def _marker_point(point: Endpoint, is_end: bool, unbracketed: bool) -> Column:
    parsed = parse_message_time(F.lit(point.message_time_text).cast("string"), unbracketed)
    seconds = _end_second(parsed) if is_end else parsed.getField("seconds")
    by_time = F.when(parsed.isNotNull(), _point(_at(seconds), parsed.getField("precision"), False))
    seen = F.to_timestamp(F.lit(point.first_seen_at).cast("string"))
    return F.coalesce(by_time, _point(seen, F.lit(None).cast("string"), True))


def resolve_time(range_lines: DataFrame, selection: Selection = Selection(), accept_unbracketed: bool = False) -> DataFrame:
    """One row: how long the range lasted and how far to trust it.

    Marker times count as given. Open ends use the first and last line with a readable time, else
    the first and last time a line was seen. ``mixed_time_basis`` warns when one end is a clock time
    (on the base date) and the other a real date, which gives a meaningless span.
    """
    lines = as_log(range_lines)
    parsed = parse_message_time("message_time_text", accept_unbracketed)
    position = F.struct(F.col("order").isNull().alias("n"), F.col("order"), F.col("read_index"))
    where = lambda value: F.when(value.isNotNull(), position)
    last_seen = F.coalesce(F.col("last_seen_at"), F.col("first_seen_at"))
    ends = lines.withColumn("_time", parsed).agg(
        F.min_by("_time", where(F.col("_time"))).alias("first_time"),
        F.max_by("_time", where(F.col("_time"))).alias("last_time"),
        F.min_by("first_seen_at", where(F.col("first_seen_at"))).alias("first_seen"),
        F.max_by(last_seen, where(last_seen)).alias("last_seen"),
    )
    none = F.lit(None).cast("string")
    open_start = F.coalesce(
        _point(_at(F.col("first_time.seconds")), F.col("first_time.precision"), True),
        _point(F.col("first_seen"), none, True),
    )
    open_end = F.coalesce(
        _point(_at(_end_second(F.col("last_time"))), F.col("last_time.precision"), True),
        _point(F.col("last_seen"), none, True),
    )
    chosen = ends.select(
        (_marker_point(selection.start, False, accept_unbracketed) if selection.start.kind == "marker" else open_start).alias("s"),
        (_marker_point(selection.end, True, accept_unbracketed) if selection.end.kind == "marker" else open_end).alias("e"),
    )
    known = F.col("s").isNotNull() & F.col("e").isNotNull()
    rolled = F.when(F.col("e.at") < F.col("s.at"), F.col("e.at") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("e.at"))
    seconds = (F.unix_micros(F.col("end_time")) - F.unix_micros(F.col("start_time"))).cast("double") / 1e6
    confidence = (
        F.when(~known, "unknown")
        .when(F.col("s.estimated") | F.col("e.estimated"), "estimated")
        .when((F.col("s.precision") == "second") & (F.col("e.precision") == "second"), "exact")
        .otherwise("minute")
    )
    warnings = F.filter(
        F.array(
            F.when(~known, "unknown_time"),
            F.when(F.col("duration_seconds") <= 0, "empty_time"),
            F.when(known & (F.col("s.precision").isNull() != F.col("e.precision").isNull()), "mixed_time_basis"),
        ),
        lambda w: w.isNotNull(),
    )
    return (
        chosen.withColumns(
            {
                "start_time": F.when(known, F.col("s.at")),
                "end_time": F.when(known, rolled),
                "confidence": confidence,
            }
        )
        .withColumn("duration_seconds", seconds)
        .withColumn("warnings", warnings)
        .select("confidence", "duration_seconds", "start_time", "end_time", "warnings")
    )


def dps_state(time: DataFrame) -> DataFrame:
    """Add whether a rate per second can be given."""
    return time.withColumn(
        "can_rate", F.coalesce((F.col("confidence") != "unknown") & (F.col("duration_seconds") > 0), F.lit(False))
    )


TIME_WARNING_LABELS = {"unknown_time": fixed.UNKNOWN_TIME_WARNING, "empty_time": fixed.EMPTY_TIME_WARNING}
