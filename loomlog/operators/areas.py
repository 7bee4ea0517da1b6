"""Area changes and the stays between them, over the whole ordered log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomlog.functions.text import area_name, contains_ignoring_case, is_blank
from loomlog.functions.times import elapsed_text, parse_message_time
from loomlog.operators.ranges import LOG_END, Endpoint, Selection
from loomlog.operators.scans import running
from loomlog.schemas import as_log
from loomlog.session import SLICE_ROWS

SMALL_STAY_LINES = 100
DAY_SECONDS = 86_400


def area_changes(log: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Area-change lines with their number and how often the area has been entered so far."""
    changes = (
        as_log(log)
        .filter(F.col("order").isNotNull())
        .withColumn("area_name", area_name("visible_text"))
        .filter(F.col("area_name").isNotNull())
        .withColumn("_area", F.upper("area_name"))
    )
    one = F.lit(1).cast("bigint")
    numbered = running(changes, "order", sums={"sequence": one}, ties=["read_index"], slice_rows=slice_rows)
    return running(
        numbered, "order", ["_area"], sums={"occurrence": one}, ties=["read_index"], slice_rows=slice_rows
    ).drop("_area")


def assign_stays(log: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every line inside a stay with ``stay``, the number of the area change it follows.

    A running count of changes replaces the interval join. Lines before the first change and lines
    that share their order with a change are in no stay.
    """
    lines = as_log(log).filter(F.col("order").isNotNull()).withColumn("_area", area_name("visible_text"))
    is_change = F.col("_area").isNotNull()
    counted = running(
        lines,
        "order",
        sums={"stay": F.when(is_change, 1).otherwise(0).cast("bigint")},
        lasts={"_begin": F.when(is_change, F.col("order"))},
        ties=[F.when(is_change, 0).otherwise(1), "read_index"],
        slice_rows=slice_rows,
    )
    return counted.filter(
        (F.col("stay") > 0) & F.col("_area").isNull() & (F.col("order") > F.col("_begin"))
    ).drop("_area", "_begin")


def area_stays(log: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per stay: bounds, line count, first and last time text, elapsed time."""
    changes = area_changes(log, slice_rows).select(
        F.col("sequence").alias("stay"),
        "area_name",
        "occurrence",
        F.col("order").alias("start_order"),
        F.col("message_time_text").alias("start_time_text"),
        F.col("first_seen_at").alias("start_seen_at"),
    )
    following = changes.select((F.col("stay") - 1).alias("stay"), F.col("start_order").alias("end_order"))
    counted = ~F.coalesce(F.col("is_marker"), F.lit(False))
    timed = F.when(~is_blank("message_time_text"), F.struct("order", "read_index"))
    facts = assign_stays(log, slice_rows).groupBy("stay").agg(
        F.count_if(counted).alias("line_count"),
        F.min_by("message_time_text", F.when(counted, timed)).alias("first_time_text"),
        F.max_by("message_time_text", timed).alias("last_time_text"),
    )
    stays = changes.join(following, "stay", "left").join(facts, "stay", "left")
    return stay_elapsed(stays.withColumn("line_count", F.coalesce("line_count", F.lit(0))))


def stay_elapsed(stays: DataFrame) -> DataFrame:
    """Seconds between the first and last time text; a negative span crossed midnight."""
    def seconds(name: str):
        clock = parse_message_time(name, accept_unbracketed=True)
        return F.when(clock.getField("precision") == "second", clock.getField("seconds"))

    first, last = seconds("first_time_text"), seconds("last_time_text")
    return stays.withColumn("elapsed_seconds", F.pmod(last - first, F.lit(DAY_SECONDS))).withColumn(
        "elapsed_text", elapsed_text("elapsed_seconds")
    )


def stay_selection(stay: dict) -> Selection:
    """Range of one stay row: from its area change to the next one, or to the end of the log."""
    name, seen = f"area:{stay['area_name']}", stay.get("start_seen_at")
    start = Endpoint.marker(stay["start_order"], name, stay.get("start_time_text"), seen)
    end = LOG_END if stay.get("end_order") is None else Endpoint.marker(
        stay["end_order"], stay.get("end_keyword"), stay.get("end_time_text"), stay.get("end_seen_at")
    )
    return Selection(start, end)


def filter_stays(stays: DataFrame, text: str = "", min_lines: int = 0) -> DataFrame:
    """Stays whose area contains ``text``; ``min_lines=SMALL_STAY_LINES`` hides the small ones."""
    kept = stays.filter(F.col("line_count") >= F.lit(min_lines))
    needle = text.strip()
    return kept.filter(contains_ignoring_case("area_name", needle)) if needle else kept


def preview(log: DataFrame, start_order: int, end_order: int | None, lines: int = 5) -> DataFrame:
    """The first lines of a stay with their time text in front."""
    inside = as_log(log).filter((F.col("order") > F.lit(start_order)) & ~F.col("is_marker"))
    if end_order is not None:
        inside = inside.filter(F.col("order") < F.lit(end_order))
    text = F.coalesce(F.col("visible_text"), F.lit(""))
    shown = F.when(is_blank("message_time_text"), text).otherwise(F.concat_ws(" ", "message_time_text", text))
    return inside.select("order", "read_index", shown.alias("line")).orderBy("order", "read_index").limit(lines)


def stay_previews(log: DataFrame, lines: int = 5, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The first lines of every stay at once, with their place in the stay."""
    inside = assign_stays(log, slice_rows).filter(~F.coalesce(F.col("is_marker"), F.lit(False)))
    placed = running(
        inside, "order", ["stay"], sums={"line_no": F.lit(1).cast("bigint")}, ties=["read_index"], slice_rows=slice_rows
    )
    text = F.coalesce(F.col("visible_text"), F.lit(""))
    shown = F.when(is_blank("message_time_text"), text).otherwise(F.concat_ws(" ", "message_time_text", text))
    return placed.filter(F.col("line_no") <= lines).select("stay", "line_no", "order", shown.alias("line"))
