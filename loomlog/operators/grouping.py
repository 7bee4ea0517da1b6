"""Action groups: the lines that share ``(session_id, event_group)``, in comparator order.

A group is kept in long form, one row per line. Group facts come from aggregates over lines (first
match by sort key, sums, flags), so partial results are combined before the shuffle and a group of
any size stays out of a single row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomlog.functions.numbers import MAX_LONG, effective_hint
from loomlog.functions.text import is_blank
from loomlog.operators.scans import dense_order
from loomlog.schemas import as_log
from loomlog.session import HOT_GROUP_ROWS

GROUP_KEYS = ["session_id", "event_group"]


def is_groupable() -> Column:
    return ~is_blank("session_id") & ~is_blank("event_group")


def groupable(log: DataFrame) -> DataFrame:
    """Lines that belong to a group: both key parts are present and not blank."""
    return log.filter(is_groupable())


def ungrouped_count(log: DataFrame) -> DataFrame:
    """One row with the number of lines left out of grouping."""
    return log.agg(F.count_if(~is_groupable()).alias("ungrouped_lines"))


def group_sort_key() -> Column:
    """Valid hint, else order, else last; a hint wins a tie over an order, then reading order decides."""
    hint = effective_hint("sequence_hint_min")
    return F.struct(
        F.coalesce(hint, F.col("order"), F.lit(MAX_LONG)).alias("sort_value"),
        F.when(hint.isNotNull(), 0).when(F.col("order").isNotNull(), 1).otherwise(2).alias("sort_source"),
        F.col("read_index"),
    )


def hot_groups(lines: DataFrame, limit: int) -> DataFrame | None:
    """Keys of the groups above ``limit`` lines, or None when there are none (the usual case)."""
    counted = lines.groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("_lines"))
    hot = counted.filter(F.col("_lines") > limit).select(*GROUP_KEYS)
    return None if hot.isEmpty() else hot


def group_lines(log: DataFrame, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Every groupable line with its position in the group (``group_pos``, from 1)."""
    lines = groupable(as_log(log)).withColumn("_key", group_sort_key())

    def by_window(part: DataFrame) -> DataFrame:
        window = Window.partitionBy(*GROUP_KEYS).orderBy("_key")
        return part.withColumn("group_pos", F.row_number().over(window).cast("bigint"))

    hot = hot_groups(lines, hot_rows)
    if hot is None:
        return by_window(lines).drop("_key")
    cold = by_window(lines.join(hot, GROUP_KEYS, "left_anti"))
    large = dense_order(lines.join(hot, GROUP_KEYS, "left_semi"), ["_key"], GROUP_KEYS, "group_pos")
    return cold.unionByName(large).drop("_key")


def build_groups(log: DataFrame) -> DataFrame:
    """One row per action group: line counts, order range, first and last text."""
    key = F.when(F.coalesce(F.col("visible_text"), F.lit("")) != "", group_sort_key())
    return (
        groupable(as_log(log))
        .groupBy(*GROUP_KEYS)
        .agg(
            F.count(F.lit(1)).alias("line_count"),
            F.count(key).alias("text_count"),
            F.min("order").alias("order_min"),
            F.max("order").alias("order_max"),
            F.min_by("visible_text", key).alias("first_text"),
            F.max_by("visible_text", key).alias("last_text"),
        )
    )


def order_groups(groups: DataFrame) -> DataFrame:
    """Presentation order: first line, then key."""
    return groups.orderBy(F.asc_nulls_last("order_min"), F.concat_ws(":", *GROUP_KEYS))
