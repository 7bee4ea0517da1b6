"""Result columns as the text people read in exported tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomlog.functions import fixed_values as fixed
from loomlog.functions.text import col

MISSING = "-"


def grouped(value: Column | str, decimals: int = 0) -> Column:
    """Number with thousands separators, rounded half up; '-' when missing."""
    number = F.round(col(value).cast("double"), decimals) if decimals else F.round(col(value))
    return F.coalesce(F.format_number(number, decimals), F.lit(MISSING))


def percent(rate: Column | str) -> Column:
    """One decimal and a percent sign; '-' when missing."""
    return F.coalesce(F.concat(F.format_number(F.round(col(rate) * 100, 1), 1), F.lit("%")), F.lit(MISSING))


def percent_with_counts(rate: Column | str, part: Column | str, whole: Column | str) -> Column:
    """Percent (one decimal only if it is not zero) with the counts behind it."""
    counts = F.concat(F.lit("("), grouped(part), F.lit("/"), grouped(whole), F.lit(")"))
    number = F.regexp_replace(F.format_number(F.round(col(rate) * 100, 1), 1), r"\.0$", "")
    return F.concat(F.coalesce(F.concat(number, F.lit("％")), F.lit(MISSING)), counts)


def label(value: Column | str, labels: dict[str, str]) -> Column:
    """Text for a code; an unknown code stays as it is."""
    code = col(value)
    chain = None
    for key, text in labels.items():
        chain = F.when(code == key, text) if chain is None else chain.when(code == key, text)
    return chain.otherwise(code)


def clock_time(value: Column | str) -> Column:
    return F.coalesce(F.date_format(col(value), "yyyy-MM-dd HH:mm:ss"), F.lit(MISSING))


def table_columns(layout: str) -> dict[str, Column]:
    """Formatted columns of an export layout, by column name."""
    whole = lambda *names: {n: grouped(n) for n in names}
    if layout == "actors":
        return {
            "actor": F.col("actor"),
            **whole("total_damage", "use_count", "hit_count", "miss_count", "unknown_count"),
            "dps": grouped("dps", 2),
            "time_confidence": label("time_confidence", fixed.CONFIDENCE_LABELS),
            "normal_attack_hit_rate": percent_with_counts(
                "normal_attack_hit_rate", "attack_hits", F.col("attack_hits") + F.col("attack_misses")
            ),
            "normal_attack_critical_rate": percent_with_counts(
                "normal_attack_critical_rate", "attack_criticals", "attack_hits"
            ),
        }
    if layout == "actions":
        return {
            "actor": F.col("actor"),
            "action_name": F.col("action_name"),
            "action_type": label("action_type", fixed.ACTION_TYPE_LABELS),
            **whole("use_count", "hit_count", "miss_count", "unknown_count", "total_damage", "max_damage", "min_damage"),
            "hit_rate": percent("hit_rate"),
            "average_damage": grouped("average_damage", 2),
        }
    if layout == "points":
        return {"point_name": F.col("point_name"), **whole("total_points", "max_chain", "points_per_hour")}
    raise ValueError(f"unknown layout {layout!r}")
