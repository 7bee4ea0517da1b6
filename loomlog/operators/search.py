"""Finding lines: text search, context around hits, stepping through hits, column filters, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from loomlog.functions.text import contains_ignoring_case
from loomlog.operators.grouping import GROUP_KEYS, is_groupable
from loomlog.operators.scans import dense_order
from loomlog.schemas import as_log


def search_log(log: DataFrame, text: str, include_groups: bool = False, excluded_only: bool = False) -> DataFrame:
    """Lines containing ``text`` in any case, optionally with the rest of their groups.

    Groups are found whatever is excluded; ``excluded_only`` (on lines flagged with ``is_excluded``)
    is applied last.
    """
    lines = as_log(log)
    needle = text.strip()
    hit = contains_ignoring_case(F.coalesce(F.col("visible_text"), F.lit("")), needle)
    if not needle:
        found = lines
    elif include_groups:
        # The hit flag travels with each key: a line stays if it matches or its group does.
        groups = lines.filter(hit & is_groupable()).select(*GROUP_KEYS).distinct().withColumn("_group_hit", F.lit(True))
        found = lines.join(groups, GROUP_KEYS, "left").filter(hit | F.col("_group_hit")).drop("_group_hit")
    else:
        found = lines.filter(hit)
    return found.filter("is_excluded") if excluded_only else found


def positioned(log: DataFrame, keys: Sequence[str] = ("session_folder",)) -> DataFrame:
    """Lines with ``position`` 1.. in each folder, by order (missing last) and reading order."""
    lines = as_log(log)
    return dense_order(lines, [F.col("order").isNull(), F.col("order"), F.col("read_index")], list(keys), "position")


def context(lines: DataFrame, hits: DataFrame, n: int = 10, keys: Sequence[str] = ("session_folder",)) -> DataFrame:
    """The ``n`` lines before and after each hit. Both inputs come from :func:`positioned`.

    A hit is spread over the 2n + 1 positions around it, which makes the lookup an equi join.
    """
    around = hits.select(
        *keys,
        F.col("position").alias("hit_position"),
        F.explode(F.sequence(F.col("position") - n, F.col("position") + n)).alias("position"),
    )
    return lines.join(around, [*keys, "position"]).withColumn("offset", F.col("position") - F.col("hit_position"))


def group_context(log: DataFrame, session_id: str, event_group: str) -> DataFrame:
    """All lines of one group."""
    return as_log(log).filter(
        (F.col("session_id") == F.lit(session_id)) & (F.col("event_group") == F.lit(event_group)) & is_groupable()
    )


def neighbour_hits(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hits numbered ``hit_no`` with the numbers of the previous and next hit, wrapping at both ends."""
    placed = dense_order(hits, list(by), name="hit_no")
    total = placed.select(F.count(F.lit(1))).scalar()
    size = placed.withColumn("_size", total)
    before = F.when(F.col("hit_no") > 1, F.col("hit_no") - 1).otherwise(F.col("_size"))
    after = F.when(F.col("hit_no") < F.col("_size"), F.col("hit_no") + 1).otherwise(F.lit(1))
    return size.withColumns({"previous_hit": before, "next_hit": after}).drop("_size")


def filter_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows in which every named column contains its text, in any case."""
    kept = df
    for name, text in wanted.items():
        if text:
            value = F.lower(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))
            kept = kept.filter(F.contains(value, F.lower(F.lit(text))))
    return kept


def page(df: DataFrame, size: int, number: int, by: Sequence[str]) -> DataFrame:
    """Page ``number`` (from 0) of rows in the given order; a page past the end becomes the last page."""
    if size < 1:
        raise ValueError("a page holds at least one row")
    placed = dense_order(df, list(by), name="_position")
    last = F.floor((placed.select(F.count(F.lit(1))).scalar() - 1) / size)
    before = F.greatest(F.least(F.lit(max(number, 0)), last), F.lit(0)) * size
    return placed.filter(F.col("_position").between(before + 1, before + size)).orderBy("_position").drop("_position")
