"""Manual exclusions: key tables stored beside the log, applied as anti joins.

Nothing here is broadcast by hint: exclusion tables may grow, and Spark broadcasts them by itself
while they are small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loomlog.functions.text import is_blank
from loomlog.schemas import as_log

RECORD_KEY = ["session_id", "canonical_record_id"]
GROUP_KEY = ["session_id", "event_group"]
SCOPE = "session_folder"


def _scope(log: DataFrame, keys: DataFrame) -> list[str]:
    """Exclusions belong to the folder that stores them; tables without a folder apply by session."""
    return [SCOPE] if SCOPE in keys.columns and SCOPE in log.columns else []


def flag_excluded(log: DataFrame, records: DataFrame, groups: DataFrame) -> DataFrame:
    """Add ``record_excluded``, ``group_excluded`` and ``is_excluded`` to every line.

    Keys with a blank part never match.
    """
    lines = as_log(log)
    by_record = _scope(lines, records) + RECORD_KEY
    by_group = _scope(lines, groups) + GROUP_KEY
    marked_records = records.select(*by_record).distinct().withColumn("_r", F.lit(True))
    marked_groups = groups.select(*by_group).distinct().withColumn("_g", F.lit(True))
    record_hit = F.coalesce(F.col("_r") & ~is_blank("session_id") & ~is_blank("canonical_record_id"), F.lit(False))
    group_hit = F.coalesce(F.col("_g") & ~is_blank("session_id") & ~is_blank("event_group"), F.lit(False))
    return (
        lines.join(marked_records, by_record, "left")
        .join(marked_groups, by_group, "left")
        .withColumns({"record_excluded": record_hit, "group_excluded": group_hit})
        .withColumn("is_excluded", F.col("record_excluded") | F.col("group_excluded"))
        .drop("_r", "_g")
    )


def apply_exclusions(log: DataFrame, records: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a range into (included, excluded) lines: flagged once, filtered twice."""
    flagged = flag_excluded(as_log(log), records, groups)
    flags = ("record_excluded", "group_excluded", "is_excluded")
    return flagged.filter(~F.col("is_excluded")).drop(*flags), flagged.filter("is_excluded").drop(*flags)


def exclusion_counts(excluded: DataFrame) -> DataFrame:
    """One row: excluded lines and the distinct groups they touch."""
    key = F.when(~is_blank("session_id") & ~is_blank("event_group"), F.struct(*GROUP_KEY))
    return excluded.agg(
        F.count(F.lit(1)).alias("excluded_lines"), F.count_distinct(key).alias("excluded_groups")
    )


@dataclass
class Edit:
    """Outcome of an edit: new key tables, or ``refused`` with the old ones kept."""

    records: DataFrame
    groups: DataFrame
    changed: bool
    refused: str | None = None


def _differs(old: DataFrame, new: DataFrame) -> bool:
    old, new = old.distinct(), new.distinct()
    return not (new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty())


def edit_exclusions(
    operation: str, selected: DataFrame, records: DataFrame, groups: DataFrame, log: DataFrame
) -> Edit:
    """Apply ``exclude_rows``, ``restore_rows``, ``exclude_groups`` or ``restore_groups``.

    A row edit is refused when a row has no key or its whole group is excluded. A group edit also
    clears the row keys of that group, hidden rows of the log included. Where the tables name folders, an edit concerns
    the folders of the selected lines only.
    """
    record_key, group_key = _scope(selected, records) + RECORD_KEY, _scope(selected, groups) + GROUP_KEY
    refuse = lambda why: Edit(records, groups, False, why)
    if selected.isEmpty():
        return refuse("nothing_selected")
    if operation in ("exclude_rows", "restore_rows"):
        if not selected.filter(is_blank("session_id") | is_blank("canonical_record_id")).isEmpty():
            return refuse("row_key_missing")
        if not selected.join(groups, group_key, "left_semi").isEmpty():
            return refuse("group_excluded")
        keys, old = selected.select(*record_key), records.select(*record_key)
        changed_records = (
            old.union(keys).distinct() if operation == "exclude_rows" else old.join(keys, record_key, "left_anti")
        )
        return Edit(changed_records, groups, _differs(old, changed_records))
    if operation in ("exclude_groups", "restore_groups"):
        if not selected.filter(is_blank("session_id") | is_blank("event_group")).isEmpty():
            return refuse("group_key_missing")
        keys, old = selected.select(*group_key).distinct(), groups.select(*group_key)
        changed_groups = (
            old.union(keys).distinct() if operation == "exclude_groups" else old.join(keys, group_key, "left_anti")
        )
        inside = log.join(keys, group_key, "left_semi").select(*record_key)
        rows = records.select(*record_key)
        changed_records = rows.join(inside, record_key, "left_anti")
        changed = _differs(old, changed_groups) or _differs(rows, changed_records)
        return Edit(changed_records, changed_groups, changed)
    raise ValueError(f"unknown operation {operation!r}")


def edit_eligibility(selected: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row telling which edits the selected lines allow (both inputs from :func:`flag_excluded`)."""
    rows_ok = F.bool_and(~is_blank("session_id") & ~is_blank("canonical_record_id") & ~F.col("group_excluded"))
    groups_ok = F.bool_and(~is_blank("session_id") & ~is_blank("event_group"))
    key = _scope(selected, flagged) + GROUP_KEY
    hidden = flagged.filter("is_excluded").join(selected.select(*key).distinct(), key, "left_semi")
    return (
        selected.agg(
            rows_ok.alias("rows_ok"),
            groups_ok.alias("groups_ok"),
            F.bool_or(~F.col("is_excluded")).alias("some_kept"),
            F.bool_or("is_excluded").alias("some_excluded"),
            F.bool_or(~F.col("group_excluded")).alias("some_group_kept"),
            F.bool_or("group_excluded").alias("some_group_excluded"),
        )
        .withColumn("hidden_excluded", hidden.select(F.count(F.lit(1)) > 0).scalar())
        .select(
            (F.col("rows_ok") & F.col("some_kept")).alias("can_exclude_rows"),
            (F.col("rows_ok") & F.col("some_excluded")).alias("can_restore_rows"),
            (F.col("groups_ok") & F.col("some_group_kept")).alias("can_exclude_groups"),
            (F.col("groups_ok") & (F.col("some_group_excluded") | F.col("hidden_excluded"))).alias(
                "can_restore_groups"
            ),
        )
    )
