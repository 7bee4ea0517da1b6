"""Report tables over the timeline: packed rows, member rows, action rows, source lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomlog.functions.numbers import rate
from loomlog.operators.grouping import GROUP_KEYS, groupable
from loomlog.operators.timeline import number_events, timeline_results
from loomlog.schemas import as_log

ROW_LIMIT = 3
LAYOUT_SLICE = 100_000
# Slices that are summed up together before they are chained.
LAYOUT_BLOCK = 1_000


def _row_sizes(events: DataFrame, slice_rows: int) -> DataFrame:
    """Add ``_slice`` and ``_size``: how many events a row would hold if it began at this event.

    A row ends before a third neighbour at most, before a repeated actor, and before a change of
    session or reference time. So the size depends on the next two events only. Each slice borrows
    the first two events of the following one to see past its end.
    """
    at = F.col("event_no") - 1
    own = F.floor(at / slice_rows)
    shared = F.when((at % slice_rows < ROW_LIMIT - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    spread = events.withColumn("_own", own).withColumn("_slice", F.explode(shared))
    ahead = Window.partitionBy("_slice").orderBy("event_no")
    me = lambda n: F.lead(F.struct("session_id", "reference_time", "actor"), n).over(ahead)
    seen = spread.withColumns({"_next": me(1), "_after": me(2)})
    joins = lambda other: (
        F.col(other).isNotNull()
        & (F.col(f"{other}.session_id") == F.col("session_id"))
        & F.col(f"{other}.reference_time").eqNullSafe(F.col("reference_time"))
        & (F.col(f"{other}.actor") != F.col("actor"))
    )
    two = joins("_next")
    three = two & joins("_after") & (F.col("_after.actor") != F.col("_next.actor"))
    size = F.when(three, 3).when(two, 2).otherwise(1)
    return seen.withColumn("_size", size).filter(F.col("_own") == F.col("_slice")).drop("_own", "_next", "_after")


def _exits(frame: pd.DataFrame) -> pd.DataFrame:
    """For rows entering a slice 0, 1 or 2 events late: where they leave it and how many rows they make."""
    sizes = frame.sort_values("event_no")["_size"].to_numpy()
    rows = []
    for entry in range(ROW_LIMIT):
        at, made = entry, 0
        while at < len(sizes):
            at, made = at + sizes[at], made + 1
        rows.append((frame["_slice"].iat[0], entry, at - len(sizes), made))
    return pd.DataFrame(rows, columns=["_slice", "entry", "leave", "made"])


def _followed(frame: pd.DataFrame, entry: int, made: int) -> list[tuple[int, int, int]]:
    """Enter the first part at ``entry`` and go on: where each part is entered and the rows made before, and the end."""
    steps = {
        (number, entry): (leave, made)
        for number, entry, leave, made in frame[["_slice", "entry", "leave", "made"]].itertuples(index=False)
    }
    rows = []
    for number in sorted(frame["_slice"].unique()):
        rows.append((number, entry, made))
        leave, count = steps[(number, entry)]
        entry, made = leave, made + count
    return [*rows, (-1, entry, made)]


def _entries(frame: pd.DataFrame) -> pd.DataFrame:
    """The real entry of each part and the rows made before it; ``first_entry`` and ``first_made`` say where to begin."""
    begin, made = (int(frame[n].iat[0]) for n in ("first_entry", "first_made"))
    return pd.DataFrame(_followed(frame, begin, made)[:-1], columns=["_slice", "entry", "rows_before"])


def _composed(frame: pd.DataFrame) -> pd.DataFrame:
    """A run of parts as one part: where each entry leaves it and how many rows it makes."""
    ends = [_followed(frame, entry, 0)[-1] for entry in range(ROW_LIMIT)]
    rows = [(frame["_block"].iat[0], entry, leave, made) for entry, (_, leave, made) in enumerate(ends)]
    return pd.DataFrame(rows, columns=["_slice", "entry", "leave", "made"])


EXITS = "_slice BIGINT, entry BIGINT, leave BIGINT, made BIGINT"
ENTRIES = "_slice BIGINT, entry BIGINT, rows_before BIGINT"


def _chained(exits: DataFrame, block: int) -> DataFrame:
    """Entries of all slices, in two levels: blocks of slices are composed and chained, then followed inside.

    The group that chains the blocks has three rows per ``block`` slices, the others three rows per slice of a block.
    """
    blocked = exits.withColumn("_block", F.floor(F.col("_slice") / block))
    blocks = blocked.groupBy("_block").applyInPandas(_composed, EXITS)
    from_start = blocks.withColumns({"first_entry": F.lit(0), "first_made": F.lit(0)})
    begins = from_start.groupBy().applyInPandas(_entries, ENTRIES).select(
        F.col("_slice").alias("_block"), F.col("entry").alias("first_entry"), F.col("rows_before").alias("first_made")
    )
    return blocked.join(begins, "_block").groupBy("_block").applyInPandas(_entries, ENTRIES)


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    """Number the rows of one slice from its real entry."""
    ordered = frame.sort_values("event_no").reset_index(drop=True)
    sizes, entry = ordered["_size"].to_numpy(), int(ordered["entry"].iat[0])
    number = int(ordered["rows_before"].iat[0])
    # Events before the entry end a row that the slice before has begun.
    row_no = [number] * len(sizes)
    at = entry
    while at < len(sizes):
        number += 1
        row_no[at : at + sizes[at]] = [number] * min(sizes[at], len(sizes) - at)
        at += sizes[at]
    return pd.DataFrame({"event_no": ordered["event_no"], "row_no": row_no})


def layout_rows(events: DataFrame, slice_rows: int = LAYOUT_SLICE, block: int = LAYOUT_BLOCK) -> DataFrame:
    """Pack numbered events side by side: ``row_no`` and ``row_place`` per ``event_no``.

    Packing is sequential, but a row never spans more than three events. So each slice is summed up
    as three entry points with their exits, the summaries are chained in two levels, and
    every slice is packed on its own from the entry found that way.
    """
    if slice_rows < ROW_LIMIT:
        raise ValueError("a slice must hold at least one full row")
    sized = _row_sizes(events, slice_rows).select("_slice", "event_no", "_size")
    entries = _chained(sized.groupBy("_slice").applyInPandas(_exits, EXITS), block)
    packed = sized.join(entries, "_slice").groupBy("_slice").applyInPandas(_pack, "event_no BIGINT, row_no BIGINT")
    # A row holds three events at most, so this window sorts three rows per key.
    place = Window.partitionBy("row_no").orderBy("event_no")
    return packed.withColumn("row_place", F.row_number().over(place).cast("bigint"))


def mark_changes(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Per layout row: first and last event, and whether session and reference time are to be shown.

    The previous row is found by its number, so no window spans the whole timeline.
    """
    first = events.join(rows, "event_no").groupBy("row_no").agg(
        F.min("event_no").alias("first_event"),
        F.max("event_no").alias("last_event"),
        F.min_by("session_id", "event_no").alias("session_id"),
        F.min_by(F.struct("reference_time"), F.col("event_no")).alias("_time"),
    ).withColumn("reference_time", F.col("_time.reference_time")).drop("_time")
    previous = first.select(
        (F.col("row_no") + 1).alias("row_no"),
        F.col("session_id").alias("_session"),
        F.col("reference_time").alias("_reference"),
    )
    new_session = ~F.col("session_id").eqNullSafe(F.col("_session"))
    new_time = F.col("reference_time").isNotNull() & (
        new_session | ~F.col("reference_time").eqNullSafe(F.col("_reference"))
    )
    return (
        first.join(previous, "row_no", "left")
        .withColumns({"show_session": new_session, "show_time": new_time})
        .drop("_session", "_reference")
    )


def member_report(events: DataFrame, actors: DataFrame, actions: DataFrame, members: DataFrame) -> DataFrame:
    """One row per chosen member: timeline damage, pooled hit rate, weapon skills, damage taken, evasion."""
    chosen = members.select("actor").distinct()
    skill = (F.col("action_type") == "weapon_skill") & F.col("is_executed")
    skill_damage = F.when(skill, F.col("damage"))
    dealt = events.groupBy("actor").agg(
        F.sum("damage").alias("timeline_damage"),
        F.count_if(skill).alias("weapon_skill_count"),
        F.count(skill_damage).alias("_with_damage"),
        F.sum(skill_damage).alias("_skill_total"),
        F.max(skill_damage).alias("weapon_skill_max"),
        F.min(skill_damage).alias("weapon_skill_min"),
    )
    skills = actions.filter(F.col("action_type") == "weapon_skill").groupBy("actor").agg(
        F.sum("hit_count").alias("_hits"), F.sum("miss_count").alias("_misses")
    )
    pooled = actors.select(
        "actor", "attack_hits", "attack_misses", "incoming_total", "incoming_max", "incoming_min",
        "incoming_average", "evasion_rate",
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    hits = zero("attack_hits") + zero("_hits")
    misses = zero("attack_misses") + zero("_misses")
    return (
        chosen.join(dealt, "actor", "left")
        .join(skills, "actor", "left")
        .join(pooled, "actor", "left")
        .select(
            "actor",
            "timeline_damage",
            rate(hits, hits + misses).alias("attack_hit_rate"),
            zero("weapon_skill_count").alias("weapon_skill_count"),
            rate("_skill_total", "_with_damage").alias("weapon_skill_average"),
            "weapon_skill_max",
            "weapon_skill_min",
            "incoming_total",
            "incoming_max",
            "incoming_min",
            "incoming_average",
            "evasion_rate",
        )
    )


def action_report(events: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Executed, interrupted and confirmed uses with damage per use, by member and action."""
    shown = events if members is None else events.join(members.select("actor").distinct(), "actor", "left_semi")
    return (
        shown.groupBy("actor", "action_name", "action_type")
        .agg(
            F.count_if("is_executed").alias("executed"),
            F.count_if(~F.col("is_executed")).alias("interrupted"),
            F.count("damage").alias("confirmed"),
            F.sum("damage").alias("damage_sum"),
            F.max("damage").alias("damage_max"),
            F.min("damage").alias("damage_min"),
        )
        .withColumn("damage_average", rate("damage_sum", "confirmed"))
    )


def source_lines(events: DataFrame, log: DataFrame) -> DataFrame:
    """The log lines behind each numbered event."""
    return groupable(as_log(log)).join(events.select(*GROUP_KEYS, "event_no"), GROUP_KEYS).select(
        "event_no", "order", "read_index", "visible_text"
    )


# A digit run is sorted by how many digits it has; this many digits say how many.
_COUNT_DIGITS = 10


def text_order(column: str) -> Column:
    """Sort key of shown text: Japanese collation in which runs of digits compare as numbers, however long they are.

    A run becomes its length and its digits without leading zeros, so "2" comes before "10", and "02" ties with "2".
    Digits of full width count as digits. Null stays null, blanks around the text do not count.
    """
    text = F.translate(F.regexp_replace(column, r"^\s+|\s+$", ""), "０１２３４５６７８９", "0123456789")
    runs = F.regexp_extract_all(text, F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def key(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+", "")
        numbered = F.concat(F.lpad(F.length(digits).cast("string"), _COUNT_DIGITS, "0"), digits)
        return F.when(run.rlike("^[0-9]"), numbered).otherwise(run)

    return F.collate(F.array_join(F.transform(runs, key), ""), "ja")


def sort_report(df: DataFrame, column: str, descending: bool = False, text: bool = False) -> DataFrame:
    """Report sort: missing values last both ways; text by :func:`text_order`."""
    value = text_order(column) if text else F.col(column)
    return df.orderBy(F.desc_nulls_last(value) if descending else F.asc_nulls_last(value))


def report_tables(
    events: DataFrame, lines: DataFrame, actors: DataFrame, actions: DataFrame, members: DataFrame, log: DataFrame
) -> dict[str, DataFrame]:
    """Everything a report shows, as tables. ``lines`` are the chain-marked lines of the timeline."""
    shown = events.join(members.select("actor").distinct(), "actor", "left_semi")
    numbered = number_events(shown)
    rows = layout_rows(numbered)
    return {
        "members": member_report(shown, actors, actions, members),
        "events": numbered.join(rows, "event_no"),
        "rows": mark_changes(numbered, rows),
        "actions": action_report(shown),
        "results": timeline_results(lines, shown),
        "sources": source_lines(numbered, log),
    }
