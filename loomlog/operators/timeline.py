"""The action timeline: one event per unambiguous group, with results and a reference time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomlog.functions import fixed_values as fixed
from loomlog.functions.text import capture, contains_any, is_blank
from loomlog.operators import rules as r
from loomlog.operators.grouping import GROUP_KEYS, groupable, hot_groups
from loomlog.operators.parsing import attack_type, line_facts
from loomlog.operators.rules import DEFAULT_RULES, RuleSet
from loomlog.operators.scans import dense_order, running
from loomlog.schemas import as_log
from loomlog.session import HOT_GROUP_ROWS, SLICE_ROWS

DECLARED_TYPES = ("weapon_skill", "ability", "magic")
EVENT_KEYS = GROUP_KEYS


def declarations(log: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Every groupable line parsed alone, with what it declares and the result it reports.

    Adds ``declared_type`` / ``declared_actor`` / ``declared_action`` (null type: no declaration),
    ``is_start``, ``is_attack``, ``is_chain`` and the result columns ``result_*``, ``resource_*``.
    """
    facts = line_facts(groupable(as_log(log)), rules)
    started = F.col("cast_actor").isNotNull()
    starts_only = F.col("spell_actor").isNull() & started
    attacks = F.col("attack_actor").isNotNull()
    kind = (
        F.when(starts_only, "magic")
        .when(attacks, attack_type(F.col("is_critical")))
        .when(F.col("spell_actor").isNotNull(), "magic")
        .otherwise(F.coalesce("line_type", F.lit("unknown")))
    )
    actor = F.when(starts_only, F.col("cast_actor")).otherwise(F.coalesce("attack_actor", "spell_actor", "line_actor"))
    action = F.when(starts_only, F.col("cast_name")).otherwise(F.coalesce("spell_name", "line_action"))
    text = F.col("visible_text")
    hurt, drained = ("ダメージ", "HP吸収"), ("TP吸収", "MP吸収")
    healed = capture(text, fixed.TIMELINE_RECOVERY, 2, "のHPが、").try_cast("bigint")
    drain = capture(text, fixed.TIMELINE_ABSORB, 2, drained).try_cast("bigint")
    named = facts.withColumns({"_kind": kind, "_actor": actor, "_action": action})
    declares = F.col("_kind").isin(*DECLARED_TYPES) & ~is_blank("_actor") & ~is_blank("_action")
    return named.select(
        *GROUP_KEYS,
        "order",
        "read_index",
        "visible_text",
        "sort_key",
        "is_excluded",
        "has_effect",
        "is_missed",
        F.when(declares, F.col("_kind")).alias("declared_type"),
        F.when(declares, F.col("_actor")).alias("declared_actor"),
        F.when(declares, F.col("_action")).alias("declared_action"),
        started.alias("is_start"),
        (F.col("_kind").startswith("normal_attack")).alias("is_attack"),
        F.coalesce(text.contains(fixed.CHAIN_WORD), F.lit(False)).alias("is_chain"),
        contains_any(text, fixed.INTERRUPT_PHRASES).alias("interrupts"),
        text.contains(fixed.INTERRUPT_ANCHOR_WORD).alias("anchors_interrupt"),
        contains_any(text, fixed.FAILURE_WORDS).alias("fails"),
        r.roll_total(text).alias("roll_total"),
        r.double_up_total(text).alias("double_up_total"),
        capture(text, fixed.TIMELINE_DAMAGE, 1, hurt).alias("result_target"),
        capture(text, fixed.TIMELINE_DAMAGE, 2, hurt).try_cast("bigint").alias("result_damage"),
        F.coalesce(
            F.when(healed.isNotNull(), capture(text, fixed.TIMELINE_RECOVERY, 1, "のHPが、")),
            capture(text, fixed.TIMELINE_ABSORB, 1, drained),
        ).alias("resource_target"),
        F.when(healed.isNotNull(), "hp_recovery")
        .when(drain.isNotNull(), F.when(capture(text, fixed.TIMELINE_ABSORB, 3, drained) == "TP", "tp_absorb").otherwise("mp_absorb"))
        .alias("resource_kind"),
        F.coalesce(healed, drain).alias("resource_amount"),
    )


def with_chain_section(lines: DataFrame, hot_rows: int = HOT_GROUP_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``in_chain``: the last chain line is not yet followed by an executed declaration.

    Ordinary groups use a window. Groups too large for one task get exact positions first and are
    then scanned in slices.
    """
    state = F.when(F.col("is_chain"), True).when(F.col("declared_type").isNotNull() & ~F.col("is_start"), False)

    def by_window(part: DataFrame) -> DataFrame:
        until = Window.partitionBy(*GROUP_KEYS).orderBy("sort_key").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        return part.withColumn("in_chain", F.coalesce(F.last(state, True).over(until), F.lit(False)))

    hot = hot_groups(lines, hot_rows)
    if hot is None:
        return by_window(lines)
    large = dense_order(lines.join(hot, GROUP_KEYS, "left_semi"), ["sort_key"], GROUP_KEYS, "_pos")
    scanned = running(large, "_pos", GROUP_KEYS, lasts={"in_chain": state}, slice_rows=slice_rows)
    scanned = scanned.withColumn("in_chain", F.coalesce("in_chain", F.lit(False))).drop("_pos")
    return by_window(lines.join(hot, GROUP_KEYS, "left_anti")).unionByName(scanned)


def _any(flag: str) -> Column:
    return F.coalesce(F.max(flag), F.lit(False))


def timeline_groups(lines: DataFrame) -> DataFrame:
    """Facts per group that declares something, from lines with ``in_chain``."""
    key = F.col("sort_key")
    declared = F.col("declared_type").isNotNull()
    executed = declared & ~F.col("is_start")
    who = F.struct("declared_actor", "declared_action")
    first = F.struct("declared_actor", "declared_action", "declared_type", "order")
    counts = ~F.col("in_chain")
    value = lambda name: F.when(counts, F.col(name))
    kind_sum = lambda kind: F.sum(F.when(counts & (F.col("resource_kind") == kind), F.col("resource_amount")))
    return (
        lines.groupBy(*GROUP_KEYS)
        .agg(
            F.min("order").alias("order_min"),
            F.min(F.when(declared, who)).alias("_low"),
            F.max(F.when(declared, who)).alias("_high"),
            F.min_by(first, F.when(declared, key)).alias("declared"),
            F.min_by(first, F.when(executed, key)).alias("executed"),
            F.min_by(F.struct("order"), F.when(F.col("anchors_interrupt"), key)).alias("interrupt_line"),
            _any("is_attack").alias("has_attack"),
            _any("interrupts").alias("interrupted"),
            _any("fails").alias("failed"),
            _any("is_excluded").alias("any_excluded"),
            _any("has_effect").alias("any_effect"),
            _any("is_missed").alias("any_missed"),
            F.count(value("result_damage")).alias("result_count"),
            F.sum(value("result_damage")).alias("damage"),
            *[kind_sum(k).alias(k) for k in fixed.RESOURCE_KINDS],
            F.count(F.when(counts, F.col("resource_amount"))).alias("resource_count"),
            *[
                f(value(n)).alias(f"{n}_{side}")
                for n in ("roll_total", "double_up_total")
                for side, f in (("min", F.min), ("max", F.max))
            ],
        )
        .filter(F.col("declared").isNotNull())
        .withColumn("ambiguous", (F.col("_low") != F.col("_high")) | F.col("has_attack"))
        .drop("_low", "_high")
    )


def _roll(name: Column) -> Column:
    """The roll total, if all lines of the event agree on one."""
    doubled = name == fixed.DOUBLE_UP_NAME
    low = F.least("roll_total_min", F.when(doubled, F.col("double_up_total_min")))
    high = F.greatest("roll_total_max", F.when(doubled, F.col("double_up_total_max")))
    return F.when(low == high, low)


def timeline_events(groups: DataFrame) -> DataFrame:
    """Events from :func:`timeline_groups`: executed or interrupted, never ambiguous."""
    executed = F.col("executed").isNotNull()
    chosen = F.coalesce("executed", "declared")
    done = lambda name: F.when(executed, F.col(name))
    # Without damage the outcome words decide; excluded words leave it open.
    outcome = (
        F.when(F.col("any_excluded"), "unconfirmed")
        .when(F.col("any_effect"), "effect_confirmed")
        .when(F.col("any_missed"), "missed")
        .otherwise("unconfirmed")
    )
    status = (
        F.when(F.col("interrupted") & ~executed, "interrupted")
        .when(F.col("failed"), "failed")
        .when(executed & (F.col("result_count") > 0), "damage_confirmed")
        .otherwise(outcome)
    )
    actable = groups.filter(~F.col("ambiguous") & (executed | F.col("interrupted")))
    return actable.select(
        *GROUP_KEYS,
        "order_min",
        F.when(executed, F.col("executed.order")).otherwise(F.col("interrupt_line.order")).alias("order"),
        chosen.getField("declared_actor").alias("actor"),
        chosen.getField("declared_action").alias("action_name"),
        chosen.getField("declared_type").alias("action_type"),
        status.alias("status"),
        executed.alias("is_executed"),
        done("damage").alias("damage"),
        F.coalesce(done("result_count"), F.lit(0)).alias("result_count"),
        *[done(k).alias(k) for k in fixed.RESOURCE_KINDS],
        F.coalesce(done("resource_count"), F.lit(0)).alias("resource_count"),
        F.when(
            executed & (chosen.getField("declared_type") == "ability"), _roll(chosen.getField("declared_action"))
        ).alias("roll_total"),
    )


def reference_time(events: DataFrame, log: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """As-of lookup: the last timed line of the session at or before each event; nothing is interpolated.

    Events must be anchored at lines of ``log`` (timed or not).
    """
    timed = F.when(~is_blank("message_time_text"), F.struct(F.col("message_time_text").alias("text"), F.col("order")))
    lines = (
        as_log(log)
        .filter(F.col("order").isNotNull())
        .select(
            F.coalesce("session_id", F.lit("")).alias("_session"),
            F.col("order").alias("_at"),
            timed.alias("_time"),
            F.col("read_index").alias("_tie"),
        )
    )
    anchored = events.filter(F.col("order").isNotNull()).select(
        F.col("session_id").alias("_session"),
        F.col("order").alias("_at"),
        F.lit(None).cast("struct<text:string,order:bigint>").alias("_time"),
        F.lit(None).cast("bigint").alias("_tie"),
        F.struct(*events.columns).alias("_event"),
    )
    lines = lines.withColumn("_event", F.lit(None).cast(anchored.schema["_event"].dataType))
    both = lines.filter(F.col("_time").isNotNull()).unionByName(anchored)
    found = running(
        both, "_at", ["_session"], lasts={"_seen": F.col("_time")},
        ties=[F.col("_event").isNotNull(), "_tie"], slice_rows=slice_rows, carriers=lines,
    ).filter(F.col("_event").isNotNull())
    seen = found.select(
        "_event.*", F.col("_seen.text").alias("reference_time"), F.col("_seen.order").alias("reference_order")
    )
    unanchored = events.filter(F.col("order").isNull()).withColumns(
        {"reference_time": F.lit(None).cast("string"), "reference_order": F.lit(None).cast("bigint")}
    )
    return seen.unionByName(unanchored)


def timeline_results(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Target results and resource results of the events, one row each, in long form."""
    hits = F.struct(
        F.lit("damage").alias("kind"), F.col("result_target").alias("target"), F.col("result_damage").alias("amount")
    )
    resources = F.struct(
        F.col("resource_kind").alias("kind"), F.col("resource_target").alias("target"),
        F.col("resource_amount").alias("amount"),
    )
    both = F.array(
        F.when(F.col("result_damage").isNotNull(), hits), F.when(F.col("resource_amount").isNotNull(), resources)
    )
    shown = lines.filter(
        ~F.col("in_chain") & (F.col("result_damage").isNotNull() | F.col("resource_amount").isNotNull())
    )
    executed = events.filter("is_executed").select(*EVENT_KEYS)
    return (
        shown.join(executed, GROUP_KEYS, "left_semi")
        .select(*GROUP_KEYS, F.col("order").alias("line_order"), F.explode(both).alias("_r"))
        .filter(F.col("_r").isNotNull())
        .select(*GROUP_KEYS, "line_order", "_r.*")
    )


def resource_totals(results: DataFrame) -> DataFrame:
    """Recovered and absorbed amounts per event and kind."""
    return (
        results.filter(F.col("kind") != "damage")
        .groupBy(*GROUP_KEYS, "kind")
        .agg(F.sum("amount").alias("amount"))
    )


def timeline_warnings(log: DataFrame, groups: DataFrame) -> DataFrame:
    """What the timeline left out: ambiguous groups, and lines without a group (with their number)."""
    ambiguous = groups.filter("ambiguous").select(
        F.lit("ambiguous_group").alias("code"), F.concat_ws(":", *GROUP_KEYS).alias("subject"),
        F.lit(1).cast("bigint").alias("lines"),
    )
    lost = as_log(log).agg(
        F.count_if(is_blank("session_id") | is_blank("event_group")).alias("lines")
    ).filter(F.col("lines") > 0)
    missing = lost.select(F.lit("lines_without_group").alias("code"), F.lit("").alias("subject"), "lines")
    return ambiguous.unionByName(missing)


def build_timeline(
    included: DataFrame,
    range_lines: DataFrame | None = None,
    rules: RuleSet = DEFAULT_RULES,
    hot_rows: int = HOT_GROUP_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(events, warnings). Times come from the whole range, actions from the lines kept in it."""
    lines = with_chain_section(declarations(included, rules), hot_rows, slice_rows)
    groups = timeline_groups(lines)
    times = included if range_lines is None else range_lines
    events = reference_time(timeline_events(groups), times, slice_rows)
    return events, timeline_warnings(included, groups)


def number_events(events: DataFrame) -> DataFrame:
    """``event_no`` 1.. in timeline order: anchor line (missing last), then group order."""
    return dense_order(
        events,
        [
            F.col("order").isNull(), F.col("order"),
            F.col("order_min").isNull(), F.col("order_min"),
            F.concat_ws(":", *GROUP_KEYS),
        ],
        name="event_no",
    )


def order_timeline(events: DataFrame) -> DataFrame:
    return events.orderBy(
        F.asc_nulls_last("order"), F.asc_nulls_last("order_min"), F.concat_ws(":", *GROUP_KEYS)
    )
