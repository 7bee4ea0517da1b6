"""Roll-ups of parsed actions: per action, per actor, normal attacks, points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomlog.functions import fixed_values as fixed
from loomlog.functions.numbers import per_hour, per_second, rate
from loomlog.functions.text import capture
from loomlog.operators.incoming import summarize_incoming


def count_status(status: str) -> Column:
    return F.count_if(F.col("hit_status") == status)


def damage_statistics() -> list[Column]:
    """Total (0 when empty), largest, smallest and count over single damage values."""
    return [
        F.coalesce(F.sum("damage_total"), F.lit(0)).alias("total_damage"),
        F.max("damage_max").alias("max_damage"),
        F.min("damage_min").alias("min_damage"),
        F.coalesce(F.sum("damage_count"), F.lit(0)).alias("damage_values"),
    ]


def average_damage() -> Column:
    return rate("total_damage", "damage_values")


def type_rank(kind: Column | str = "action_type") -> Column:
    """Position of an action type in the fixed order."""
    names = F.array(*[F.lit(n) for n in fixed.ACTION_TYPES])
    return F.array_position(names, F.col(kind) if isinstance(kind, str) else kind)


def summarize_actions(actions: DataFrame) -> DataFrame:
    """Uses, outcomes and damage per actor, action and type."""
    hits, misses = F.col("hit_count"), F.col("miss_count")
    return (
        actions.filter("parsed")
        .groupBy("actor", "action_name", "action_type")
        .agg(
            F.count_if(F.col("hit_status") != "excluded").alias("use_count"),
            count_status("hit").alias("hit_count"),
            count_status("miss").alias("miss_count"),
            count_status("unknown").alias("unknown_count"),
            *damage_statistics(),
        )
        .withColumns({"hit_rate": rate(hits, hits + misses), "average_damage": average_damage()})
    )


def normal_attack_columns() -> list[Column]:
    normal = F.col("action_type").isin("normal_attack", "normal_attack_critical")
    critical = F.col("action_type") == "normal_attack_critical"
    hit = F.col("hit_status") == "hit"
    return [
        F.count_if(normal & hit).alias("attack_hits"),
        F.count_if(normal & (F.col("hit_status") == "miss")).alias("attack_misses"),
        F.count_if(critical & hit).alias("attack_criticals"),
    ]


def normal_attack_rates() -> dict[str, Column]:
    hits, misses = F.col("attack_hits"), F.col("attack_misses")
    return {
        "normal_attack_hit_rate": rate(hits, hits + misses),
        "normal_attack_critical_rate": rate("attack_criticals", hits),
    }


def normal_attack_summary(actions: DataFrame) -> DataFrame:
    return (
        actions.filter("parsed").groupBy("actor").agg(*normal_attack_columns()).withColumns(normal_attack_rates())
    )


def attach_time(df: DataFrame, time: DataFrame) -> tuple[DataFrame, Column]:
    """The one-row time result as a scalar subquery: no join, no driver round trip."""
    fields = time.select(F.struct("duration_seconds", "confidence")).scalar()
    return df.withColumn("_time", fields), F.col("_time")


def summarize_actors(actions: DataFrame, incoming: DataFrame, time: DataFrame) -> DataFrame:
    """Everybody who acts or is hit: damage dealt, DPS, rates, counts, damage taken, evasion."""
    outgoing = actions.filter("parsed").groupBy("actor").agg(
        F.count_if(F.col("hit_status") != "excluded").alias("use_count"),
        count_status("hit").alias("hit_count"),
        count_status("miss").alias("miss_count"),
        count_status("unknown").alias("unknown_count"),
        *damage_statistics(),
        *normal_attack_columns(),
    )
    taken = summarize_incoming(incoming)
    counts = (
        "use_count", "hit_count", "miss_count", "unknown_count", "total_damage", "damage_values",
        "attack_hits", "attack_misses", "attack_criticals",
        "incoming_total", "incoming_count", "incoming_hit_count", "evade_count",
    )
    both = outgoing.join(taken, outgoing["actor"] == taken["target"], "full_outer").withColumn(
        "actor", F.coalesce(outgoing["actor"], taken["target"])
    ).drop("target")
    both = both.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in counts})
    both, resolved = attach_time(both, time)
    confidence = F.coalesce(resolved.getField("confidence"), F.lit("unknown"))
    return both.withColumns(
        {
            **normal_attack_rates(),
            "average_damage": average_damage(),
            "dps": per_second("total_damage", resolved.getField("duration_seconds"), confidence),
            "time_confidence": confidence,
        }
    ).drop("_time")


def actor_with_actions(actor_summary: DataFrame, action_summary: DataFrame) -> DataFrame:
    """Actors with their action summaries nested.

    The nested list holds one entry per distinct action of the actor, not one per log line.
    """
    fields = [c for c in action_summary.columns if c != "actor"]
    nested = action_summary.groupBy("actor").agg(
        F.array_sort(F.collect_list(F.struct("action_name", type_rank().alias("type_rank"), *[
            c for c in fields if c != "action_name"
        ]))).alias("actions")
    )
    return actor_summary.join(nested, "actor", "left")


def order_summary(summary: DataFrame) -> DataFrame:
    """Actor, then action, then type in its fixed order."""
    if "action_type" in summary.columns:
        return summary.orderBy("actor", "action_name", type_rank())
    return summary.orderBy("actor")


def sort_table(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Column sort of result tables: missing values first going up, last going down."""
    return df.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_first(column))


def point_gains(log: DataFrame) -> DataFrame:
    """Point lines: ``point_name``, ``points`` and the chain number if one is given."""
    text = F.col("visible_text")
    gained, bonus = "を獲得した", "ガリモーフリーを"
    points = F.coalesce(
        capture(text, fixed.POINT_GAIN, 2, gained), capture(text, fixed.GALLIMAUFRY_GAIN, 1, bonus)
    )
    seen = log.filter(text.contains(gained) | text.contains(bonus)).withColumns(
        {
            "_points": points.try_cast("bigint"),
            "_name": F.coalesce(capture(text, fixed.POINT_GAIN, 3, gained), F.lit(fixed.GALLIMAUFRY)),
            "_chain": capture(text, fixed.POINT_GAIN, 1, gained).try_cast("bigint"),
        }
    )
    gain = F.struct(
        F.col("_name").alias("point_name"), F.col("_points").alias("points"), F.col("_chain").alias("chain")
    )
    # Exploding a null drops the line without matching the patterns a second time in a pushed filter.
    found = F.explode(F.when(F.col("_points").isNotNull(), F.array(gain)))
    return seen.select(*log.columns, found.alias("_g")).select(*log.columns, "_g.*")


def summarize_points(log: DataFrame, time: DataFrame) -> DataFrame:
    """The four point kinds, always all four: total, longest chain, points per hour."""
    sums = point_gains(log).groupBy("point_name").agg(
        F.sum("points").alias("total_points"), F.max("chain").alias("max_chain")
    )
    names = log.sparkSession.createDataFrame(
        [(i + 1, n) for i, n in enumerate(fixed.POINT_NAMES)], "point_rank INT, point_name STRING"
    )
    full = names.join(sums, "point_name", "left").withColumns(
        {n: F.coalesce(F.col(n), F.lit(0)).cast("bigint") for n in ("total_points", "max_chain")}
    )
    full, resolved = attach_time(full, time)
    hourly = per_hour(
        "total_points",
        resolved.getField("duration_seconds"),
        F.coalesce(resolved.getField("confidence"), F.lit("unknown")),
    )
    return full.withColumn("points_per_hour", hourly).drop("_time")
