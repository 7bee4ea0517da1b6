"""What happened to targets: damage taken, evasions and misses, one result per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomlog.functions import fixed_values as fixed
from loomlog.functions.text import capture, contains_any, strip
from loomlog.operators.grouping import GROUP_KEYS, group_sort_key, groupable
from loomlog.schemas import as_log


def line_targets(log: DataFrame) -> DataFrame:
    """Lines with an incoming result: ``target`` and ``damage`` (null for an evasion or a miss)."""
    hits = ("ダメージ", "HP吸収")
    text = F.col("visible_text")
    damage = capture(text, fixed.INCOMING_DAMAGE, 2, hits).try_cast("bigint")
    evaded = F.coalesce(
        capture(text, fixed.INCOMING_EVADE, 1, ("回避した", "かわした")),
        capture(text, fixed.INCOMING_MISS, 1, "に、ミス"),
    )
    words = contains_any(text, (*hits, "回避した", "かわした", "に、ミス"))
    lines = groupable(as_log(log))
    seen = lines.filter(words).withColumns(
        {"_damage": damage, "_hit": capture(text, fixed.INCOMING_DAMAGE, 1, hits), "_evaded": evaded}
    )
    target = strip(F.when(F.col("_damage").isNotNull(), F.col("_hit")).otherwise(F.col("_evaded")))
    # Exploding a null gives no row. A filter would do the same, but it would be pushed below the
    # projection and match every pattern twice.
    found = F.when(target.isNotNull(), F.array(F.struct(target.alias("target"), F.col("_damage").alias("damage"))))
    return seen.select(*lines.columns, F.explode(found).alias("_r")).select(*lines.columns, "_r.*")


def incoming_results(log: DataFrame, actions: DataFrame) -> DataFrame:
    """Incoming results with an outcome: hit or miss for physical actions before the chain section.

    The chain word is sticky to the end of its group, so one first position per group is enough.
    """
    lines = as_log(log)
    key = group_sort_key()
    chain = (
        groupable(lines)
        .filter(F.col("visible_text").contains(fixed.CHAIN_WORD))
        .groupBy(*GROUP_KEYS)
        .agg(F.min(key).alias("_chain"))
    )
    groups = actions.select(*GROUP_KEYS, "action_type").join(chain, GROUP_KEYS, "left")
    results = line_targets(lines).withColumn("_key", key).join(groups, GROUP_KEYS, "left")
    counted = F.col("action_type").isin(*fixed.PHYSICAL_TYPES) & (
        F.col("_chain").isNull() | (F.col("_key") < F.col("_chain"))
    )
    outcome = F.when(F.col("damage").isNotNull(), "hit").otherwise("miss")
    return results.select(
        *GROUP_KEYS,
        "order",
        "read_index",
        "target",
        "damage",
        F.when(counted, outcome).otherwise("unknown").alias("status"),
    )


def summarize_incoming(results: DataFrame) -> DataFrame:
    """Damage taken and evasion per target."""
    evaded, hit = F.col("evade_count"), F.col("incoming_hit_count")
    return (
        results.groupBy("target")
        .agg(
            F.coalesce(F.sum("damage"), F.lit(0)).alias("incoming_total"),
            F.count("damage").alias("incoming_count"),
            F.max("damage").alias("incoming_max"),
            F.min("damage").alias("incoming_min"),
            F.count_if(F.col("status") == "hit").alias("incoming_hit_count"),
            F.count_if(F.col("status") == "miss").alias("evade_count"),
        )
        .withColumns(
            {
                "incoming_average": F.col("incoming_total").cast("double")
                / F.nullif(F.col("incoming_count"), F.lit(0)).cast("double"),
                "evasion_rate": F.when(
                    evaded + hit > 0, evaded.cast("double") / (evaded + hit).cast("double")
                ),
            }
        )
    )
