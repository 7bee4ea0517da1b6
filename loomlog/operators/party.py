"""Live party metrics: roster rows, shares of the best member, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomlog.functions.numbers import rate
from loomlog.operators.actors import cap_roster

ROSTER = "roster_pos INT, name STRING"


def roster(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(cap_roster(names), 1)), ROSTER)


def party_metrics(actors: DataFrame, members: DataFrame) -> DataFrame:
    """One row per roster member: DPS, hit rate and the share of the best member's DPS (0 to 1).

    Names match in any case; of several spellings the first in name order counts.
    """
    first = actors.groupBy(F.upper("actor").alias("_key")).agg(
        F.min_by(
            F.struct("actor", "dps", "normal_attack_hit_rate", "attack_hits", "attack_misses"), F.col("actor")
        ).alias("a")
    )
    rows = members.withColumn("_key", F.upper("name")).join(first, "_key", "left").select(
        "roster_pos", "name", "a.*"
    )
    best = rows.select(F.max(F.coalesce(F.col("dps"), F.lit(0.0)))).scalar()
    share = F.least(F.greatest(F.coalesce(F.col("dps"), F.lit(0.0)) / F.col("_best"), F.lit(0.0)), F.lit(1.0))
    return (
        rows.withColumn("_best", best)
        .withColumn("dps_share", F.when(F.col("_best") > 0, share).otherwise(F.lit(0.0)))
        .drop("_best")
    )


def order_party(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc_nulls_last("dps"), "roster_pos")


def party_totals(metrics: DataFrame) -> DataFrame:
    """One row: summed DPS of the members that have one, hit rate pooled over attacks."""
    return (
        metrics.agg(
            F.sum("dps").alias("total_dps"),
            F.coalesce(F.sum("attack_hits"), F.lit(0)).alias("_hits"),
            F.coalesce(F.sum("attack_misses"), F.lit(0)).alias("_misses"),
        )
        .withColumn("total_hit_rate", rate("_hits", F.col("_hits") + F.col("_misses")))
        .drop("_hits", "_misses")
    )
