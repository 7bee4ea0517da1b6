"""Who is who: name registry, actor kinds, actor filters and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomlog.functions import fixed_values as fixed
from loomlog.functions.text import contains_ignoring_case, normalize_name

PC_LIKE = ("registered_pc", "pc_candidate")
REGISTRY = "name STRING, kind STRING, seq BIGINT"


def name_registry(spark: SparkSession, pc: Sequence[str] = (), npc: Sequence[str] = ()) -> DataFrame:
    """Registered names as a table ``(name, kind)``; players are listed first, then the others."""
    rows = [(n, "registered_pc", i) for i, n in enumerate(pc)]
    rows += [(n, "registered_npc", len(rows) + i) for i, n in enumerate(npc)]
    return settle_registry(spark.createDataFrame(rows, REGISTRY))


def settle_registry(entries: DataFrame) -> DataFrame:
    """One kind per name, whatever its case: the latest registration (largest ``seq``) wins."""
    named = entries.withColumn("name", normalize_name("name")).filter(F.col("name") != "")
    return (
        named.groupBy(F.upper("name").alias("name_key"))
        .agg(F.max_by(F.struct("name", "kind"), F.col("seq")).alias("latest"))
        .select("name_key", "latest.name", "latest.kind")
    )


def actor_kind(actors: DataFrame, registry: DataFrame, column: str = "actor") -> DataFrame:
    """Add ``kind``: registered as non-player, as player, looks like a player, or unknown."""
    precedence = F.min(F.array_position(F.array(*[F.lit(k) for k in fixed.ACTOR_KINDS]), F.col("kind")))
    ranked = registry.groupBy(F.upper(normalize_name("name")).alias("_key")).agg(precedence.alias("_rank"))
    registered = F.element_at(F.array(*[F.lit(k) for k in fixed.ACTOR_KINDS]), F.col("_rank").cast("int"))
    guess = F.when(F.regexp_like(F.col(column), F.lit(fixed.PC_NAME)), "pc_candidate").otherwise("unknown")
    return (
        actors.withColumn("_key", F.upper(normalize_name(column)))
        .join(ranked, "_key", "left")
        .withColumn("kind", F.coalesce(F.when(F.col("_rank") > 0, registered), guess))
        .drop("_key", "_rank")
    )


def filter_actors(actors: DataFrame, text: str = "", kinds: Sequence[str] = fixed.ACTOR_KINDS) -> DataFrame:
    """Actors whose name contains ``text`` and whose ``kind`` is switched on."""
    kept = actors.filter(F.col("kind").isin(*kinds)) if kinds else actors.filter(F.lit(False))
    needle = text.strip()
    return kept.filter(contains_ignoring_case("actor", needle)) if needle else kept


def visible_actors(actors: DataFrame, preset: str = "default") -> DataFrame:
    """Names shown for a preset: ``default`` and ``pc_like``, ``registered_pc``, ``all``, ``none``."""
    kinds = {
        "default": PC_LIKE,
        "pc_like": PC_LIKE,
        "registered_pc": ("registered_pc",),
        "all": fixed.ACTOR_KINDS,
        "none": (),
    }[preset]
    return filter_actors(actors, kinds=kinds).select("actor")


def restrict_actors(summary: DataFrame, visible: DataFrame) -> DataFrame:
    return summary.join(visible.select("actor").distinct(), "actor", "left_semi")


def party_candidates(actors: DataFrame) -> DataFrame:
    """Player-like actors merged over upper and lower case, with their uses summed."""
    return (
        actors.filter(F.col("kind").isin(*PC_LIKE))
        .groupBy(F.upper("actor").alias("name_key"))
        .agg(F.min("actor").alias("actor"), F.sum("use_count").alias("use_count"))
        .drop("name_key")
    )


def timeline_candidates(actors: DataFrame, timeline: DataFrame, registry: DataFrame) -> DataFrame:
    """Player-like names among actors and timeline events, with the kind that made them candidates."""
    names = actors.select("actor").union(timeline.select("actor")).distinct()
    return actor_kind(names, registry).filter(F.col("kind").isin(*PC_LIKE))


def keep_selected(selected: DataFrame, candidates: DataFrame) -> DataFrame:
    """What stays selected after the candidates changed."""
    return selected.select("actor").intersect(candidates.select("actor"))


def cap_roster(names: Sequence[str], limit: int = 6) -> list[str]:
    """A party roster: first spelling of each name, at most ``limit`` of them.

    The cap is the feature: a party has six places.
    """
    kept: dict[str, str] = {}
    for name in names:
        if name and name.strip():
            kept.setdefault(name.strip().upper(), name.strip())
    return list(kept.values())[:limit]
