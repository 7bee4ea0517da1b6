"""Line facts and group classification.

Every regex runs once per line, before the shuffle, behind a cheap literal test. Groups are then
built from mergeable aggregates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomlog.functions import fixed_values as fixed
from loomlog.functions.text import capture, contains_any, is_blank, null_if_blank
from loomlog.operators import rules as r
from loomlog.operators.grouping import GROUP_KEYS, group_sort_key, groupable
from loomlog.operators.rules import DEFAULT_RULES, RuleSet
from loomlog.schemas import as_log


def line_facts(log: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Add what one line says on its own: actors, names, type, damage numbers and flags.

    Columns added: ``attack_actor``, actor and name of ``spell_*`` and ``cast_*``, ``line_actor``,
    ``line_action``, ``line_type``, ``damages``, the booleans ``is_critical``, ``is_excluded``,
    ``has_effect`` and ``is_missed``, and the line's place in its group (``sort_key``).
    """
    # Empty lines carry no text to classify; they still count as lines of their group.
    text = F.when(F.col("visible_text") != "", F.col("visible_text"))
    seen = as_log(log).withColumns({"_text": text, "sort_key": group_sort_key()})
    text = F.col("_text")
    found = seen.withColumns(
        {
            "attack_actor": r.normal_attack_actor(text),
            "spell_actor": r.activation(text, 1),
            "spell_name": r.activation(text, 2),
            "cast_actor": r.cast_start(text, 1),
            "cast_name": r.cast_start(text, 2),
            "_ability": r.ability(text),
            "_skill": r.skill_name(text),
            "_user": capture(text, fixed.CAST_OR_USE_ACTOR, 1, ("を実行", "を唱えた")),
            "_activated": capture(text, fixed.ACTIVATED_ACTOR, 1, "が発動"),
            "damages": rules.line_damage(text),
            "is_critical": contains_any(text, rules.critical_words),
            "is_excluded": contains_any(text, rules.excluded_words),
            "has_effect": r.has_nondamage_success(text),
            "is_missed": contains_any(text, rules.miss_words),
        }
    )
    line_actor = F.coalesce(F.col("_ability.actor"), F.col("attack_actor"), F.col("_user"), F.col("_activated"))
    line_action = F.coalesce(
        F.col("_ability.name"),
        F.when(F.col("attack_actor").isNotNull(), fixed.NORMAL_ATTACK_NAME),
        F.col("_skill"),
    )
    line_type = (
        F.when(
            F.col("_skill").isNotNull(),
            F.when(rules.is_weapon_skill(F.col("_skill")), "weapon_skill").otherwise("ability"),
        ).when(F.col("_ability").isNotNull(), "ability")
    )
    return found.withColumns(
        {
            "line_actor": null_if_blank(rules.line_actor(text) if rules.line_actor else line_actor),
            "line_action": null_if_blank(rules.line_action(text) if rules.line_action else line_action),
            "line_type": rules.line_type(text) if rules.line_type else line_type,
        }
    ).drop("_text", "_ability", "_skill", "_user", "_activated")


def attack_type(is_critical: Column) -> Column:
    return F.when(is_critical, "normal_attack_critical").otherwise("normal_attack")


def _any(flag: str) -> Column:
    return F.coalesce(F.max(flag), F.lit(False))


def parse_groups(log: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """One row per action group: who, what, which type, how much, with what outcome.

    ``parsed`` is false for groups without an actor or an action; ``reason`` says so. Damage is kept
    as count, total, largest and smallest, which is all that the summaries need.
    """
    return classify_groups(group_facts(line_facts(groupable(as_log(log)), rules)), rules)


def group_facts(facts: DataFrame) -> DataFrame:
    """First matches, flags and damage totals per group, from :func:`line_facts`."""
    first = lambda name: F.min_by(name, F.when(F.col(name).isNotNull(), F.col("sort_key"))).alias(name)
    pair = lambda name: F.min_by(
        F.struct(F.col(f"{name}_actor").alias("actor"), F.col(f"{name}_name").alias("name")),
        F.when(F.col(f"{name}_actor").isNotNull(), F.col("sort_key")),
    ).alias(name)
    total = F.aggregate(F.col("damages"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return facts.groupBy(*GROUP_KEYS).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.min("order").alias("order_min"),
        F.max("order").alias("order_max"),
        pair("spell"),
        pair("cast"),
        *[first(n) for n in ("attack_actor", "line_actor", "line_action", "line_type")],
        *[_any(n).alias(n) for n in ("is_critical", "is_excluded", "has_effect", "is_missed")],
        F.coalesce(F.sum(F.size("damages")), F.lit(0)).alias("damage_count"),
        F.coalesce(F.sum(total), F.lit(0)).alias("damage_total"),
        F.max(F.array_max("damages")).alias("damage_max"),
        F.min(F.array_min("damages")).alias("damage_min"),
    )


def classify_groups(groups: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Turn group facts into actions. A started cast that never went off decides everything."""
    only_started = F.col("spell").isNull() & F.col("cast").isNotNull()
    has_damage = F.col("damage_count") > 0
    actor = F.col("line_actor") if rules.line_actor else F.coalesce("attack_actor", "spell.actor", "line_actor")
    action = (
        F.col("line_action")
        if rules.line_action
        else F.coalesce(
            F.when(F.col("attack_actor").isNotNull(), fixed.NORMAL_ATTACK_NAME), "spell.name", "line_action"
        )
    )
    kind = (
        F.col("line_type")
        if rules.line_type
        else F.when(F.col("attack_actor").isNotNull(), attack_type(F.col("is_critical")))
        .when(F.col("spell").isNotNull(), "magic")
        .otherwise(F.col("line_type"))
    )
    status = rules.hit_status(has_damage, F.col("is_excluded"), F.col("has_effect"), F.col("is_missed"))
    acted = groups.select(
        *GROUP_KEYS,
        "line_count",
        "order_min",
        "order_max",
        only_started.alias("_started"),
        F.when(only_started, F.col("cast.actor")).otherwise(actor).alias("actor"),
        F.when(only_started, F.col("cast.name")).otherwise(action).alias("action_name"),
        F.when(only_started, "magic").otherwise(F.coalesce(kind, F.lit("unknown"))).alias("action_type"),
        F.when(only_started, "excluded").otherwise(status).alias("hit_status"),
        *[
            F.when(~only_started, F.col(n)).otherwise(F.lit(0 if n in ("damage_count", "damage_total") else None))
            .cast("bigint").alias(n)
            for n in ("damage_count", "damage_total", "damage_max", "damage_min")
        ],
    )
    parsed = F.col("_started") | (~is_blank("actor") & ~is_blank("action_name"))
    return acted.withColumns(
        {"parsed": parsed, "reason": F.when(~parsed, fixed.UNPARSED_REASON)}
    ).drop("_started")


def unresolved(actions: DataFrame) -> DataFrame:
    """Groups to look at: unparsed ones, and parsed ones with unknown type or outcome, with reasons."""
    unknown_type = F.when(F.col("parsed") & (F.col("action_type") == "unknown"), "unknown_type")
    unknown_status = F.when(F.col("parsed") & (F.col("hit_status") == "unknown"), "unknown_status")
    reason = F.concat_ws(",", F.when(~F.col("parsed"), "unparsed"), unknown_type, unknown_status)
    return actions.withColumn("why", reason).filter(F.col("why") != "")
