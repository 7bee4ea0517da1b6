"""The replaceable rule set that turns lines into actions.

A rule looks at one line and returns a column; groups then take the first line that gives a value.
Replace any of the five parts (or use a pandas UDF for one); the rest keeps working.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomlog.functions import fixed_values as fixed
from loomlog.functions.text import capture, contains_any, matches_any

LineRule = Callable[[Column], Column]


def normal_attack_actor(text: Column) -> Column:
    return capture(text, fixed.NORMAL_ATTACK, 1, "の攻撃")


def activation(text: Column, part: int) -> Column:
    """Actor (1) or action (2) of a spell that went off."""
    return capture(text, fixed.ACTIVATION, part, "が発動")


def cast_start(text: Column, part: int) -> Column:
    """Actor (1) or action (2) of a started cast, with or without a target."""
    return F.coalesce(
        capture(text, fixed.CAST_START_WITH_TARGET, part, "を唱えた"),
        capture(text, fixed.CAST_START, part, "を唱えた"),
    )


def skill_name(text: Column) -> Column:
    return capture(text, fixed.SKILL, 1, "を実行")


def ability(text: Column) -> Column:
    """struct(actor, name) of a declared ability; the job-point notice has the same shape but is none."""
    part = lambda group: F.coalesce(
        *(
            capture(text, pattern, group)
            for pattern in (fixed.ABILITY_ROLL, fixed.ABILITY_DOUBLE_UP, fixed.ABILITY_DECLARATION)
        )
    )
    # All three shapes begin with an ASCII letter and have one of these ends: two cheap tests.
    shaped = F.ascii(text).between(65, 122) & (
        F.endswith(text, F.lit("！")) | F.endswith(text, F.lit("!")) | F.endswith(text, F.lit(fixed.DOUBLE_UP_NAME))
    )
    declared = F.when(shaped, F.struct(part(1).alias("actor"), part(2).alias("name")))
    return F.when(declared.getField("name") != fixed.JOB_POINT_NOTICE, declared)


def roll_total(text: Column) -> Column:
    """Total named by a roll declaration line."""
    return capture(text, fixed.ABILITY_ROLL, 3, "ロール→合計値が").try_cast("bigint")


def double_up_total(text: Column) -> Column:
    """Total named by a double-up result line."""
    return capture(text, fixed.DOUBLE_UP_RESULT, 1, "ロールの合計値が").try_cast("bigint")


def damage_values(text: Column) -> Column:
    """All damage numbers of one line, as ARRAY<BIGINT>."""
    found = F.regexp_extract_all(text, F.lit(fixed.DAMAGE_VALUE), F.lit(1))
    numbers = F.filter(F.transform(found, lambda n: n.try_cast("bigint")), lambda n: n.isNotNull())
    return F.when(contains_any(text, ("ダメージ", "HP吸収")), numbers)


def has_nondamage_success(text: Column) -> Column:
    return matches_any(
        text,
        (
            ("の効果", fixed.EFFECT_GAINED),
            ("の状態になった", fixed.STATUS_GAINED),
            ("吸収", fixed.RESOURCE_ABSORBED),
            ("回復", fixed.HP_RECOVERED),
            ("の効果を消し去った", fixed.STATUS_REMOVED),
        ),
    )


def default_hit_status(has_damage: Column, excluded: Column, effect: Column, missed: Column) -> Column:
    return (
        F.when(excluded, "excluded")
        .when(has_damage | effect, "hit")
        .when(missed, "miss")
        .otherwise("unknown")
    )


@dataclass(frozen=True)
class RuleSet:
    """Rules for lines and groups.

    ``line_actor``, ``line_action`` and ``line_type`` replace the built-in extraction of one line
    when given; the group then takes the first line with a value. ``weapon_skills`` is the catalogue
    that tells weapon skills from abilities among executed actions: exact names. For a catalogue
    kept as a table use :meth:`with_catalog`.
    """

    weapon_skills: tuple[str, ...] = ()
    line_actor: LineRule | None = None
    line_action: LineRule | None = None
    line_type: LineRule | None = None
    line_damage: LineRule = damage_values
    hit_status: Callable[[Column, Column, Column, Column], Column] = default_hit_status
    critical_words: tuple[str, ...] = fixed.CRITICAL_WORDS
    excluded_words: tuple[str, ...] = fixed.EXCLUDED_WORDS
    miss_words: tuple[str, ...] = fixed.MISS_WORDS

    @classmethod
    def with_catalog(cls, catalog: DataFrame, **rules) -> "RuleSet":
        """Read the catalogue from a table with a ``name`` column (its distinct names become part of the plan)."""
        names = (r[0] for r in catalog.select("name").distinct().collect())
        return cls(weapon_skills=tuple(sorted(n for n in names if n is not None)), **rules)

    def is_weapon_skill(self, name: Column) -> Column:
        return name.isin(*self.weapon_skills) if self.weapon_skills else F.lit(False)


DEFAULT_RULES = RuleSet()
