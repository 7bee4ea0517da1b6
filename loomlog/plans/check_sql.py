"""Check queries: the same results as SQL for DuckDB, written the list-and-window way.

Where the operators aggregate line facts, these build the ordered list of texts of a group and look
through it, so the two ways share nothing but the fixed patterns and the derived log.
"""

from __future__ import annotations

import re

from loomlog.functions import fixed_values as fixed
from loomlog.plans.derived import CATALOG, LOG_CTE
from loomlog.plans.derived_raw import JSON_LINE, RAW_CTE
from loomlog.plans.queries import MEMBERS

CHECKS: dict[str, str] = {}


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pattern(value: str) -> str:
    """A fixed pattern in RE2 form: unnamed groups, no line-end flag."""
    return text_literal(re.sub(r"\(\?<\w+>", "(", value.removeprefix("(?d)")))


def matches(t: str, value: str) -> str:
    return f"regexp_matches({t}, {pattern(value)})"


def extract(t: str, value: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({t}, {pattern(value)}, {group}), '')"


def has_word(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, {text_literal(w)})" for w in words) + ")"


def first(expression: str, texts: str = "texts") -> str:
    return f"list_filter(list_transform({texts}, lambda t: {expression}), lambda x: x IS NOT NULL)[1]"


def any_text(condition: str, texts: str = "texts") -> str:
    return f"(len(list_filter({texts}, lambda t: {condition})) > 0)"


def ability(t: str, part: int) -> str:
    shapes = (fixed.ABILITY_ROLL, fixed.ABILITY_DOUBLE_UP, fixed.ABILITY_DECLARATION)
    pick = lambda n: "CASE " + " ".join(f"WHEN {matches(t, p)} THEN {extract(t, p, n)}" for p in shapes) + " END"
    return f"(CASE WHEN {pick(2)} <> {text_literal(fixed.JOB_POINT_NOTICE)} THEN {pick(part)} END)"


def cast_start(t: str, part: int) -> str:
    return f"coalesce({extract(t, fixed.CAST_START_WITH_TARGET, part)}, {extract(t, fixed.CAST_START, part)})"


def line_actor(t: str) -> str:
    return (
        f"coalesce({ability(t, 1)}, {extract(t, fixed.NORMAL_ATTACK)}, {extract(t, fixed.CAST_OR_USE_ACTOR)},"
        f" {extract(t, fixed.ACTIVATED_ACTOR)})"
    )


def line_action(t: str) -> str:
    return (
        f"coalesce({ability(t, 2)}, CASE WHEN {matches(t, fixed.NORMAL_ATTACK)} THEN {text_literal(fixed.NORMAL_ATTACK_NAME)} END,"
        f" {extract(t, fixed.SKILL)})"
    )


def line_type(t: str) -> str:
    names = ", ".join(text_literal(n) for n in CATALOG)
    return (
        f"CASE WHEN {matches(t, fixed.SKILL)} THEN CASE WHEN {extract(t, fixed.SKILL)} IN ({names})"
        f" THEN 'weapon_skill' ELSE 'ability' END WHEN {ability(t, 2)} IS NOT NULL THEN 'ability' END"
    )


def effect(t: str) -> str:
    shapes = (
        fixed.EFFECT_GAINED, fixed.STATUS_GAINED, fixed.RESOURCE_ABSORBED, fixed.HP_RECOVERED, fixed.STATUS_REMOVED,
    )
    return "(" + " OR ".join(matches(t, p) for p in shapes) + ")"


IS_AREA = matches("trim(visible_text)", fixed.AREA_CHANGE)
RNG = f"rng AS MATERIALIZED (SELECT * FROM log WHERE NOT is_marker AND NOT {IS_AREA})"


def placed(source: str) -> str:
    """Groupable lines with their position in the group."""
    return f"""ln AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id, event_group ORDER BY sv, ss, read_index) AS pos
FROM (SELECT *, coalesce(CASE WHEN sequence_hint_min >= 0 THEN sequence_hint_min END, "order") AS sv,
CASE WHEN sequence_hint_min >= 0 THEN 0 ELSE 1 END AS ss FROM {source}
WHERE trim(event_group) <> ''))"""


GRP = """grp AS MATERIALIZED (SELECT session_id, event_group,
coalesce(list(visible_text ORDER BY pos) FILTER (visible_text <> ''), []) AS texts,
count(*) AS line_count, min("order") AS order_min, max("order") AS order_max FROM ln GROUP BY 1, 2)"""


def classified(source: str, prefix: str, keep: str) -> str:
    """CTEs `<prefix>` with actor, name, type, status and damages for rows that hold a list of texts."""
    damages = f"flatten(list_transform(texts, lambda t: regexp_extract_all(t, {pattern(fixed.DAMAGE_VALUE)}, 1)))"
    return f"""{prefix}0 AS MATERIALIZED (SELECT *,
{first(extract("t", fixed.NORMAL_ATTACK))} AS atk,
{first(extract("t", fixed.ACTIVATION, 1))} AS spa, {first(extract("t", fixed.ACTIVATION, 2))} AS spn,
{first(cast_start("t", 1))} AS ca, {first(cast_start("t", 2))} AS cn,
{first(line_actor("t"))} AS la, {first(line_action("t"))} AS ln_name, {first(line_type("t"))} AS lt,
list_transform({damages}, lambda x: CAST(x AS BIGINT)) AS dm,
{any_text(has_word("t", fixed.CRITICAL_WORDS))} AS crit, {any_text(has_word("t", fixed.EXCLUDED_WORDS))} AS excl,
{any_text(effect("t"))} AS eff, {any_text(has_word("t", fixed.MISS_WORDS))} AS missed
FROM {source}),
{prefix} AS MATERIALIZED (SELECT {keep}, spa IS NULL AND ca IS NOT NULL AS only_cast, ca IS NOT NULL AS is_start,
CASE WHEN spa IS NULL AND ca IS NOT NULL THEN ca ELSE coalesce(atk, spa, la) END AS actor,
CASE WHEN spa IS NULL AND ca IS NOT NULL THEN cn WHEN atk IS NOT NULL THEN {text_literal(fixed.NORMAL_ATTACK_NAME)}
  ELSE coalesce(spn, ln_name) END AS action_name,
CASE WHEN spa IS NULL AND ca IS NOT NULL THEN 'magic'
  WHEN atk IS NOT NULL THEN CASE WHEN crit THEN 'normal_attack_critical' ELSE 'normal_attack' END
  WHEN spa IS NOT NULL THEN 'magic' ELSE coalesce(lt, 'unknown') END AS action_type,
CASE WHEN spa IS NULL AND ca IS NOT NULL OR excl THEN 'excluded' WHEN len(dm) > 0 OR eff THEN 'hit'
  WHEN missed THEN 'miss' ELSE 'unknown' END AS hit_status,
CASE WHEN spa IS NULL AND ca IS NOT NULL THEN [] ELSE dm END AS dm
FROM {prefix}0)"""


ACT = classified("grp", "act0", "session_id, event_group, texts, line_count, order_min, order_max") + f""",
act AS MATERIALIZED (SELECT *, only_cast OR (trim(coalesce(actor, '')) <> '' AND trim(coalesce(action_name, '')) <> '') AS parsed,
CAST(len(dm) AS BIGINT) AS damage_count, CAST(coalesce(list_sum(dm), 0) AS BIGINT) AS damage_total,
list_max(dm) AS damage_max, list_min(dm) AS damage_min FROM act0)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def on_actions(select: str, source: str = "rng", *more: str) -> str:
    return ctes(LOG_CTE, RNG, *more, placed(source), GRP, ACT) + select


def stats() -> str:
    return """CAST(coalesce(sum(damage_total), 0) AS BIGINT) AS total_damage, max(damage_max) AS max_damage,
min(damage_min) AS min_damage, CAST(coalesce(sum(damage_count), 0) AS BIGINT) AS damage_values"""


def ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) END"


# --- groups ------------------------------------------------------------------------------------

CHECKS["action_groups"] = ctes(LOG_CTE, placed("log")) + """SELECT session_id, event_group, count(*) AS line_count,
count(*) FILTER (visible_text <> '') AS text_count, min("order") AS order_min, max("order") AS order_max,
first(visible_text ORDER BY pos) FILTER (visible_text <> '') AS first_text,
last(visible_text ORDER BY pos) FILTER (visible_text <> '') AS last_text FROM ln GROUP BY 1, 2"""

CHECKS["group_lines"] = ctes(LOG_CTE, placed("log")) + (
    'SELECT session_id, event_group, pos AS group_pos, "order" FROM ln'
)

CHECKS["ungrouped_lines"] = ctes(LOG_CTE) + (
    "SELECT count(*) FILTER (event_group IS NULL OR trim(event_group) = '') AS ungrouped_lines FROM log"
)

CHECKS["parsed_groups"] = on_actions(
    """SELECT session_id, event_group, line_count, order_min, order_max, actor, action_name, action_type, hit_status,
damage_count, damage_total, damage_max, damage_min, parsed FROM act"""
)

CHECKS["unresolved_groups"] = on_actions(
    """SELECT session_id, event_group, actor, action_name, why FROM (SELECT *, CASE WHEN NOT parsed THEN 'unparsed'
WHEN action_type = 'unknown' AND hit_status = 'unknown' THEN 'unknown_type,unknown_status'
WHEN action_type = 'unknown' THEN 'unknown_type' WHEN hit_status = 'unknown' THEN 'unknown_status' END AS why FROM act)
WHERE why IS NOT NULL"""
)

CHECKS["line_damages"] = ctes(LOG_CTE) + f"""SELECT "order", array_to_string(v, ',') AS damages FROM
(SELECT "order", list_transform(regexp_extract_all(visible_text, {pattern(fixed.DAMAGE_VALUE)}, 1), lambda x: CAST(x AS BIGINT)) AS v FROM log)
WHERE len(v) > 0"""

CHECKS["roll_totals"] = ctes(LOG_CTE) + f"""SELECT "order", CAST({extract("visible_text", fixed.ABILITY_ROLL, 3)} AS BIGINT) AS roll_total
FROM log WHERE {matches("visible_text", fixed.ABILITY_ROLL)}"""

# --- summaries ---------------------------------------------------------------------------------

SUMMARY = f"""SELECT actor, action_name, action_type, use_count, hit_count, miss_count, unknown_count, total_damage, max_damage,
min_damage, damage_values, {ratio("hit_count", "(hit_count + miss_count)")} AS hit_rate,
{ratio("total_damage", "damage_values")} AS average_damage FROM
(SELECT actor, action_name, action_type, count(*) FILTER (hit_status <> 'excluded') AS use_count,
count(*) FILTER (hit_status = 'hit') AS hit_count, count(*) FILTER (hit_status = 'miss') AS miss_count,
count(*) FILTER (hit_status = 'unknown') AS unknown_count, {stats()} FROM act WHERE parsed GROUP BY 1, 2, 3)"""

CHECKS["action_summary"] = on_actions(SUMMARY)

fmt = lambda column: f"coalesce(format('{{:,}}', CAST({column} AS BIGINT)), '-')"
fmt2 = lambda column: f"coalesce(format('{{:,.2f}}', round({column}, 2)), '-')"
TYPE_LABEL = "CASE action_type " + " ".join(
    f"WHEN {text_literal(k)} THEN {text_literal(v)}" for k, v in fixed.ACTION_TYPE_LABELS.items()
) + " END"
CHECKS["action_table"] = on_actions(f"""SELECT actor, action_name, {TYPE_LABEL} AS action_type,
{", ".join(f"{fmt(n)} AS {n}" for n in ("use_count", "hit_count", "miss_count", "unknown_count", "total_damage", "max_damage", "min_damage"))},
coalesce(format('{{:.1f}}', round(hit_rate * 100, 1)) || '%', '-') AS hit_rate, {fmt2("average_damage")} AS average_damage FROM ({SUMMARY})""")

CHECKS["damage_stats"] = on_actions(
    f"""SELECT *, {ratio("total_damage", "damage_values")} AS average_damage FROM
(SELECT action_type, {stats()} FROM act WHERE parsed GROUP BY 1)"""
)

ATTACKS = """count(*) FILTER (action_type LIKE 'normal_attack%' AND hit_status = 'hit') AS attack_hits,
count(*) FILTER (action_type LIKE 'normal_attack%' AND hit_status = 'miss') AS attack_misses,
count(*) FILTER (action_type = 'normal_attack_critical' AND hit_status = 'hit') AS attack_criticals"""
ATTACK_RATES = f"""{ratio("attack_hits", "(attack_hits + attack_misses)")} AS normal_attack_hit_rate,
{ratio("attack_criticals", "attack_hits")} AS normal_attack_critical_rate"""

CHECKS["normal_attack_rates"] = on_actions(
    f"SELECT *, {ATTACK_RATES} FROM (SELECT actor, {ATTACKS} FROM act WHERE parsed GROUP BY 1)"
)

CHECKS["actors_with_actions"] = on_actions(
    """SELECT actor, count(*) AS action_count, CAST(sum(u) AS BIGINT) AS use_count, min(action_name) AS first_action FROM
(SELECT actor, action_name, action_type, count(*) FILTER (hit_status <> 'excluded') AS u FROM act WHERE parsed GROUP BY 1, 2, 3)
GROUP BY 1"""
)

INC = f"""inl AS MATERIALIZED (SELECT session_id, event_group, "order", visible_text AS t,
bool_or(contains(visible_text, {text_literal(fixed.CHAIN_WORD)})) OVER
  (PARTITION BY session_id, event_group ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chained FROM ln),
inc AS MATERIALIZED (SELECT session_id, event_group, "order", target, damage,
CASE WHEN action_type IN ('normal_attack', 'normal_attack_critical', 'weapon_skill', 'ability') AND NOT chained
  THEN CASE WHEN damage IS NOT NULL THEN 'hit' ELSE 'miss' END ELSE 'unknown' END AS status
FROM (SELECT inl.*, CAST({extract("t", fixed.INCOMING_DAMAGE, 2)} AS BIGINT) AS damage,
trim(coalesce({extract("t", fixed.INCOMING_DAMAGE, 1)}, {extract("t", fixed.INCOMING_EVADE)}, {extract("t", fixed.INCOMING_MISS)})) AS target
FROM inl) JOIN (SELECT session_id, event_group, action_type FROM act) USING (session_id, event_group) WHERE target IS NOT NULL)"""

CHECKS["incoming_results"] = ctes(LOG_CTE, RNG, placed("rng"), GRP, ACT, INC) + "SELECT * FROM inc"

TAKEN = f"""taken AS (SELECT *, {ratio("incoming_total", "incoming_count")} AS incoming_average,
{ratio("evade_count", "(evade_count + incoming_hit_count)")} AS evasion_rate FROM
(SELECT target, CAST(coalesce(sum(damage), 0) AS BIGINT) AS incoming_total, count(damage) AS incoming_count,
max(damage) AS incoming_max, min(damage) AS incoming_min, count(*) FILTER (status = 'hit') AS incoming_hit_count,
count(*) FILTER (status = 'miss') AS evade_count FROM inc GROUP BY 1))"""

CHECKS["incoming_summary"] = ctes(LOG_CTE, RNG, placed("rng"), GRP, ACT, INC, TAKEN) + "SELECT * FROM taken"


def clock(column: str, loose: bool = False) -> str:
    """struct of seconds and precision for a time text, or NULL."""
    shape = fixed.TIME_BARE if loose else fixed.TIME_BRACKETED
    part = lambda n: f"CAST({extract(column, shape, n)} AS BIGINT)"
    return (
        f"CASE WHEN {part(1)} <= 23 AND {part(2)} <= 59 AND coalesce({part(3)}, 0) <= 59 THEN"
        f" {{'s': {part(1)} * 3600 + {part(2)} * 60 + coalesce({part(3)}, 0),"
        f" 'p': CASE WHEN {part(3)} IS NULL THEN 'minute' ELSE 'second' END}} END"
    )


BASE = "TIMESTAMP '2000-01-01 00:00:00'"
# In the derived log some line of every range has a readable time, so open ends never fall back.
OPEN_TIME = f"""open_time AS (SELECT st, CASE WHEN en < st THEN en + INTERVAL 1 DAY ELSE en END AS en FROM (SELECT
{BASE} + to_seconds(arg_min(c.s, "order")) AS st,
{BASE} + to_seconds(arg_max(c.s + CASE WHEN c.p = 'minute' THEN 59 ELSE 0 END, "order")) AS en
FROM (SELECT "order", {clock("message_time_text")} AS c FROM rng) WHERE c IS NOT NULL)),
duration AS (SELECT CAST(epoch_us(en) - epoch_us(st) AS DOUBLE) / 1e6 AS secs, st, en FROM open_time)"""

ACTORS = f"""outg AS (SELECT actor, count(*) FILTER (hit_status <> 'excluded') AS use_count,
count(*) FILTER (hit_status = 'hit') AS hit_count, count(*) FILTER (hit_status = 'miss') AS miss_count,
count(*) FILTER (hit_status = 'unknown') AS unknown_count, {stats()}, {ATTACKS} FROM act WHERE parsed GROUP BY 1),
actors AS MATERIALIZED (SELECT *, {ATTACK_RATES}, {ratio("total_damage", "secs")} AS dps, 'estimated' AS time_confidence
FROM (SELECT coalesce(actor, target) AS actor, coalesce(use_count, 0) AS use_count, coalesce(hit_count, 0) AS hit_count,
coalesce(miss_count, 0) AS miss_count, coalesce(unknown_count, 0) AS unknown_count, coalesce(total_damage, 0) AS total_damage,
max_damage, min_damage, coalesce(damage_values, 0) AS damage_values, coalesce(attack_hits, 0) AS attack_hits,
coalesce(attack_misses, 0) AS attack_misses, coalesce(attack_criticals, 0) AS attack_criticals,
coalesce(incoming_total, 0) AS incoming_total, coalesce(incoming_count, 0) AS incoming_count, incoming_max, incoming_min,
incoming_average, coalesce(incoming_hit_count, 0) AS incoming_hit_count, coalesce(evade_count, 0) AS evade_count, evasion_rate,
(SELECT secs FROM duration) AS secs FROM outg FULL JOIN taken ON actor = target))"""


def on_actors(select: str, *more: str, source: str = "rng", before: tuple[str, ...] = ()) -> str:
    return ctes(LOG_CTE, RNG, *before, placed(source), GRP, ACT, INC, TAKEN, OPEN_TIME, ACTORS, *more) + select


CHECKS["actor_summary"] = on_actors("SELECT * EXCLUDE (secs, incoming_average) FROM actors")

with_counts = lambda rate, part, whole: (
    f"coalesce(regexp_replace(format('{{:.1f}}', round({rate} * 100, 1)), '\\.0$', '') || '％', '-') || '(' || {fmt(part)} || '/' || {fmt(whole)} || ')'"
)
CHECKS["actor_table"] = on_actors(f"""SELECT actor,
{", ".join(f"{fmt(n)} AS {n}" for n in ("total_damage", "use_count", "hit_count", "miss_count", "unknown_count"))},
{fmt2("dps")} AS dps, '推定' AS time_confidence,
{with_counts("normal_attack_hit_rate", "attack_hits", "(attack_hits + attack_misses)")} AS normal_attack_hit_rate,
{with_counts("normal_attack_critical_rate", "attack_criticals", "attack_hits")} AS normal_attack_critical_rate FROM actors""")

CHECKS["point_summary"] = ctes(LOG_CTE, RNG, OPEN_TIME) + f"""SELECT n AS point_name,
CAST(coalesce(total, 0) AS BIGINT) AS total_points, CAST(coalesce(chain, 0) AS BIGINT) AS max_chain,
coalesce(total, 0) * 3600.0 / (SELECT secs FROM duration) AS points_per_hour
FROM (SELECT unnest([{", ".join(text_literal(n) for n in fixed.POINT_NAMES)}]) AS n) LEFT JOIN
(SELECT coalesce({extract("visible_text", fixed.POINT_GAIN, 3)}, {text_literal(fixed.GALLIMAUFRY)}) AS pn,
CAST(sum(CAST(coalesce({extract("visible_text", fixed.POINT_GAIN, 2)}, {extract("visible_text", fixed.GALLIMAUFRY_GAIN)}) AS BIGINT)) AS DOUBLE) AS total,
max(CAST({extract("visible_text", fixed.POINT_GAIN, 1)} AS BIGINT)) AS chain FROM rng
WHERE {matches("visible_text", fixed.POINT_GAIN)} OR {matches("visible_text", fixed.GALLIMAUFRY_GAIN)} GROUP BY 1) ON n = pn"""

# --- ranges ------------------------------------------------------------------------------------

BOUNDS = """mk AS (SELECT * FROM log WHERE is_marker),
b AS (SELECT min("order") AS lo, max("order") AS hi FROM mk)"""
MARKED = """marked AS MATERIALIZED (SELECT * FROM rng WHERE "order" > (SELECT lo FROM b) AND "order" < (SELECT hi FROM b))"""
SLICED = """sliced AS MATERIALIZED (SELECT * FROM log WHERE NOT is_marker AND "order" > (SELECT lo FROM b) AND "order" <= (SELECT hi FROM b))"""

CHECKS["markers"] = ctes(LOG_CTE) + 'SELECT session_id, "order", marker_keyword, message_time_text FROM log WHERE is_marker'
CHECKS["end_marker_candidates"] = ctes(LOG_CTE, BOUNDS) + 'SELECT "order", marker_keyword FROM mk WHERE "order" > (SELECT lo FROM b)'
CHECKS["range_between_markers"] = ctes(LOG_CTE, RNG, BOUNDS, MARKED) + 'SELECT "order", session_id, visible_text FROM marked'
CHECKS["range_order"] = ctes(LOG_CTE, RNG, BOUNDS, MARKED) + 'SELECT min("order") AS first_order, max("order") AS last_order FROM marked'
CHECKS["marked_range_summary"] = on_actions(SUMMARY, "marked", BOUNDS, MARKED)
CHECKS["live_slice_summary"] = on_actions(SUMMARY, "sliced", BOUNDS, SLICED)

CHECKS["analysis_time"] = ctes(LOG_CTE, RNG, OPEN_TIME, BOUNDS, f"""
ends AS (SELECT "order" = (SELECT lo FROM b) AS is_start, {clock("message_time_text")} AS c, first_seen_at FROM mk
WHERE "order" IN (SELECT lo FROM b UNION SELECT hi FROM b)),
pts AS (SELECT is_start, c IS NULL AS est, c.p AS p, CASE WHEN c IS NULL THEN first_seen_at
ELSE {BASE} + to_seconds(c.s + CASE WHEN NOT is_start AND c.p = 'minute' THEN 59 ELSE 0 END) END AS at FROM ends),
mt AS (SELECT s.at AS st, CASE WHEN e.at < s.at THEN e.at + INTERVAL 1 DAY ELSE e.at END AS en,
CASE WHEN s.est OR e.est THEN 'estimated' WHEN s.p = 'second' AND e.p = 'second' THEN 'exact' ELSE 'minute' END AS conf
FROM (SELECT * FROM pts WHERE is_start) s, (SELECT * FROM pts WHERE NOT is_start) e),
both_times AS (SELECT 'whole' AS r, 'estimated' AS conf, st, en FROM open_time UNION ALL SELECT 'marked', conf, st, en FROM mt)""") + """
SELECT r AS "range", conf AS confidence, CAST(epoch_us(en) - epoch_us(st) AS DOUBLE) / 1e6 AS duration_seconds,
en > st AS can_rate, strftime(st, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(en, '%Y-%m-%d %H:%M:%S') AS end_time FROM both_times"""

# --- areas -------------------------------------------------------------------------------------

AREA = f"""chg AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY "order") AS sequence,
row_number() OVER (PARTITION BY upper(area_name) ORDER BY "order") AS occurrence,
lead("order") OVER (ORDER BY "order") AS end_order
FROM (SELECT *, {extract("trim(visible_text)", fixed.AREA_CHANGE)} AS area_name FROM log) WHERE area_name IS NOT NULL),
seg AS MATERIALIZED (SELECT log.*, c.sequence AS stay FROM log ASOF JOIN chg c ON log."order" >= c."order" WHERE NOT {IS_AREA.replace("visible_text", "log.visible_text")})"""

CHECKS["area_changes"] = ctes(LOG_CTE, AREA) + 'SELECT sequence, occurrence, area_name, "order" FROM chg'
CHECKS["segment_assignment"] = ctes(LOG_CTE, AREA) + 'SELECT "order", stay FROM seg'

ELAPSED = """CASE WHEN e IS NULL OR e <= 0 THEN '-' WHEN e >= 3600 THEN (e // 3600) || '時間' || (e // 60 % 60) || '分' || (e % 60) || '秒'
WHEN e >= 60 THEN (e // 60) || '分' || (e % 60) || '秒' ELSE e || '秒' END"""
STAYS = f"""facts AS (SELECT stay, count(*) FILTER (NOT is_marker) AS line_count,
arg_min(message_time_text, "order") FILTER (NOT is_marker AND trim(message_time_text) <> '') AS first_time_text,
arg_max(message_time_text, "order") FILTER (trim(message_time_text) <> '') AS last_time_text FROM seg GROUP BY 1),
st AS MATERIALIZED (SELECT sequence AS stay, area_name, occurrence, "order" AS start_order, end_order,
coalesce(line_count, 0) AS line_count, first_time_text, last_time_text FROM chg LEFT JOIN facts ON stay = sequence)"""
second_only = lambda c: f"CASE WHEN ({clock(c, True)}).p = 'second' THEN ({clock(c, True)}).s END"
CHECKS["area_stays"] = ctes(LOG_CTE, AREA, STAYS) + f"""SELECT * EXCLUDE (e), e AS elapsed_seconds, {ELAPSED} AS elapsed_text FROM
(SELECT *, ({second_only("last_time_text")} - {second_only("first_time_text")} + 86400) % 86400 AS e FROM st)"""
CHECKS["large_stays"] = ctes(LOG_CTE, AREA, STAYS) + (
    "SELECT stay, area_name, line_count FROM st WHERE line_count >= 100 AND contains(lower(area_name), 'area')"
)
CHECKS["stay_previews"] = ctes(LOG_CTE, AREA) + """SELECT stay, line_no, "order",
CASE WHEN trim(coalesce(message_time_text, '')) = '' THEN visible_text ELSE message_time_text || ' ' || visible_text END AS line
FROM (SELECT *, row_number() OVER (PARTITION BY stay ORDER BY "order") AS line_no FROM seg WHERE NOT is_marker) WHERE line_no <= 5"""

# --- exclusions and search ---------------------------------------------------------------------


def excluded(source: str) -> str:
    return f"""xr AS MATERIALIZED (SELECT DISTINCT session_folder, session_id, canonical_record_id FROM {source}
JOIN labels ON canonical_record_id = 'r' || doc_id WHERE quality = 0),
xg AS MATERIALIZED (SELECT DISTINCT session_folder, session_id, event_group FROM {source}
JOIN labels ON event_group = 'g' || doc_id WHERE toxic = 1),
flg AS MATERIALIZED (SELECT *, record_excluded OR group_excluded AS is_excluded FROM (SELECT *,
EXISTS (SELECT 1 FROM xr WHERE xr.session_folder = l.session_folder AND xr.canonical_record_id = l.canonical_record_id) AS record_excluded,
EXISTS (SELECT 1 FROM xg WHERE xg.session_folder = l.session_folder AND xg.event_group = l.event_group) AS group_excluded
FROM {source} l))"""


CHECKS["flagged_lines"] = ctes(LOG_CTE, excluded("log")) + 'SELECT "order", record_excluded, group_excluded, is_excluded FROM flg'
CHECKS["excluded_counts"] = ctes(LOG_CTE, RNG, excluded("rng")) + """SELECT count(*) AS excluded_lines,
count(DISTINCT session_id || ':' || event_group) AS excluded_groups FROM flg WHERE is_excluded"""
CHECKS["included_summary"] = on_actors(
    "SELECT actor, total_damage, use_count, dps, incoming_total FROM actors",
    source="kept", before=(excluded("rng"), "kept AS (SELECT * FROM flg WHERE NOT is_excluded)"),
)
CHECKS["restored_groups"] = ctes(LOG_CTE, excluded("log")) + """,
back AS (SELECT DISTINCT session_folder, session_id, event_group FROM flg WHERE group_excluded AND contains(visible_text, 'Goblin'))
SELECT 'record' AS kind, session_folder, session_id, canonical_record_id AS id FROM xr WHERE (session_folder, canonical_record_id) NOT IN
(SELECT (session_folder, canonical_record_id) FROM log JOIN back USING (session_folder, session_id, event_group))
UNION ALL SELECT 'group', session_folder, session_id, event_group FROM xg
WHERE (session_folder, session_id, event_group) NOT IN (SELECT (session_folder, session_id, event_group) FROM back)"""
CHECKS["excluded_rows_added"] = ctes(LOG_CTE, excluded("log")) + """SELECT 'record' AS kind, session_folder, session_id,
canonical_record_id AS id FROM xr UNION
SELECT 'record', session_folder, session_id, canonical_record_id FROM flg WHERE NOT group_excluded AND contains(visible_text, 'ミス')
UNION ALL SELECT 'group', session_folder, session_id, event_group FROM xg"""

HITS = "hits AS (SELECT * FROM log WHERE contains(lower(visible_text), 'goblin'))"
CHECKS["log_search"] = ctes(LOG_CTE, HITS) + 'SELECT "order", visible_text FROM hits'
CHECKS["log_search_groups"] = ctes(LOG_CTE, HITS) + """SELECT "order", visible_text FROM log WHERE contains(lower(visible_text), 'goblin')
OR (session_id, event_group) IN (SELECT (session_id, event_group) FROM hits WHERE event_group IS NOT NULL)"""
CHECKS["log_search_excluded"] = ctes(LOG_CTE, HITS, excluded("log")) + """SELECT "order", visible_text FROM flg WHERE is_excluded AND
(contains(lower(visible_text), 'goblin')
OR (session_id, event_group) IN (SELECT (session_id, event_group) FROM hits WHERE event_group IS NOT NULL))"""
CHECKS["conversation_search"] = """SELECT 'conversations' AS session_id, CAST(conv_id AS VARCHAR) AS event_group, turn AS "order"
FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE contains(upper(text), 'LA'))"""
CHECKS["conversation_groups"] = """SELECT 'conversations' AS session_id, CAST(conv_id AS VARCHAR) AS event_group, count(*) AS line_count,
count(*) FILTER (text <> '') AS text_count, min(turn) AS order_min, max(turn) AS order_max,
arg_min(text, turn) FILTER (text <> '') AS first_text, arg_max(text, turn) FILTER (text <> '') AS last_text
FROM conversations GROUP BY conv_id"""
POSITIONED = """p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_folder ORDER BY "order") AS position FROM log)"""
CHECKS["context_rows"] = ctes(LOG_CTE, POSITIONED) + """SELECT p.session_folder, h.position AS hit_position, p.position,
p.position - h.position AS "offset", p."order" FROM p JOIN p h ON h.is_marker AND p.session_folder = h.session_folder
AND p.position BETWEEN h.position - 10 AND h.position + 10"""
CHECKS["neighbour_hits"] = ctes(LOG_CTE) + """SELECT "order", n AS hit_no, CASE WHEN n = 1 THEN c ELSE n - 1 END AS previous_hit,
CASE WHEN n = c THEN 1 ELSE n + 1 END AS next_hit FROM
(SELECT "order", row_number() OVER (ORDER BY "order") AS n, count(*) OVER () AS c FROM log WHERE is_marker)"""

# --- actors ------------------------------------------------------------------------------------

REGISTERED = [f"{c}{d}ara" for c in "ABCD" for d in "abcdefghij"]
NPC = "'GOBLIN', 'ORC GRUNT', " + ", ".join(text_literal(n.upper()) for n in REGISTERED[:7])
PC = ", ".join(text_literal(n.upper()) for n in REGISTERED[7:])
KIND = f"""CASE WHEN upper(actor) IN ({NPC}) THEN 'registered_npc' WHEN upper(actor) IN ({PC}) THEN 'registered_pc'
WHEN regexp_matches(actor, '^[A-Za-z]{{1,15}}$') THEN 'pc_candidate' ELSE 'unknown' END"""
KINDS = f"kinds AS MATERIALIZED (SELECT *, {KIND} AS kind FROM actors)"

CHECKS["actor_kinds"] = on_actors("SELECT actor, kind FROM kinds", KINDS)
CHECKS["visible_actor_summary"] = on_actors(
    "SELECT actor, kind, total_damage FROM kinds WHERE kind IN ('registered_pc', 'pc_candidate')", KINDS
)
CHECKS["filtered_actors"] = on_actors(
    "SELECT actor, kind FROM kinds WHERE kind IN ('registered_npc', 'pc_candidate') AND contains(lower(actor), 'ara')", KINDS
)
CHECKS["party_candidates"] = on_actors(
    """SELECT min(actor) AS actor, CAST(sum(use_count) AS BIGINT) AS use_count FROM kinds
WHERE kind IN ('registered_pc', 'pc_candidate') GROUP BY upper(actor)""", KINDS
)

_first_spelling: dict[str, str] = {}
for _member in MEMBERS:
    _first_spelling.setdefault(_member.upper(), _member)
_roster = list(_first_spelling.values())[:6]
PARTY = f"""ros AS (SELECT unnest([{", ".join(str(i + 1) for i in range(len(_roster)))}]) AS roster_pos,
unnest([{", ".join(text_literal(m) for m in _roster)}]) AS name),
pm AS MATERIALIZED (SELECT roster_pos, name, actor, dps, normal_attack_hit_rate, attack_hits, attack_misses FROM ros
LEFT JOIN actors ON upper(actor) = upper(name))"""
CHECKS["party_metrics"] = on_actors(
    """SELECT roster_pos, name, actor, dps, normal_attack_hit_rate, CASE WHEN m > 0 THEN coalesce(dps, 0) / m ELSE 0 END AS dps_share
FROM (SELECT *, max(coalesce(dps, 0)) OVER () AS m FROM pm)""", PARTY
)
CHECKS["party_totals"] = on_actors(
    f"""SELECT round(sum(dps), 9) AS total_dps, {ratio("sum(attack_hits)", "sum(attack_hits + attack_misses)")} AS total_hit_rate FROM pm""", PARTY
)

# --- timeline ----------------------------------------------------------------------------------

ONE = "one AS MATERIALIZED (SELECT *, CASE WHEN visible_text <> '' THEN [visible_text] ELSE [] END AS texts FROM ln)"
DECL = classified(
    "one", "dec0", 'session_id, event_group, "order", read_index, visible_text, pos, texts, excl, eff, missed'
) + """,
dec AS MATERIALIZED (SELECT *, action_type IN ('weapon_skill', 'ability', 'magic')
AND trim(coalesce(actor, '')) <> '' AND trim(coalesce(action_name, '')) <> '' AS declares FROM dec0)"""
T = "visible_text"
CHAINED = f"""tl AS MATERIALIZED (SELECT *, coalesce(last_value(CASE WHEN contains({T}, {text_literal(fixed.CHAIN_WORD)}) THEN true
WHEN declares AND NOT is_start THEN false END IGNORE NULLS) OVER (PARTITION BY session_id, event_group ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS in_chain,
{extract(T, fixed.TIMELINE_DAMAGE, 1)} AS rt, CAST({extract(T, fixed.TIMELINE_DAMAGE, 2)} AS BIGINT) AS rd,
CASE WHEN {matches(T, fixed.TIMELINE_RECOVERY)} THEN 'hp_recovery' WHEN {matches(T, fixed.TIMELINE_ABSORB)} THEN
  CASE WHEN {extract(T, fixed.TIMELINE_ABSORB, 3)} = 'TP' THEN 'tp_absorb' ELSE 'mp_absorb' END END AS kind,
coalesce({extract(T, fixed.TIMELINE_RECOVERY, 1)}, {extract(T, fixed.TIMELINE_ABSORB, 1)}) AS kt,
CAST(coalesce({extract(T, fixed.TIMELINE_RECOVERY, 2)}, {extract(T, fixed.TIMELINE_ABSORB, 2)}) AS BIGINT) AS ka,
CAST({extract(T, fixed.ABILITY_ROLL, 3)} AS BIGINT) AS roll, CAST({extract(T, fixed.DOUBLE_UP_RESULT)} AS BIGINT) AS dbl
FROM dec)"""
TGRP = f"""tg AS MATERIALIZED (SELECT session_id, event_group, min("order") AS order_min,
count(DISTINCT actor || '|' || action_name) FILTER (declares) > 1 OR bool_or(action_type LIKE 'normal_attack%') AS ambiguous,
arg_min({{'a': actor, 'n': action_name, 't': action_type, 'o': "order"}}, pos) FILTER (declares) AS d,
arg_min({{'a': actor, 'n': action_name, 't': action_type, 'o': "order"}}, pos) FILTER (declares AND NOT is_start) AS x,
arg_min("order", pos) FILTER (contains({T}, {text_literal(fixed.INTERRUPT_ANCHOR_WORD)})) AS io,
bool_or({has_word(T, fixed.INTERRUPT_PHRASES)}) AS stopped, bool_or({has_word(T, fixed.FAILURE_WORDS)}) AS failed,
bool_or(excl) AS ex, bool_or(eff) AS ef, bool_or(missed) AS mi,
count(rd) FILTER (NOT in_chain) AS rc, sum(rd) FILTER (NOT in_chain) AS dmg,
sum(ka) FILTER (NOT in_chain AND kind = 'hp_recovery') AS hp, sum(ka) FILTER (NOT in_chain AND kind = 'tp_absorb') AS tp,
sum(ka) FILTER (NOT in_chain AND kind = 'mp_absorb') AS mp, count(ka) FILTER (NOT in_chain) AS kc,
list(DISTINCT roll) FILTER (NOT in_chain AND roll IS NOT NULL) AS rolls
FROM tl GROUP BY 1, 2 HAVING bool_or(declares))"""
TEV = """ev0 AS MATERIALIZED (SELECT session_id, event_group, order_min, CASE WHEN x IS NOT NULL THEN x.o ELSE io END AS "order",
coalesce(x, d).a AS actor, coalesce(x, d).n AS action_name, coalesce(x, d).t AS action_type,
CASE WHEN stopped AND x IS NULL THEN 'interrupted' WHEN failed THEN 'failed' WHEN x IS NOT NULL AND rc > 0 THEN 'damage_confirmed'
  WHEN ex THEN 'unconfirmed' WHEN ef THEN 'effect_confirmed' WHEN mi THEN 'missed' ELSE 'unconfirmed' END AS status,
x IS NOT NULL AS is_executed, CASE WHEN x IS NOT NULL THEN CAST(dmg AS BIGINT) END AS damage,
CASE WHEN x IS NOT NULL THEN rc ELSE 0 END AS result_count, CASE WHEN x IS NOT NULL THEN CAST(hp AS BIGINT) END AS hp_recovery,
CASE WHEN x IS NOT NULL THEN CAST(tp AS BIGINT) END AS tp_absorb, CASE WHEN x IS NOT NULL THEN CAST(mp AS BIGINT) END AS mp_absorb,
CASE WHEN x IS NOT NULL THEN kc ELSE 0 END AS resource_count,
CASE WHEN x.t = 'ability' AND len(rolls) = 1 THEN rolls[1] END AS roll_total
FROM tg WHERE NOT ambiguous AND (x IS NOT NULL OR stopped)),
tm AS (SELECT session_id, "order" AS reference_order, message_time_text AS reference_time FROM rng WHERE trim(message_time_text) <> ''),
ev AS MATERIALIZED (SELECT e.*, tm.reference_time, tm.reference_order FROM ev0 e ASOF LEFT JOIN tm
ON e.session_id = tm.session_id AND e."order" >= tm.reference_order)"""
NUMBERED = """evn AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY "order" NULLS LAST, order_min NULLS LAST, session_id || ':' || event_group) AS event_no FROM ev)"""


def on_timeline(select: str, *more: str) -> str:
    return ctes(LOG_CTE, RNG, placed("rng"), ONE, DECL, CHAINED, TGRP, TEV, NUMBERED, *more) + select


CHECKS["line_declarations"] = ctes(LOG_CTE, RNG, placed("rng"), ONE, DECL) + """SELECT "order",
CASE WHEN declares THEN action_type END AS declared_type, CASE WHEN declares THEN actor END AS declared_actor,
CASE WHEN declares THEN action_name END AS declared_action, is_start FROM dec"""
CHECKS["timeline_events"] = on_timeline("SELECT * EXCLUDE (order_min) FROM ev")
CHECKS["numbered_timeline"] = on_timeline("SELECT event_no, session_id, event_group FROM evn")
# Packing walks from row to row; a row's size depends on the next two events.
WALK = """sz AS MATERIALIZED (SELECT event_no, CASE WHEN two AND three THEN 3 WHEN two THEN 2 ELSE 1 END AS size FROM (SELECT event_no,
coalesce(lead(session_id) OVER w = session_id AND lead(reference_time) OVER w IS NOT DISTINCT FROM reference_time
AND lead(actor) OVER w <> actor, FALSE) AS two,
coalesce(lead(session_id, 2) OVER w = session_id AND lead(reference_time, 2) OVER w IS NOT DISTINCT FROM reference_time
AND lead(actor, 2) OVER w <> actor AND lead(actor, 2) OVER w <> lead(actor) OVER w, FALSE) AS three
FROM evn WINDOW w AS (ORDER BY event_no))),
walk AS (SELECT event_no AS pos, CAST(1 AS BIGINT) AS row_no, size FROM sz WHERE event_no = 1
UNION ALL SELECT sz.event_no, row_no + 1, sz.size FROM walk JOIN sz ON sz.event_no = walk.pos + walk.size)"""


def on_layout(select: str) -> str:
    return on_timeline(select, WALK).replace("WITH ", "WITH RECURSIVE ", 1)


CHECKS["layout_rows"] = on_layout(
    "SELECT pos + k AS event_no, row_no, k + 1 AS row_place FROM (SELECT pos, row_no, unnest(range(size)) AS k FROM walk)"
)
CHECKS["layout_changes"] = on_layout("""SELECT row_no, first_event, last_event, session_id, reference_time, new_session AS show_session,
reference_time IS NOT NULL AND (new_session OR reference_time IS DISTINCT FROM lag(reference_time) OVER (ORDER BY row_no)) AS show_time
FROM (SELECT row_no, pos AS first_event, pos + size - 1 AS last_event, session_id, reference_time,
session_id IS DISTINCT FROM lag(session_id) OVER (ORDER BY row_no) AS new_session FROM walk JOIN evn ON evn.event_no = walk.pos)""")
RESULTS = """res AS MATERIALIZED (SELECT session_id, event_group, "order" AS line_order, 'damage' AS kind, rt AS target, rd AS amount FROM tl
WHERE rd IS NOT NULL AND NOT in_chain UNION ALL SELECT session_id, event_group, "order", kind, kt, ka FROM tl WHERE ka IS NOT NULL AND NOT in_chain),
shown AS (SELECT res.* FROM res SEMI JOIN (SELECT * FROM ev WHERE is_executed) USING (session_id, event_group))"""
CHECKS["timeline_results"] = on_timeline("SELECT * FROM shown", RESULTS)
CHECKS["resource_totals"] = on_timeline(
    """SELECT session_id, event_group, kind, CAST(sum(amount) AS BIGINT) AS amount FROM shown WHERE kind <> 'damage' GROUP BY 1, 2, 3""",
    RESULTS,
)
CHECKS["timeline_warnings"] = on_timeline(
    """SELECT 'ambiguous_group' AS code, session_id || ':' || event_group AS subject, CAST(1 AS BIGINT) AS lines FROM tg WHERE ambiguous
UNION ALL SELECT 'lines_without_group', '', n FROM (SELECT count(*) AS n FROM rng WHERE event_group IS NULL OR trim(event_group) = '') WHERE n > 0"""
)
CHECKS["event_source_lines"] = on_timeline(
    'SELECT event_no, ln."order", visible_text FROM ln JOIN evn USING (session_id, event_group)'
)
CHECKS["reference_time_asof"] = ctes(LOG_CTE) + """SELECT m.session_id, m."order", t.message_time_text AS reference_time, t."order" AS reference_order
FROM (SELECT * FROM log WHERE is_marker) m ASOF LEFT JOIN (SELECT * FROM log WHERE trim(message_time_text) <> '') t
ON m.session_id = t.session_id AND m."order" >= t."order" """
CHECKS["action_report"] = on_timeline(
    f"""SELECT *, {ratio("damage_sum", "confirmed")} AS damage_average FROM (SELECT actor, action_name, action_type,
count(*) FILTER (is_executed) AS executed, count(*) FILTER (NOT is_executed) AS interrupted, count(damage) AS confirmed,
CAST(sum(damage) AS BIGINT) AS damage_sum, max(damage) AS damage_max, min(damage) AS damage_min FROM ev GROUP BY 1, 2, 3)"""
)
CHECKS["member_report"] = on_timeline(
    f"""SELECT k.actor, timeline_damage, {ratio("h", "(h + m)")} AS attack_hit_rate, coalesce(weapon_skill_count, 0) AS weapon_skill_count,
{ratio("ws_total", "ws_n")} AS weapon_skill_average, weapon_skill_max, weapon_skill_min, incoming_total, incoming_max, incoming_min,
incoming_average, evasion_rate FROM (SELECT kinds.*, attack_hits + coalesce(wh, 0) AS h, attack_misses + coalesce(wm, 0) AS m FROM kinds
LEFT JOIN (SELECT actor AS wa, count(*) FILTER (hit_status = 'hit') AS wh, count(*) FILTER (hit_status = 'miss') AS wm FROM act
WHERE parsed AND action_type = 'weapon_skill' GROUP BY 1) ON wa = actor WHERE kind IN ('registered_pc', 'pc_candidate')) k
LEFT JOIN (SELECT actor, CAST(sum(damage) AS BIGINT) AS timeline_damage, count(*) FILTER (ws) AS weapon_skill_count,
count(damage) FILTER (ws) AS ws_n, sum(damage) FILTER (ws) AS ws_total, max(damage) FILTER (ws) AS weapon_skill_max,
min(damage) FILTER (ws) AS weapon_skill_min FROM (SELECT *, action_type = 'weapon_skill' AND is_executed AS ws FROM ev) GROUP BY 1) e
ON e.actor = k.actor""",
    GRP, ACT, INC, TAKEN, OPEN_TIME, ACTORS, KINDS,
)
CANDIDATES = f"""names AS (SELECT actor FROM act WHERE parsed UNION SELECT actor FROM ev),
cand AS (SELECT actor, kind FROM (SELECT actor, {KIND} AS kind FROM names) WHERE kind IN ('registered_pc', 'pc_candidate'))"""
CHECKS["timeline_candidates"] = on_timeline("SELECT actor, kind FROM cand", GRP, ACT, CANDIDATES)
CHECKS["kept_members"] = on_timeline(
    f"SELECT actor FROM cand WHERE upper(actor) IN ({NPC}, {PC})", GRP, ACT, CANDIDATES
)

# --- sessions and collection -------------------------------------------------------------------

CHECKS["session_rollups"] = ctes(LOG_CTE, RAW_CTE) + """SELECT count(DISTINCT session_id) AS session_count,
strftime(min(first_seen_at), '%Y-%m-%d %H:%M:%S') AS earliest_start, strftime(max(last_seen_at), '%Y-%m-%d %H:%M:%S') AS latest_end,
count(*) AS line_count, count(*) FILTER (is_marker) AS marker_count, CAST(0 AS BIGINT) AS gap_warnings,
(SELECT count(*) FROM raw WHERE parse_status = 'error') AS parse_errors, CAST(0 AS BIGINT) AS decode_errors FROM log"""
CHECKS["session_labels"] = ctes(LOG_CTE) + """SELECT session_id, alias || '（' || session_id || '）' AS label FROM
(SELECT session_id, coalesce(arg_min(marker_keyword, "order") FILTER (is_marker), '') AS alias FROM log GROUP BY 1)
WHERE contains(upper(alias), 'LAP1') OR contains(upper(session_id), 'LAP1')"""
CHECKS["stored_action_summary"] = CHECKS["action_summary"]
CHECKS["stored_sessions"] = ctes(LOG_CTE, RAW_CTE) + """SELECT session_id, coalesce(alias || '（' || session_id || '）', session_id) AS label,
CASE WHEN ends_with(session_id, '5') THEN 'active' ELSE 'completed' END AS status, ends_with(session_id, '5') AS unfinished,
coalesce(parse_errors, 0) AS parse_errors, canonical_record_id, event_group, strftime(ended, '%Y-%m-%d %H:%M:%S.%f') AS ended_at
FROM (SELECT session_id, arg_min(marker_keyword, "order") FILTER (is_marker) AS alias, max(last_seen_at) AS ended,
max(event_group) AS event_group, max(canonical_record_id) FILTER (event_group IS NOT NULL) AS canonical_record_id FROM log GROUP BY 1)
LEFT JOIN (SELECT session_id, count(*) FILTER (parse_status = 'error') AS parse_errors FROM raw GROUP BY 1) USING (session_id)"""
CHECKS["combined_order"] = ctes(LOG_CTE) + """SELECT row_number() OVER (ORDER BY first_seen_at, session_id, "order") AS "order",
session_id, "order" AS session_order FROM log"""

ARRIVED = "file_mtime, source_file, record_index"
DEDUPED = f"""ddr AS MATERIALIZED (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY session_id, raw_record_id ORDER BY {ARRIVED}) = 1)"""
CHECKS["raw_dedupe"] = ctes(LOG_CTE, RAW_CTE, DEDUPED) + (
    "SELECT session_id, raw_record_id, source_file, record_index, sequence_hint FROM ddr"
)


def fold(sign: str) -> str:
    wins = f"CASE WHEN try_cast(x AS BIGINT) IS NOT NULL AND try_cast(y AS BIGINT) IS NOT NULL THEN try_cast(y AS BIGINT) {sign} try_cast(x AS BIGINT) ELSE y {sign} x END"
    return f"CASE WHEN len(hints) > 0 THEN list_reduce(hints, lambda x, y: CASE WHEN {wins} THEN y ELSE x END) END"


CANON = f"""can0 AS MATERIALIZED (SELECT session_id, canonical_key,
arg_min({{'g': event_group, 't': visible_text, 'm': is_marker, 'f': first_seen_at, 's': file_mtime, 'n': source_file, 'i': record_index}}, seq) AS f,
coalesce(list(sequence_hint ORDER BY seq) FILTER (sequence_hint IS NOT NULL), []) AS hints, count(*) AS record_count,
array_to_string(list_sort(list(DISTINCT window_id)), ',') AS windows, array_to_string(list_sort(list(DISTINCT source_file)), ',') AS files,
max(first_seen_at) AS seen FROM (SELECT *, sha1(coalesce(event_group, '') || visible_text) AS canonical_key,
row_number() OVER (ORDER BY {ARRIVED}) AS seq FROM ddr WHERE parse_status = 'success') GROUP BY 1, 2)"""
CHECKS["canonicalize"] = ctes(LOG_CTE, RAW_CTE, DEDUPED, CANON) + f"""SELECT session_id, canonical_key, f.g AS event_group, f.t AS visible_text,
{fold("<")} AS sequence_hint_min, {fold(">")} AS sequence_hint_max, record_count, windows, files, f.m AS is_marker,
strftime(f.f, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM can0"""
CHECKS["canonicalize_in_batches"] = ctes(LOG_CTE, RAW_CTE, DEDUPED, CANON) + f"""SELECT session_id, canonical_key, f.t AS visible_text,
{fold("<")} AS sequence_hint_min, {fold(">")} AS sequence_hint_max, record_count, row_number() OVER (PARTITION BY session_id ORDER BY f.s, f.n, f.i, canonical_key) AS "order" FROM can0"""
CHECKS["numbered_names_order"] = """SELECT p_partkey, concat_ws('-', p_type, lpad(CAST(p_size AS VARCHAR), 4, '0'), CAST(p_partkey AS VARCHAR)) AS name,
row_number() OVER (ORDER BY p_type, p_size, p_partkey) AS place FROM part"""
CHECKS["new_records_in_batches"] = ctes(LOG_CTE, RAW_CTE) + """SELECT session_id, raw_record_id,
CAST(min(least(floor((floor(epoch(first_seen_at)) - epoch(CAST(substr(session_id, 2, 10) AS TIMESTAMP))) / 17280), 4)) AS BIGINT) AS batch
FROM raw GROUP BY 1, 2"""
CHECKS["log_fingerprint"] = ctes(LOG_CTE) + """SELECT count(*) AS lines, max("order") AS last_order, """ + ", ".join(
    f"CAST(sum(CAST('0x' || substr(d, {6 * n + 1}, 6) AS BIGINT)) AS BIGINT) AS hash{n + 1}" for n in range(4)
) + """ FROM (SELECT "order", sha1(concat_ws(chr(31), session_id, CAST("order" AS VARCHAR), strftime(last_seen_at, '%Y-%m-%d %H:%M:%S.%f'),
coalesce(CAST(sequence_hint_min AS VARCHAR), chr(30)), chr(30), visible_text)) AS d FROM log)"""
CHECKS["canonical_order"] = ctes(LOG_CTE, RAW_CTE, DEDUPED, CANON) + """SELECT session_id, canonical_key,
row_number() OVER (PARTITION BY session_id ORDER BY f.s, f.n, f.i, canonical_key) AS "order" FROM can0"""
CHECKS["canonical_sources"] = ctes(LOG_CTE, RAW_CTE, DEDUPED) + """SELECT DISTINCT session_id,
sha1(coalesce(event_group, '') || visible_text) AS canonical_key, raw_record_id FROM ddr WHERE parse_status = 'success'"""
CHECKS["collection_counters"] = ctes(LOG_CTE, RAW_CTE, DEDUPED, CANON) + """SELECT (SELECT count(*) FROM ddr) AS raw_records_written,
(SELECT count(*) FROM can0) AS canonical_records_written, (SELECT count(*) FROM raw) - (SELECT count(*) FROM ddr) AS duplicate_raw_records_skipped,
(SELECT count(*) FROM ddr WHERE parse_status = 'success') - (SELECT count(*) FROM can0) AS duplicate_canonical_records_skipped,
CAST(0 AS BIGINT) AS baseline_records_skipped, (SELECT count(*) FROM raw WHERE parse_status = 'error') AS parse_errors,
CAST(0 AS BIGINT) AS decode_errors, CAST(0 AS BIGINT) AS gap_warnings,
(SELECT strftime(max(first_seen_at), '%Y-%m-%d %H:%M:%S') FROM raw WHERE parse_status = 'success') AS last_seen_at"""
CHECKS["baseline_dropped"] = ctes(LOG_CTE, RAW_CTE) + """SELECT session_id, count(*) AS records FROM raw
WHERE session_id <> (SELECT min(session_id) FROM raw) AND visible_text NOT IN
(SELECT visible_text FROM raw WHERE session_id = (SELECT min(session_id) FROM raw)) GROUP BY 1"""


def tidy(column: str) -> str:
    return f"trim(regexp_replace({column}, {text_literal(fixed.SPACE + '+')}, ' ', 'g'))"


def time_list(column: str) -> str:
    part = lambda n: f"coalesce(try_cast(split_part(x, ':', {n}) AS INT), 0)"
    found = f"regexp_extract_all({column}, {pattern(fixed.TIME_ANYWHERE)}, 1)"
    return f"list_filter({found}, lambda x: {part(1)} <= 23 AND {part(2)} <= 59 AND {part(3)} <= 59)[1]"


MARKER = r"'###[\s\x{3000}]*([A-Za-z0-9_\-:.]+|[^\s\x{3000}]+)'"
CHECKS["snapshot_records"] = ctes(LOG_CTE) + f"""SELECT coalesce(event_group, '') AS event_group,
coalesce(CAST(sequence_hint_min AS VARCHAR), '') AS sequence_hint, t AS visible_text, contains(t, '###') AS is_marker,
nullif(regexp_extract(t, {MARKER}, 1), '') AS marker_keyword, 'success' AS parse_status, '80ff00aa' AS color_code,
{time_list("t")} AS message_time_text FROM (SELECT *, {tidy("visible_text")} AS t FROM log)"""

# Whatever a file was overwritten with, all that it ever held has been read once.
CHECKS["rewritten_snapshots"] = ctes(LOG_CTE) + f"""SELECT CAST(1 + (read_index // 40) % 2 AS INTEGER) AS window_id,
CAST((read_index // 40) % 20 AS INTEGER) AS rotation_index,
CAST(row_number() OVER (PARTITION BY read_index // 40 ORDER BY read_index) - 1 AS INTEGER) AS record_index,
coalesce(event_group, '') AS event_group, coalesce(CAST(sequence_hint_min AS VARCHAR), '') AS sequence_hint,
{tidy("visible_text")} AS visible_text FROM log"""

# --- flat view ---------------------------------------------------------------------------------

FLAT = f"""flat AS MATERIALIZED (SELECT *, event_id % 10 = 7 AS bad, CASE event_id % 3 WHEN 0 THEN '80ff00aa' WHEN 1 THEN '00aaff' ELSE 'none' END AS color
FROM (SELECT *, {JSON_LINE} AS line FROM events))"""
ok = lambda expression: f"CASE WHEN bad THEN '' ELSE {expression} END"
CHECKS["flat_records"] = ctes(FLAT) + f"""SELECT CAST(event_id + 1 AS VARCHAR) AS line_number, {ok("'s' || event_id")} AS session_id,
{ok("CAST(1 + event_id % 2 AS VARCHAR)")} AS window_id, {ok("'m1'")} AS meta1, {ok("event_type")} AS meta2, '' AS meta3,
{ok("color")} AS color_code, {ok("'あ ' || event_type")} AS visible_text, {ok("replace(props, ' ', '')")} AS props,
CASE WHEN bad THEN 'error' ELSE '' END AS parse_status, CASE WHEN bad THEN line ELSE '' END AS raw_line FROM flat"""
CHECKS["flat_filter"] = ctes(FLAT) + """SELECT 's' || event_id AS session_id, event_type AS meta2 FROM flat
WHERE NOT bad AND contains(event_type, 'cli') AND event_id % 2 = 0 AND contains(color, 'ff')"""
CHECKS["replay_lines"] = ctes(FLAT) + """SELECT CAST(event_id AS VARCHAR) AS record_index, 'あ ' || event_type AS text,
CASE color WHEN '80ff00aa' THEN '#ff00aa' WHEN '00aaff' THEN '#00aaff' ELSE 'inherit' END AS color FROM flat WHERE NOT bad AND event_id % 2 = 0"""
CHECKS["flat_page"] = ctes(FLAT) + f"""SELECT event_id + 1 AS line_number, {ok("'s' || event_id")} AS session_id FROM flat
ORDER BY event_id LIMIT 100 OFFSET 200"""

# --- scalar functions --------------------------------------------------------------------------

CHECKS["normalized_documents"] = f"SELECT doc_id, {tidy('text')} AS text FROM documents"
CHECKS["document_keys"] = f"""SELECT sha1(coalesce(lang, '') || {tidy('text')}) AS key, count(*) AS copies, min(doc_id) AS first_doc
FROM documents GROUP BY 1"""
CHECKS["extracted_times"] = ctes(LOG_CTE) + f"""SELECT "order", t AS time_text, CASE WHEN len(split(t, ':')) = 3 THEN 'second' ELSE 'minute' END AS time_precision
FROM (SELECT "order", {time_list("visible_text")} AS t FROM log) WHERE t IS NOT NULL"""
CHECKS["parsed_times"] = ctes(LOG_CTE) + f"""SELECT "order", c.s AS seconds, c.p AS time_precision, e AS loose_seconds, {ELAPSED} AS elapsed FROM
(SELECT "order", {clock("message_time_text")} AS c, ({clock("message_time_text", True)}).s AS e FROM log)"""
CHECKS["detected_markers"] = ctes(LOG_CTE) + f"""SELECT "order", nullif(regexp_extract(visible_text, {MARKER}, 1), '') AS keyword,
{extract("trim(visible_text)", fixed.AREA_CHANGE)} AS area FROM log WHERE contains(visible_text, '###') OR {IS_AREA}"""
CHECKS["document_markers"] = f"""SELECT doc_id, nullif(regexp_extract(text, {MARKER.replace("###", "icense")}, 1), '') AS keyword
FROM documents WHERE regexp_matches(text, {MARKER.replace("###", "icense")})"""
NUMBER = "CASE WHEN regexp_matches(h, '^[+-]?[0-9]+$') THEN try_cast(h AS BIGINT) END"
HEX = "CASE WHEN regexp_matches(h, '^[0-9A-Fa-f]{1,15}$') THEN CAST('0x' || h AS BIGINT) END"
META = f"nullif(CASE WHEN regexp_matches(h, '[a-fA-F]') OR len(h) <= 8 THEN {HEX} ELSE {NUMBER} END, 0)"
CHECKS["coerced_numbers"] = ctes(LOG_CTE, RAW_CTE) + f"""SELECT h AS sequence_hint, records, coalesce({NUMBER}, {HEX}) AS flexible,
{NUMBER} AS decimal_only, {META} AS meta_number,
CASE WHEN coalesce({NUMBER}, {HEX}) >= 500 THEN coalesce({NUMBER}, {HEX}) - 500 END AS effective
FROM (SELECT sequence_hint AS h, count(*) AS records FROM raw GROUP BY 1)"""
CHECKS["normalized_names"] = """SELECT c_custkey, upper(substr(trim(c_name), 1, 1)) || lower(substr(trim(c_name), 2)) AS name FROM customer"""
ALIAS = r"""CASE WHEN regexp_matches(text, '[\x00-\x1f\x7f-\x9f\x{2028}\x{2029}]') THEN 'control_character' WHEN length(trim(text)) > 100 THEN 'too_long' END"""
CHECKS["document_aliases"] = f"""SELECT doc_id, {ALIAS} AS problem, CASE WHEN {ALIAS} IS NULL THEN trim(text) END AS alias FROM documents"""
