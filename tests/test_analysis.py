"""Groups, classification, summaries, time, points: small cases with known answers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from loomlog.functions import fixed_values as fixed
from loomlog.operators import grouping, incoming, parsing, ranges, summaries
from loomlog.operators.rules import RuleSet
from loomlog.plans.analysis import analyze, analyze_slice, party_view

RULES = RuleSet(weapon_skills=("レッドロータス",))

SAMPLE = [
    (None, "#start", "[21:35:10]", True),
    ("eg-001", "Xitraの攻撃。", "[21:35:11]", False),
    ("eg-001", "→Gurfurlur the Menacingに、123ダメージ。", "[21:35:11]", False),
    ("eg-002", "Xitraの攻撃。クリティカル！", "[21:35:12]", False),
    ("eg-002", "→Gurfurlur the Menacingに、573ダメージ。", "[21:35:12]", False),
    ("eg-003", "Xitraの攻撃。", "[21:35:13]", False),
    ("eg-003", "→Gurfurlur the Menacingに、0ダメージ。", "[21:35:13]", False),
    ("eg-004", "Xitraの攻撃。ミス。", "[21:35]", False),
    ("eg-005", "Boroの攻撃→Gurfurlur the Menacingに、200ダメージ。", "[21:35:15]", False),
    ("eg-006", "Xitraは、レッドロータスを実行。", "[21:35:16]", False),
    ("eg-006", "→亀に、321ダメージ。Gurfurlur the Menacingに、100ダメージ。", "[21:35:16]", False),
    ("eg-007", "Xitraの攻撃。", "[21:35:17]", False),
    ("eg-008", "誰が何をしたかわからないログ。", "[21:35:18]", False),
    (None, "#end", "[21:35:40]", True),
]


@pytest.fixture(scope="module")
def sample(make_log):
    return make_log(*[
        {
            "event_group": g, "visible_text": x, "message_time_text": c, "is_marker": m,
            "marker_keyword": x if m else None, "first_seen_at": datetime(2026, 6, 23, 12, 35, 10 + i),
        }
        for i, (g, x, c, m) in enumerate(SAMPLE)
    ])


@pytest.fixture(scope="module")
def marked(sample):
    first, last = ranges.order_lines(ranges.markers(sample)).collect()
    ends = [ranges.Endpoint.marker(m.order, m.marker_keyword, m.message_time_text) for m in (first, last)]
    return ranges.Selection(*ends)


def test_sample_session(sample, marked):
    result = analyze(sample, marked, rules=RULES)
    assert result.range_lines.count() == 12
    time = result.time.first()
    assert (time.confidence, time.duration_seconds, time.warnings) == ("exact", 30.0, [])
    assert result.actions.count() == 8 and result.unparsed.count() == 1
    assert parsing.unresolved(result.actions).filter("parsed").count() == 1
    actors = {r.actor: r for r in result.actor_summary.collect()}
    assert set(actors) == {"Xitra", "Boro", "Gurfurlur the Menacing"}
    xitra = actors["Xitra"]
    assert (xitra.total_damage, xitra.use_count, xitra.hit_count, xitra.miss_count, xitra.unknown_count) == (1117, 6, 4, 1, 1)
    assert xitra.dps == pytest.approx(37.233333333333334)
    assert (xitra.normal_attack_hit_rate, xitra.normal_attack_critical_rate) == (0.75, pytest.approx(1 / 3))
    assert actors["Boro"].total_damage == 200 and actors["Boro"].dps == pytest.approx(6.666666666666667)
    actions = {(r.actor, r.action_type): r for r in result.action_summary.collect()}
    attack = actions["Xitra", "normal_attack"]
    assert (attack.use_count, attack.hit_count, attack.miss_count, attack.unknown_count) == (4, 2, 1, 1)
    assert (attack.total_damage, attack.max_damage, attack.min_damage, attack.average_damage) == (123, 123, 0, 61.5)
    assert actions["Xitra", "normal_attack_critical"].total_damage == 573
    skill = actions["Xitra", "weapon_skill"]
    assert (skill.total_damage, skill.max_damage, skill.min_damage, skill.average_damage) == (421, 321, 100, 210.5)
    assert result.order_range.first().label == "2 – 13"
    members, totals = party_view(result, ["xitra", "Boro", "Nobody", "BORO"])
    assert [(m.name, m.dps_share) for m in members.orderBy("roster_pos").collect()] == [
        ("xitra", 1.0), ("Boro", pytest.approx(200 / 1117)), ("Nobody", 0.0),
    ]
    assert totals.first().total_dps == pytest.approx(1317 / 30)


def test_live_equals_stored(sample):
    stored = analyze(sample, rules=RULES, with_timeline=False)
    live = analyze_slice(sample, 0, 14, RULES)
    assert rows(live.action_summary) == rows(stored.action_summary)
    assert rows(live.actor_summary.drop("dps")) == rows(stored.actor_summary.drop("dps"))
    part = analyze_slice(sample, 5, 9, RULES)
    assert part.range_lines.count() == 4
    assert rows(part.action_summary, "actor", "total_damage") == [("Boro", 200), ("Xitra", 0)]


CASES = [
    (["Xitraの攻撃。", "→敵に、123ダメージ。"], ("Xitra", "通常攻撃", "normal_attack", "hit", 123)),
    (["Xitraの攻撃。", "→敵に、0ダメージ。"], ("Xitra", "通常攻撃", "normal_attack", "hit", 0)),
    *[(["Xitraの攻撃。", w], ("Xitra", "通常攻撃", "normal_attack", s, 0)) for w, s in (
        ("ミス。", "miss"), ("敵は攻撃を回避した。", "miss"), ("敵は攻撃をかわした。", "miss"), ("効果なし。", "miss"),
        ("効果がなかった。", "miss"), ("レジストされた！", "miss"), ("発動失敗。", "excluded"), ("使用失敗。", "excluded"),
    )],
    (["Xitraは、ファイアを唱えた。"], ("Xitra", "ファイア", "magic", "excluded", 0)),
    (["Xitraは、敵にファイアを唱えた。", "敵に、99ダメージ。"], ("Xitra", "ファイア", "magic", "excluded", 0)),
    (["Xitraの攻撃。"], ("Xitra", "通常攻撃", "normal_attack", "unknown", 0)),
    (["Xitraは、レッドロータスを実行。", "→敵に、321ダメージ。"], ("Xitra", "レッドロータス", "weapon_skill", "hit", 321)),
    (["Xitraは、レッドロータスIIを実行。"], ("Xitra", "レッドロータスII", "ability", "unknown", 0)),
    (["Xitraの攻撃。クリティカル！", "→敵に、573ダメージ。"], ("Xitra", "通常攻撃", "normal_attack_critical", "hit", 573)),
    (["Xitraの攻撃→敵に、505ダメージ。"], ("Xitra", "通常攻撃", "normal_attack", "hit", 505)),
    (["Xitraのファイアが発動。", "→敵に、123ダメージ。"], ("Xitra", "ファイア", "magic", "hit", 123)),
    (["Xitraのドレインが発動。", "→敵から、2042HP吸収。"], ("Xitra", "ドレイン", "magic", "hit", 2042)),
    *[(["Xitraの" + n + "が発動。", e], ("Xitra", n, "magic", "hit", 0)) for n, e in (
        ("アブゾタック", "→敵から、30MP吸収。"), ("アブゾタック", "→敵から、30TP吸収。"), ("ケアルIV", "→味方のHPが、100回復。"),
        ("イレース", "→味方のバイオの効果を消し去った！"), ("プロテス", "→Xitraは、プロテスの効果。"), ("スリプル", "→敵は、睡眠の状態になった！"),
    )],
    (["Xitraのバーサク！"], ("Xitra", "バーサク", "ability", "unknown", 0)),
    (["Xitraのサムライロール→合計値が5になった！"], ("Xitra", "サムライロール", "ability", "unknown", 0)),
    (["Xitraのダブルアップ", "→サムライロールの合計値が8になった！"], ("Xitra", "ダブルアップ", "ability", "unknown", 0)),
]
UNPARSED = [
    ["誰が何をしたかわからない。"], ["Xitraのジョブポイントがアップ！"], ["Xitraのジョブポイントがアップ!"],
    ["→XitraのHPが、100回復！"], ["→Xitraのバイオの効果を消し去った！"], ["Xitraのバーサク"], [""],
]


def test_classification(groups_log):
    actions = parsing.parse_groups(groups_log(*[c for c, _ in CASES], *UNPARSED), RULES)
    got = {r.event_group: r for r in actions.collect()}
    for place, (_, expected) in enumerate(CASES):
        r = got[f"g{place}"]
        assert r.parsed, place
        assert (r.actor, r.action_name, r.action_type, r.hit_status, r.damage_total) == expected, place
    for place in range(len(CASES), len(CASES) + len(UNPARSED)):
        assert not got[f"g{place}"].parsed and got[f"g{place}"].reason == fixed.UNPARSED_REASON


def test_custom_rules(groups_log):
    log = groups_log(["zap Xitra 5"], ["noise"])
    custom = RuleSet(
        line_actor=lambda t: F.get(F.regexp_extract_all(t, F.lit("zap ([A-Za-z]+)"), F.lit(1)), 0),
        line_action=lambda t: F.when(t.startswith("zap"), "zap"),
        line_type=lambda t: F.when(t.startswith("zap"), "magic"),
        line_damage=lambda t: F.transform(F.regexp_extract_all(t, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("bigint")),
    )
    got = {r.event_group: r for r in parsing.parse_groups(log, custom).collect()}
    assert (got["g0"].actor, got["g0"].action_name, got["g0"].action_type, got["g0"].damage_total) == ("Xitra", "zap", "magic", 5)
    assert not got["g1"].parsed


def test_catalog_table(spark):
    catalog = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "name STRING")
    assert RuleSet.with_catalog(catalog).weapon_skills == ("a", "b")


def test_group_order_and_gate(make_log):
    log = make_log(
        {"event_group": "g", "visible_text": "c", "sequence_hint_min": None, "order": 3},
        {"event_group": "g", "visible_text": "b", "sequence_hint_min": 3},
        {"event_group": "g", "visible_text": "a", "sequence_hint_min": 1},
        {"event_group": "g", "visible_text": "e", "sequence_hint_min": -1, "order": None},
        {"event_group": "g", "visible_text": "d", "sequence_hint_min": None, "order": 9},
        {"event_group": "　", "visible_text": "x"}, {"event_group": None, "visible_text": "y"},
        {"event_group": "g", "visible_text": "z", "session_id": " "},
    )
    for limit in (100, 2):
        lines = grouping.group_lines(log, hot_rows=limit).orderBy("group_pos").collect()
        assert [r.visible_text for r in lines] == ["a", "b", "c", "d", "e"]
        assert [r.group_pos for r in lines] == [1, 2, 3, 4, 5]
    group = grouping.build_groups(log).first()
    assert (group.line_count, group.order_min, group.order_max, group.first_text, group.last_text) == (5, 2, 9, "a", "e")
    assert grouping.ungrouped_count(log).first()[0] == 3


def test_range_rules(make_log):
    log = make_log(
        {"visible_text": "a"}, {"visible_text": "m", "is_marker": True}, {"visible_text": "=== Area ==="},
        {"visible_text": "b"}, {"visible_text": "n", "order": None},
    )
    assert [r[0] for r in rows(ranges.select_range(log), "visible_text")] == ["a", "b", "n"]
    inside = ranges.Selection(ranges.Endpoint.marker(1))
    assert rows(ranges.select_range(log, inside), "visible_text") == [("b",)]
    assert ("=== Area ===",) in rows(ranges.select_range(log, inside, drop_area_changes=False), "visible_text")
    point = ranges.Endpoint
    assert ranges.validate_range(ranges.Selection()) == []
    assert ranges.validate_range(ranges.Selection(ranges.LOG_END, ranges.LOG_START)) == ["start_kind", "end_kind"]
    assert ranges.validate_range(ranges.Selection(point.marker(None), point("marker", has_marker=False))) == [
        "start_order_missing", "end_marker_missing",
    ]
    assert ranges.validate_range(ranges.Selection(point.marker(5), point.marker(5))) == ["end_not_after_start"]
    with pytest.raises(ValueError):
        ranges.select_range(log, ranges.Selection(point.marker(5), point.marker(4)))


def test_time_of_markers(make_log):
    log = make_log({"visible_text": "a"})

    def resolve(start, end):
        r = ranges.resolve_time(log, ranges.Selection(start, end)).first()
        return r.confidence, r.duration_seconds, r.warnings

    at = lambda clock, order: ranges.Endpoint.marker(order, "k", clock)
    assert resolve(at("[21:35:10]", 1), at("[21:35:40]", 2)) == ("exact", 30.0, [])
    assert resolve(at("[21:35]", 1), at("[21:35]", 2)) == ("minute", 59.0, [])
    assert resolve(at("[21:35]", 1), at("[21:36]", 2)) == ("minute", 119.0, [])
    assert resolve(at("[23:59]", 1), at("[00:01]", 2)) == ("minute", 179.0, [])
    assert resolve(at("[10:00:00]", 1), at("[10:00:00]", 2)) == ("exact", 0.0, ["empty_time"])
    seen = ranges.Endpoint.marker(2, "k", None, "2026-06-23 21:36:10")
    confidence, _, warnings = resolve(at("[21:35:10]", 1), seen)
    assert confidence == "estimated" and warnings == ["mixed_time_basis"]
    assert resolve(ranges.Endpoint.marker(1), at("[1:00]", 2))[0] == "unknown"


def test_open_times(make_log):
    seen = datetime(2026, 6, 23, 12, 0, 0)
    log = make_log(
        {"visible_text": "a", "message_time_text": "21:35"}, {"visible_text": "b", "message_time_text": "[10:00:05]"},
        {"visible_text": "c", "message_time_text": "[10:01]"}, {"visible_text": "d"},
    )
    r = ranges.resolve_time(log).first()
    assert (r.confidence, r.duration_seconds) == ("estimated", 114.0)
    only_seen = make_log(
        {"visible_text": "a"}, {"visible_text": "b", "first_seen_at": seen},
        {"visible_text": "c", "first_seen_at": seen.replace(second=42)},
    )
    r = ranges.resolve_time(only_seen).first()
    assert (r.confidence, r.duration_seconds) == ("estimated", 42.0)
    assert ranges.resolve_time(make_log({"visible_text": "a"})).first().warnings == ["unknown_time"]


def hits(groups_log, *groups):
    log = groups_log(*groups)
    actions = parsing.parse_groups(log, RULES)
    time = ranges.resolve_time(log)
    return {r.actor: r for r in summaries.summarize_actors(actions, incoming.incoming_results(log, actions), time).collect()}


def test_incoming_single_lines(groups_log):
    for line, damage in (("Enemyの攻撃→Aliceに、15ダメージ。", 15), ("Enemyの攻撃→Aliceに、0ダメージ。", 0), ("Enemyの攻撃。→Aliceに、15ダメージ。", 15)):
        got = hits(groups_log, [line])
        assert (got["Alice"].incoming_total, got["Alice"].incoming_hit_count, got["Alice"].incoming_count) == (damage, 1, 1)
        assert got["Enemy"].incoming_total == 0
    got = hits(groups_log, ["Enemyの攻撃→Aliceは攻撃をかわした。"], ["Enemyのファイアが発動。→Aliceに、200ダメージ。"])["Alice"]
    assert (got.incoming_total, got.incoming_hit_count, got.evade_count, got.evasion_rate) == (200, 0, 1, 1.0)


def test_incoming_areas_and_chains(groups_log):
    got = hits(
        groups_log,
        ["Enemyは、範囲技を実行。", "→Aliceに、100ダメージ。", "→Boroは攻撃をかわした。"],
        ["Enemyの攻撃。", "→Aliceは、0ダメージ。"],
        ["Enemyの攻撃。", "ミス！Aliceは攻撃をかわした。"],
        ["Enemyのファイアが発動。", "→Aliceに、200ダメージ。"],
        ["Enemyの攻撃。ミス。"],
        ["Enemyの攻撃。", "Aliceの分身が攻撃を受けて消えた。"],
        ["Enemyの弱体技！", "→Aliceに効果なし。"],
    )
    alice = got["Alice"]
    assert (alice.total_damage, alice.incoming_total, alice.incoming_max, alice.incoming_min) == (0, 300, 200, 0)
    assert (alice.incoming_average, alice.incoming_hit_count, alice.evade_count) == (100.0, 2, 1)
    assert alice.evasion_rate == pytest.approx(1 / 3)
    assert got["Boro"].evasion_rate == 1.0 and got["Boro"].incoming_average is None
    got = hits(
        groups_log,
        ["Enemyは、範囲技を実行。", "→Aliceに、80ダメージ。", "技連携・切断！", "→Aliceに、20ダメージ。"],
        ["→Boroに、50ダメージ。"],
    )
    assert (got["Alice"].incoming_total, got["Alice"].incoming_hit_count) == (100, 1)
    assert got["Boro"].incoming_total == 50 and got["Boro"].evasion_rate is None


def test_points(groups_log, make_log):
    texts = [
        "Xitraは、1024経験値を獲得した。", "→Xitraは、3チェーン！200リミットポイントを獲得した。", "Xitraは、300エクゼンプラーポイントを獲得した。",
        "Xitraは、ガリモーフリーを57得た、3795360になった。", "Xitraは、ガリモーフリーを43得た、3795403になった。",
        "Xitraは、24経験値を獲得した。", "ポイントではないログ", "Xitraは、5謎ポイントを獲得した。",
    ]
    log = make_log(
        {"visible_text": "a", "message_time_text": "[10:00:00]"}, *[{"visible_text": x} for x in texts],
        {"visible_text": "z", "message_time_text": "[10:30:00]"},
    )
    got = {r.point_name: r for r in summaries.summarize_points(log, ranges.resolve_time(log)).collect()}
    assert {n: (r.total_points, r.max_chain) for n, r in got.items()} == {
        "経験値": (1048, 0), "リミットポイント": (200, 3), "エクゼンプラーポイント": (300, 0), "ガリモーフリー": (100, 0),
    }
    assert got["経験値"].points_per_hour == 2096.0
    untimed = groups_log(texts)
    assert summaries.summarize_points(untimed, ranges.resolve_time(untimed)).filter("points_per_hour IS NOT NULL").isEmpty()


def test_volume(spark):
    log = spark.range(10_000).select(
        F.lit("s").alias("session_id"), F.concat(F.lit("g"), (F.col("id") / 2).cast("int")).alias("event_group"),
        (F.col("id") + 1).alias("order"),
        F.when(F.col("id") % 2 == 0, "Xitraの攻撃。").otherwise("→敵に、20ダメージ。").alias("visible_text"),
    )
    result = analyze_slice(log, 0, 10_000, RULES)
    row = result.action_summary.first()
    assert (row.total_damage, row.use_count) == (100_000, 5_000)


def test_result_sorting(spark):
    table = spark.createDataFrame([("a", None), ("b", 2), ("c", 1)], "actor STRING, v INT")
    assert [r.v for r in summaries.sort_table(table, "v").collect()] == [None, 1, 2]
    assert [r.v for r in summaries.sort_table(table, "v", True).collect()] == [2, 1, None]
    kinds = spark.createDataFrame([("a", "x", k) for k in ("ability", "magic", "normal_attack")], "actor STRING, action_name STRING, action_type STRING")
    assert [r.action_type for r in summaries.order_summary(kinds).collect()] == ["normal_attack", "magic", "ability"]
