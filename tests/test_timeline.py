import random

import pytest

from conftest import rows
from loomlog.operators import report, timeline
from loomlog.operators.rules import RuleSet
from loomlog.plans.analysis import analyze
from loomlog.operators.summaries import summarize_actions

RULES = RuleSet(weapon_skills=("レッドロータス",))


def line(order, group, text, clock=None, session="s"):
    return {"order": order, "event_group": group, "visible_text": text, "message_time_text": clock, "session_id": session}


def build(make_log, *lines, **options):
    return timeline.build_timeline(make_log(*lines), rules=RULES, **options)


@pytest.mark.parametrize("hot_rows", [100, 1])
def test_chain_sections(make_log, hot_rows):
    events, warnings = build(
        make_log,
        line(1, "a", "Xitraは、レッドロータスを実行。"), line(2, "a", "→Bossに、100ダメージ。"),
        line(3, "a", "連携：核熱。"), line(4, "a", "→Bossに、77ダメージ。"),
        line(5, "a", "Xitraは、レッドロータスを実行。"), line(6, "a", "→Otherに、50ダメージ。"),
        line(7, "b", "Boroのバーサク！"), line(8, "b", "連携"), line(9, "b", "→Bossに、9ダメージ。"),
        hot_rows=hot_rows, slice_rows=2,
    )
    got = {r.event_group: r for r in events.collect()}
    assert (got["a"].damage, got["a"].result_count, got["a"].order, got["a"].status) == (150, 2, 1, "damage_confirmed")
    assert got["b"].damage is None and got["b"].status == "unconfirmed"
    assert warnings.isEmpty()


def test_statuses_rolls_and_resources(make_log):
    events, warnings = build(
        make_log,
        line(1, "c", "Xitraは、ファイアを唱えた。"), line(2, "c", "雑音"), line(3, "c", "Xitraは、詠唱中断した。"),
        line(4, "start", "Xitraは、ファイアを唱えた。"),
        line(5, "roll", "Xitraのサムライロール→合計値が5になった！"), line(6, "roll", "→Boroは、サムライロールの効果。"),
        line(7, "dbl", "Xitraのダブルアップ"), line(8, "dbl", "→サムライロールの合計値が8になった！"),
        line(9, "mix", "Xitraのダブルアップ"), line(10, "mix", "→サムライロールの合計値が8になった！"),
        line(11, "mix", "→ウィザーズロールの合計値が9になった！"),
        line(12, "heal", "Xitraのケアルが発動。"), line(13, "heal", "→Boroのhpが、"), line(14, "heal", "→BoroのHPが、100回復。"),
        line(15, "heal", "→敵から、30TP吸収。"), line(16, "heal", "→敵から、7MP吸収！"),
        line(17, "miss", "Xitraのスリプルが発動。"), line(18, "miss", "→敵は、レジストされた。"),
        line(19, "fail", "Xitraのスリプルが発動。"), line(20, "fail", "使用失敗。"),
        line(21, "zero", "Xitraは、レッドロータスを実行。"), line(22, "zero", "→Bossに、0ダメージ。"),
        line(23, "amb", "Xitraのバーサク！"), line(24, "amb", "Boroのバーサク！"),
        line(25, "att", "Xitraのバーサク！"), line(26, "att", "Xitraの攻撃。"),
        line(27, None, "迷子"),
    )
    got = {r.event_group: r for r in events.collect()}
    assert {g: r.status for g, r in got.items()} == {
        "c": "interrupted", "roll": "effect_confirmed", "dbl": "unconfirmed", "mix": "unconfirmed", "heal": "effect_confirmed",
        "miss": "missed", "fail": "failed", "zero": "damage_confirmed",
    }
    assert (got["c"].is_executed, got["c"].order) == (False, 3)
    assert (got["roll"].roll_total, got["dbl"].roll_total, got["mix"].roll_total) == (5, 8, None)
    heal = got["heal"]
    assert (heal.hp_recovery, heal.tp_absorb, heal.mp_absorb, heal.resource_count, heal.damage) == (100, 30, 7, 3, None)
    assert got["zero"].damage == 0
    assert rows(warnings) == [("ambiguous_group", "s:amb", 1), ("ambiguous_group", "s:att", 1), ("lines_without_group", "", 1)]


def test_multi_target_line_gives_no_timeline_damage(make_log):
    events, _ = build(
        make_log, line(1, "a", "Xitraは、レッドロータスを実行。"), line(2, "a", "→亀に、321ダメージ。Bossに、100ダメージ。"),
    )
    assert events.first().damage is None


@pytest.mark.parametrize("slice_rows", [1, 3, 1000])
def test_reference_times(make_log, slice_rows):
    events, _ = build(
        make_log,
        line(1, None, "x", "[23:59]"), line(2, "a", "Xitraのバーサク！"), line(3, "b", "Boroのバーサク！", "[00:01]", "other"),
        line(4, "c", "Xitraのバーサク！"), line(5, "d", "Xitraのバーサク！", None, "third"),
        line(None, "e", "Xitraのバーサク！"),
        slice_rows=slice_rows,
    )
    got = {r.event_group: (r.reference_time, r.reference_order) for r in events.collect()}
    assert got == {"a": ("[23:59]", 1), "b": ("[00:01]", 3), "c": ("[23:59]", 1), "d": (None, None), "e": (None, None)}


EVENTS = "session_id STRING, event_group STRING, actor STRING, reference_time STRING, event_no BIGINT"


def numbered(spark, *events):
    return spark.createDataFrame([(s, f"g{i}", a, t, i + 1) for i, (s, a, t) in enumerate(events)], EVENTS)


def greedy(events):
    packed, row = [], []
    for s, a, t in events:
        if row and (len(row) == 3 or a in [x[1] for x in row] or row[0][0] != s or row[0][2] != t):
            packed.append(row)
            row = []
        row.append((s, a, t))
    return packed + ([row] if row else [])


def sizes(df):
    return [r[1] for r in sorted(tuple(x) for x in df.groupBy("row_no").count().collect())]


def test_row_packing(spark):
    six = [("s", a, None) for a in ("Alice", "Boro", "Alice", "Carol", "Boro", "Alice")]
    assert sizes(report.layout_rows(numbered(spark, *six), 3)) == [2, 3, 1]
    eight = [
        ("s", "Alice", None), ("s", "Boro", None), ("s", "Carol", None), ("s", "David", None), ("s", "Erin", "[10:00]"),
        ("s", "Fred", "[10:00]"), ("s", "Gina", "[10:01]"), ("second", "Hank", "[10:01]"),
    ]
    rows_ = report.layout_rows(numbered(spark, *eight), 4)
    assert sizes(rows_) == [3, 1, 2, 1, 1]
    marks = {r.row_no: (r.show_session, r.show_time) for r in report.mark_changes(numbered(spark, *eight), rows_).collect()}
    assert marks == {1: (True, False), 2: (False, False), 3: (False, True), 4: (False, True), 5: (True, True)}


def test_row_packing_against_greedy(spark):
    rng = random.Random(7)
    events = [(f"s{i // 150}", rng.choice("ABCD"), rng.choice([None, None, "[10:00]"]) if i % 9 == 0 else None) for i in range(400)]
    expected = [len(r) for r in greedy(events)]
    for slice_rows in (3, 7, 64, 1000):
        assert sizes(report.layout_rows(numbered(spark, *events), slice_rows, block=2)) == expected, slice_rows


def test_report_tables(make_log):
    log = make_log(
        line(1, "a", "Aliceは、レッドロータスを実行。", "[10:00:00]"), line(2, "a", "→Bossに、100ダメージ。"),
        line(3, "b", "Aliceは、レッドロータスを実行。"), line(4, "b", "ミス。"),
        line(5, "c", "Aliceの攻撃。"), line(6, "c", "→Bossに、7ダメージ。"),
        line(7, "d", "Bossの攻撃。"), line(8, "d", "→Aliceに、30ダメージ。"),
        line(9, "e", "Boroは、ファイアを唱えた。"), line(10, "e", "Boroは、詠唱中断した。"),
    )
    result = analyze(log, rules=RULES)
    lines = timeline.with_chain_section(timeline.declarations(log, RULES))
    members = log.sparkSession.createDataFrame([("Alice",), ("Boro",)], "actor STRING")
    tables = report.report_tables(
        result.timeline, lines, result.actor_summary, summarize_actions(result.actions), members, log
    )
    got = {r.actor: r for r in tables["members"].collect()}
    alice = got["Alice"]
    assert (alice.timeline_damage, alice.weapon_skill_count, alice.weapon_skill_average) == (100, 2, 100.0)
    assert (alice.attack_hit_rate, alice.incoming_total, alice.incoming_max, alice.evasion_rate) == (2 / 3, 30, 30, 0.0)
    assert got["Boro"].timeline_damage is None and got["Boro"].attack_hit_rate is None
    actions = {(r.actor, r.action_name): (r.executed, r.interrupted, r.confirmed, r.damage_sum) for r in tables["actions"].collect()}
    assert actions == {("Alice", "レッドロータス"): (2, 0, 1, 100), ("Boro", "ファイア"): (0, 1, 0, None)}
    assert tables["events"].count() == 3 and tables["rows"].count() == 2
    assert rows(tables["results"], "kind", "target", "amount") == [("damage", "Boss", 100)]
    assert rows(tables["sources"].filter("event_no = 1"), "visible_text") == [("Aliceは、レッドロータスを実行。",), ("→Bossに、100ダメージ。",)]


def test_report_sort(spark):
    table = spark.createDataFrame([("b", 2), ("a", None), ("c", 1)], "n STRING, v INT")
    assert [r.v for r in report.sort_report(table, "v").collect()] == [1, 2, None]
    assert [r.v for r in report.sort_report(table, "v", True).collect()] == [2, 1, None]
    assert [r.n for r in report.sort_report(table, "n", text=True).collect()] == ["a", "b", "c"]


def test_text_sorts_with_its_numbers(spark):
    names = ["敵10", "敵 2", "a100b", "", "a20b", "a3c", "a3b", "a003a", "a", "あ2", "あ10", "ア3", "7", "12", "a" + "9" * 30, "a1" + "0" * 30, "a0", "あ２０"]
    table = spark.createDataFrame([(n,) for n in [*names, None]], "n STRING").repartition(4)
    up = [r.n for r in report.sort_report(table, "n", text=True).collect()]
    assert up[-1] is None and sorted(up[:-1]) == sorted(names)
    place = {n: i for i, n in enumerate(up)}
    chains = (
        ["", "7", "12", "a", "a0", "a003a", "a3b", "a3c", "a20b", "a100b", "a" + "9" * 30, "a1" + "0" * 30],
        ["あ2", "ア3", "あ10", "あ２０"],
    )
    for chain in chains:
        assert [place[n] for n in chain] == sorted(place[n] for n in chain)
    down = [r.n for r in report.sort_report(table, "n", descending=True, text=True).collect()]
    assert down[-1] is None and down[:-1] == up[:-1][::-1]
