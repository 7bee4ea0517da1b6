"""Scans, areas, exclusions, search, actors."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from loomlog.operators import actors as who
from loomlog.operators import areas, exclusions as ex, ranges, search
from loomlog.operators.scans import dense_order, running
from loomlog.plans.analysis import analyze


@pytest.mark.parametrize("slice_rows", [1, 7, 10_000])
def test_running_equals_a_plain_loop(spark, slice_rows):
    rng = random.Random(3)
    data = [(rng.choice("ab"), i, rng.choice([None, 1, 5])) for i in range(120)]
    got = running(
        spark.createDataFrame(data, "k STRING, o BIGINT, v BIGINT").repartition(5), "o", ["k"],
        sums={"total": F.col("v")}, lasts={"seen": F.col("v")}, slice_rows=slice_rows,
    )
    total, seen, expected = {}, {}, []
    for k, o, v in data:
        total[k] = total.get(k, 0) + (v or 0)
        seen[k] = v if v is not None else seen.get(k)
        expected.append((k, o, v, total[k], seen[k]))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_dense_order_does_not_depend_on_partitions(spark, partitions):
    rng = random.Random(5)
    data = [(rng.choice("abb"), rng.randrange(50), i) for i in range(300)]
    frame = spark.createDataFrame(data, "k STRING, v BIGINT, i BIGINT").repartition(partitions)
    whole = dense_order(frame, ["v", "i"], partitions=partitions)
    assert [r.i for r in whole.orderBy("order").collect()] == [i for _, i in sorted((v, i) for _, v, i in data)]
    assert [r.order for r in whole.orderBy("order").collect()] == list(range(1, 301))
    keyed = dense_order(frame, ["v", "i"], ["k"], "n", start=10, partitions=partitions)
    for key in "ab":
        expected = [i for k, v, i in sorted(data, key=lambda r: (r[1], r[2])) if k == key]
        mine = keyed.filter(F.col("k") == key).orderBy("n").collect()
        assert [r.i for r in mine] == expected and mine[0].n == 11


def area_log(make_log):
    t = lambda text, clock=None, **more: {"visible_text": text, "message_time_text": clock, **more}
    return make_log(
        t("before"), t("=== Area A ===", "[10:00:00]"), t("a1", "[23:59:00]"), t("a2"), t("###m", "[00:00:30]", is_marker=True),
        t("=== Area B ==="), t("=== area a ===", "[11:00]"), t("a3", "12:00:00"), t("a4", "[12:00:09]"),
    )


@pytest.mark.parametrize("slice_rows", [1, 4, 1000])
def test_area_stays(make_log, slice_rows):
    log = area_log(make_log)
    changes = areas.area_changes(log, slice_rows).orderBy("sequence").collect()
    assert [(c.sequence, c.area_name, c.occurrence) for c in changes] == [(1, "Area A", 1), (2, "Area B", 1), (3, "area a", 2)]
    stays = areas.area_stays(log, slice_rows).orderBy("stay").collect()
    assert [(s.start_order, s.end_order, s.line_count) for s in stays] == [(2, 6, 2), (6, 7, 0), (7, None, 2)]
    assert [(s.first_time_text, s.last_time_text) for s in stays] == [("[23:59:00]", "[00:00:30]"), (None, None), ("12:00:00", "[12:00:09]")]
    assert [s.elapsed_text for s in stays] == ["1分30秒", "-", "9秒"]
    first = areas.stay_selection(stays[0].asDict())
    assert [r[0] for r in rows(ranges.select_range(log, first), "visible_text")] == ["a1", "a2"]
    assert [r.line for r in areas.preview(log, 2, 6, 1).collect()] == ["[23:59:00] a1"]
    shown = areas.stay_previews(log, 1, slice_rows).orderBy("stay").collect()
    assert [(r.stay, r.line) for r in shown] == [(1, "[23:59:00] a1"), (3, "12:00:00 a3")]
    assert areas.filter_stays(areas.area_stays(log), "AREA A", 1).count() == 2


def test_line_tied_with_a_change_is_in_no_stay(make_log):
    log = make_log({"visible_text": "=== A ==="}, {"visible_text": "tied", "order": 1}, {"visible_text": "in", "order": 2})
    assert rows(areas.assign_stays(log), "visible_text", "stay") == [("in", 1)]


def keys(spark, records=(), groups=(), folder="f"):
    return (
        spark.createDataFrame([(folder, "s", r) for r in records], "session_folder STRING, session_id STRING, canonical_record_id STRING"),
        spark.createDataFrame([(folder, "s", g) for g in groups], "session_folder STRING, session_id STRING, event_group STRING"),
    )


def exclusion_log(make_log):
    t = lambda group, text, **more: {"event_group": group, "visible_text": text, **more}
    return make_log(
        t("g1", "Xitraの攻撃。", message_time_text="[10:00:00]"), t("g1", "→敵に、100ダメージ。"),
        t("g2", "Xitraの攻撃。"), t("g2", "→敵に、10ダメージ。"),
        t("g2", "→敵に、1ダメージ。", session_folder="other"), t(None, "blank", message_time_text="[10:01:00]"),
    )


def test_exclusions_keep_the_time(spark, make_log):
    log = exclusion_log(make_log)
    records, groups = keys(spark, ["r2"], ["g2"])
    result = analyze(log, excluded_records=records, excluded_groups=groups)
    assert tuple(result.exclusion_counts.first()) == (3, 2)
    assert result.time.first().duration_seconds == 60.0
    # The line of the other folder stays, although it shares the session id.
    assert {r.actor: r.incoming_total for r in result.actor_summary.collect()} == {"Xitra": 0, "敵": 1}
    flagged = ex.flag_excluded(log, records, groups)
    assert rows(flagged.filter("is_excluded"), "order") == [(2,), (3,), (4,)]
    everything = analyze(log, excluded_groups=keys(spark, [], ["g1", "g2"])[1], excluded_records=keys(spark, ["r6"])[0])
    assert everything.time.first().duration_seconds == 60.0


def test_exclusion_edits(spark, make_log):
    log = exclusion_log(make_log)
    records, groups = (k.drop("session_folder") for k in keys(spark, ["r1"], ["g2"]))
    edit = lambda op, where: ex.edit_exclusions(op, log.filter(where), records, groups, log)
    assert edit("exclude_rows", "order = 3").refused == "group_excluded"
    assert edit("exclude_rows", "order = 99").refused == "nothing_selected"
    assert edit("exclude_groups", "order = 6").refused == "group_key_missing"
    assert rows(edit("exclude_rows", "order = 2").records, "canonical_record_id") == [("r1",), ("r2",)]
    assert not edit("exclude_rows", "order = 1").changed
    assert edit("restore_rows", "order = 1").records.isEmpty()
    both = edit("exclude_groups", "order = 2")
    assert both.changed and both.records.isEmpty() and both.groups.count() == 2
    back = edit("restore_groups", "order = 4")
    assert back.groups.isEmpty() and rows(back.records, "canonical_record_id") == [("r1",)]
    flagged = ex.flag_excluded(log, records, groups)
    can = ex.edit_eligibility(flagged.filter("order = 2"), flagged).first()
    assert tuple(can) == (True, False, True, True)


def test_edits_concern_one_folder(spark, make_log):
    """Two folders may hold the same session id: an edit in one of them leaves the other alone."""
    t = lambda text, folder, **more: {"event_group": "g1", "visible_text": text, "session_folder": folder, **more}
    log = make_log(
        t("Xitraの攻撃。", "a", canonical_record_id="r1"), t("→敵に、100ダメージ。", "a", canonical_record_id="r2"),
        t("Xitraの攻撃。", "b", canonical_record_id="r1"), t("→敵に、10ダメージ。", "b", canonical_record_id="r2"),
    )
    records, groups = keys(spark)
    edit = ex.edit_exclusions("exclude_groups", log.filter("order = 1"), records, groups, log)
    flagged = ex.flag_excluded(log, edit.records, edit.groups)
    assert rows(flagged.filter("is_excluded"), "order") == [(1,), (2,)]
    one = ex.edit_exclusions("exclude_rows", log.filter("order = 4"), edit.records, edit.groups, log)
    assert one.refused is None
    assert rows(ex.flag_excluded(log, one.records, one.groups).filter("is_excluded"), "order") == [(1,), (2,), (4,)]
    back = ex.edit_exclusions("restore_groups", log.filter("order = 2"), one.records, one.groups, log)
    assert back.groups.isEmpty() and rows(back.records, "session_folder", "canonical_record_id") == [("b", "r2")]


def test_sessions_are_combined_before_the_analysis(spark, make_log):
    at = lambda hour, minute: datetime(2026, 1, 1, hour, minute)
    line = lambda session, order, when: {
        "session_id": session, "session_folder": session, "order": order, "event_group": f"g{order}", "visible_text": "Xitraの攻撃。",
        "first_seen_at": when, "message_time_text": f"[{when:%H:%M:%S}]",
    }
    log = make_log(
        *(line("late", n + 1, at(12, 2 * n)) for n in range(3)), *(line("early", n + 1, at(10, 29 * n)) for n in range(2))
    )
    result = analyze(log, with_timeline=False)
    assert result.time.first().duration_seconds == 7440.0
    assert rows(result.range_lines, "order", "session_id", "read_index") == [
        (1, "early", 0), (2, "early", 1), (3, "late", 2), (4, "late", 3), (5, "late", 4)
    ]
    errors = spark.createDataFrame([("late",)], "session_folder STRING")
    with pytest.raises(ValueError):
        analyze(log, exclusion_errors=errors)
    assert analyze(log, exclusion_errors=errors.filter("session_folder = 'x'"), with_timeline=False).actions.count() == 5


def test_search(make_log):
    log = make_log(
        {"event_group": "g1", "visible_text": "A Goblin"}, {"event_group": "g1", "visible_text": "other"},
        {"event_group": None, "visible_text": "GOBLIN x"}, {"event_group": None, "visible_text": "lost"},
    ).withColumn("is_excluded", F.col("order") == 2)
    orders = lambda df: [r[0] for r in rows(df, "order")]
    assert orders(search.search_log(log, " goblin ")) == [1, 3]
    assert orders(search.search_log(log, "goblin", True)) == [1, 2, 3]
    assert orders(search.search_log(log, "goblin", True, True)) == [2]
    assert orders(search.search_log(log, "")) == [1, 2, 3, 4]
    placed = search.positioned(log)
    around = search.context(placed, placed.filter("order = 3"), 1)
    assert rows(around, "order", "offset") == [(2, -1), (3, 0), (4, 1)]
    assert search.group_context(log, "s", "g1").count() == 2
    hits = search.neighbour_hits(log.filter("order <> 2"), ["order"]).orderBy("hit_no").collect()
    assert [(h.order, h.previous_hit, h.next_hit) for h in hits] == [(1, 3, 2), (3, 1, 3), (4, 2, 1)]
    assert orders(search.filter_columns(log, {"visible_text": "gob", "event_group": "G"})) == [1]
    assert [r.order for r in search.page(log, 3, 9, ["order"]).collect()] == [4]
    assert [r.order for r in search.page(log, 2, 0, ["order"]).collect()] == [1, 2]


def test_actor_kinds(spark):
    registry = who.name_registry(spark, pc=["xitra", "BORO", "boro"], npc=["boro", "大亀"])
    actors = spark.createDataFrame(
        [("Xitra", 1), ("xitra", 2), ("Boro", 3), ("大亀", 4), ("Carol", 5), ("Gurfurlur the", 6), ("Abcdefghijklmnop", 7)],
        "actor STRING, use_count BIGINT",
    )
    kinds = who.actor_kind(actors, registry)
    assert {r.actor: r.kind for r in kinds.collect()} == {
        "Xitra": "registered_pc", "xitra": "registered_pc", "Boro": "registered_npc", "大亀": "registered_npc",
        "Carol": "pc_candidate", "Gurfurlur the": "unknown", "Abcdefghijklmnop": "unknown",
    }
    assert rows(who.party_candidates(kinds)) == [("Carol", 5), ("Xitra", 3)]
    assert who.visible_actors(kinds, "none").isEmpty() and who.visible_actors(kinds, "all").count() == 7
    assert rows(who.filter_actors(kinds, "XI", ("registered_pc",)), "actor") == [("Xitra",), ("xitra",)]
    shown = who.restrict_actors(actors, who.visible_actors(kinds, "registered_pc"))
    assert rows(shown, "actor") == [("Xitra",), ("xitra",)]
    events = spark.createDataFrame([("Dora",), ("Boro",)], "actor STRING")
    candidates = who.timeline_candidates(actors, events, registry)
    assert rows(candidates, "actor") == [("Carol",), ("Dora",), ("Xitra",), ("xitra",)]
    assert rows(who.keep_selected(spark.createDataFrame([("Dora",), ("Gone",)], "actor STRING"), candidates)) == [("Dora",)]
    assert who.cap_roster(["a", "A", " b ", "", "c", "d", "e", "f", "g"]) == ["a", "b", "c", "d", "e", "f"]
