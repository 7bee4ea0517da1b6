import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from loomlog.operators.collection import combine_sessions
from loomlog.sources import exports, lines, sessions


def put(path, text):
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(text.encode() if isinstance(text, str) else text)


def canonical(order, text, **more):
    return json.dumps({"session_id": "s1", "order": order, "visible_text": text, "event_group": "g", **more}, ensure_ascii=False)


def test_read_canonical(spark, tmp_path):
    body = "\n".join([
        canonical(2, "b", sequence_hint_min="1F", is_marker=True), "", "{broken", canonical("0x", "n"), canonical("1", "a", extra={"x": 1}),
        canonical("A", "hex", first_seen_at="2026-06-23T21:35:10+09:00"), "[]",
    ])
    put(tmp_path / "one" / lines.CANONICAL_FILE, "﻿" + body + "\n")
    put(tmp_path / "two" / lines.CANONICAL_FILE, canonical(None, "z") + "\n" + canonical(5, "y"))
    log, errors = lines.read_canonical(spark, str(tmp_path))
    one = log.filter(F.col("session_folder").endswith("one"))
    assert [(r.order, r.visible_text) for r in one.orderBy(F.asc_nulls_last("order"), "read_index").collect()] == [
        (1, "a"), (2, "b"), (10, "hex"), (None, "n"),
    ]
    row = one.filter("visible_text = 'hex'").first()
    assert row.first_seen_at == datetime(2026, 6, 23, 12, 35, 10) and row.is_marker is False
    assert one.filter("visible_text = 'b'").first().sequence_hint_min == 31
    assert rows(errors, "line_number", "line") == [(3, "{broken"), (7, "[]")]
    assert lines.read_canonical(spark, [str(tmp_path / "two")])[0].count() == 2
    decimal, _ = lines.read_canonical(spark, str(tmp_path / "one"), "decimal")
    assert decimal.filter("visible_text = 'b'").first().sequence_hint_min is None


def test_combined_order(make_log):
    at = lambda s: datetime(2026, 1, 1, 0, 0, s)
    log = make_log(
        {"visible_text": "c", "first_seen_at": at(2), "session_id": "b"}, {"visible_text": "a", "first_seen_at": at(1), "session_id": "b"},
        {"visible_text": "d", "first_seen_at": None}, {"visible_text": "b", "first_seen_at": at(2), "session_id": "a", "order": None},
        {"visible_text": "b0", "first_seen_at": at(2), "session_id": "a", "order": 9},
    )
    for parts in (1, 4, 16):
        got = combine_sessions(log.repartition(parts)).orderBy("order").collect()
        assert [(r.order, r.visible_text) for r in got] == [(1, "a"), (2, "b0"), (3, "b"), (4, "c"), (5, "d")]


def test_canonical_round_trip(spark, make_log, tmp_path):
    log = make_log({"visible_text": "b", "order": 2, "canonical_record_id": "k2"}, {"visible_text": "a", "order": 1, "canonical_record_id": "k1"})
    log = log.withColumn("canonical_key", F.col("canonical_record_id"))
    sources = spark.createDataFrame([("s", "k1", "x"), ("s", "k1", "w"), ("s", "k2", "v")], "session_id STRING, canonical_key STRING, raw_record_id STRING")
    path = str(tmp_path / "canonical")
    for _ in range(2):
        lines.write_canonical(log, path, sources)
    back = lines.read_canonical_table(spark, path)
    assert rows(back, "order", "visible_text", "source_raw_record_ids") == [("1", "a", ["w", "x"]), ("2", "b", ["v"])]
    assert spark.read.parquet(path + "_sources").count() == 3


def session(folder, session_id, status="completed", stats="{}", **more):
    put(folder / "session.json", json.dumps({"session_id": session_id, "status": status, **more}))
    put(folder / "stats.json", stats)
    put(folder / lines.CANONICAL_FILE, canonical(1, "a") + "\n" + canonical(2, "#m", is_marker=True))


def test_sessions(spark, tmp_path):
    session(tmp_path / "a", "s1", started_at="2026-01-01T00:00:00Z", ended_at="2026-01-01T01:00:00Z", stats='{"parse_errors": 2, "gap_warnings": 1}')
    session(tmp_path / "b", "s2", "Active", started_at="2026-01-02T00:00:00Z")
    put(tmp_path / "c" / "session.json", '{"session_id": "s3"}')
    session(tmp_path / "d", "s4", "weird")
    put(tmp_path / "b" / "raw_records.jsonl", "")
    found, stats, issues = sessions.read_sessions(spark, str(tmp_path))
    name = lambda df, *cols: rows(df.withColumn("f", F.element_at(F.split("session_folder", "/"), -1)), "f", *cols)
    assert name(found, "session_id", "status", "has_raw") == [("a", "s1", "completed", False), ("b", "s2", "active", True)]
    assert name(issues, "code", "detail") == [
        ("b", "not_completed", "active"), ("c", "missing_file", lines.CANONICAL_FILE), ("c", "missing_file", "stats.json"),
        ("d", "unreadable_file", "session.json"),
    ]
    assert [r[0].split("/")[-1] for r in sessions.list_sessions(spark, str(tmp_path)).collect()] == ["a", "b", "c", "d"]
    log, _ = lines.read_canonical(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    mine = found.join(stats.select("session_folder"), "session_folder", "left_semi")
    total = sessions.session_rollup(mine, stats, log).first()
    assert (total.session_count, total.line_count, total.marker_count, total.parse_errors, total.gap_warnings) == (2, 4, 2, 2, 1)
    assert total.latest_end == datetime(2026, 1, 1, 1) and total.earliest_start == datetime(2026, 1, 1)
    put(tmp_path / "a" / "session_annotations.json", '{"schema_version": 1, "session_id": "s1", "alias": " 海戦 "}')
    put(tmp_path / "b" / "session_annotations.json", '{"schema_version": 1, "session_id": "other", "alias": "x"}')
    aliases, errors = sessions.read_aliases(spark, str(tmp_path), found)
    assert rows(aliases, "session_id", "alias") == [("s1", "海戦")] and rows(errors, "code") == [("other_session",)]
    named = sessions.with_labels(found, aliases)
    assert rows(named, "label") == [("s2",), ("海戦（s1）",)]
    assert rows(sessions.filter_sessions(named, "海"), "session_id") == [("s1",)] and sessions.filter_sessions(named, "S").count() == 2


def test_exclusion_files(spark, tmp_path):
    name = "analysis_exclusions.json"
    put(tmp_path / "a" / name, json.dumps({
        "schema_version": 1, "records": [{"session_id": "s", "canonical_record_id": "r1"}], "groups": [{"session_id": "s", "event_group": "g"}],
    }, indent=2))
    put(tmp_path / "b" / name, '{"schema_version": 2, "records": [], "groups": []}')
    put(tmp_path / "c" / name, '{"schema_version": 1, "records": [{"session_id": "", "canonical_record_id": "r"}], "groups": []}')
    put(tmp_path / "d" / name, "{nope")
    records, groups, errors = sessions.read_exclusions(spark, str(tmp_path))
    assert rows(records, "session_id", "canonical_record_id") == [("s", "r1")] and rows(groups, "event_group") == [("g",)]
    assert rows(errors.withColumn("f", F.element_at(F.split("session_folder", "/"), -1)), "f", "code") == [
        ("b", "wrong_version"), ("c", "blank_key"), ("d", "unreadable_file"),
    ]
    log = spark.createDataFrame([(str(tmp_path / "a"),), ("file:" + str(tmp_path / "d"),)], "session_folder STRING")
    path = str(tmp_path / "stored")
    sessions.write_exclusions(records.drop("session_folder"), groups.drop("session_folder"), path)
    back = sessions.read_exclusion_tables(spark, path)
    assert rows(back[0]) == [("s", "r1")] and rows(back[1]) == [("s", "g")]
    with pytest.raises(ValueError):
        sessions.write_exclusions(records.drop("session_folder").withColumn("session_id", F.lit(" ")), groups, path)
    assert sessions.blocked_sessions(log, errors).count() <= 1


def test_manifest(spark, tmp_path):
    start, end = datetime(2026, 6, 23, 21, 35, 10), datetime(2026, 6, 23, 22, 0, 0)
    made = sessions.new_manifest(spark, start, temp_dir="t")
    assert made.first().session_id == "20260623-213510" and made.first().status == "active"
    done = sessions.set_session_status(made, "20260623-213510", "completed", end).first()
    assert (done.status, done.ended_at) == ("completed", end)
    by_hand = sessions.set_session_status(made, "20260623-213510", "completed", end, manual=True).first()
    assert (by_hand.status, by_hand.ended_at, by_hand.manually_completed_at) == ("completed", None, end)
    with pytest.raises(ValueError):
        aborted = sessions.set_session_status(made, "20260623-213510", "aborted", end)
        sessions.set_session_status(aborted, "20260623-213510", "completed", end, manual=True)
    sessions.write_manifest(made, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m").glob("*.json"))
    assert '"status":"active"' in text and "ended_at" not in text


def test_csv(spark, tmp_path):
    table = spark.createDataFrame(
        [("経験値", 12345, 0, None), ('a,"b"', 1, 2, 1.5)], "point_name STRING, total_points BIGINT, max_chain BIGINT, points_per_hour DOUBLE"
    )
    exports.export_csv(table.coalesce(1), str(tmp_path / "csv"), "points")
    data = next((tmp_path / "csv").glob("*.csv")).read_bytes().decode()
    assert data == '﻿ポイント種別,総合計,最大チェーン,時給\r\n経験値,"12,345",0,-\r\n"a,""b""",1,2,2\r\n'


def test_flat_view(spark, tmp_path):
    body = "\r\n".join([
        '{"schema_version":"1.0","window_id":1,"meta_fields":["a","b"],"display":{"color_code":"80ff00aa","font":"x"},"visible_text":"\\\\u3042\\\\ud83d\\\\ude00!","is_marker":false,"parse_error":null,"note":{"k":[1,2]}}',
        "", "not json", '{"window_id":2,"visible_text":"","zeta":7}',
    ])
    put(tmp_path / lines.RAW_FILE, "﻿" + body)
    flat = lines.flatten_raw(spark, str(tmp_path))
    assert flat.columns[: 1 + len(lines.FLAT_COLUMNS)] == ["__line_number", *lines.FLAT_COLUMNS]
    assert set(flat.columns[1 + len(lines.FLAT_COLUMNS):]) == {"note", "zeta", "raw_line"}
    first, bad, last = flat.orderBy("__line_number").collect()
    assert (first["meta1"], first["meta2"], first["meta3"], first["display.color_code"]) == ("a", "b", "", "80ff00aa")
    assert (first["visible_text"], first["note"], first["is_marker"], first["parse_error"]) == ("あ😀!", '{"k":[1,2]}', "false", "")
    assert (bad["__line_number"], bad["parse_status"], bad["raw_line"], bad["meta1"]) == ("3", "error", "not json", "")
    assert (last["zeta"], last["note"], last["__line_number"]) == ("7", "", "4")
    assert rows(lines.replay(flat, 1), "text", "color") == [("あ😀!", "#ff00aa")]
    assert rows(lines.replay(flat, 2), "text", "color") == [(" ", "inherit")]
