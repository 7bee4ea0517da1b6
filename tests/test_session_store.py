"""The session store: what is written is read back, lenient JSON, and edits that keep unknown keys."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from loomlog.plans.analysis import analyze
from loomlog.plans.collecting import collect_once, store_session
from loomlog.sources import documents, lines, sessions
from loomlog.sources.session_store import SessionWriter, folder_in, read_store, write_store
from test_collection import landing, put, record, snapshot  # noqa: F401



def text(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(content)


LINES = "session_folder STRING, file STRING, place LONG, line STRING"


def test_files_are_written_in_order_and_listed(spark, tmp_path):
    root = str(tmp_path)
    many = [("s1", "canonical_records.jsonl", n, f"é{n}") for n in reversed(range(50))]
    write_store(spark.createDataFrame(many + [("a/s2", "session.json", 0, '{"x": 1}'), ("a/s2", "stats.json", 0, None)], LINES).repartition(7), root)
    assert (tmp_path / "s1/canonical_records.jsonl").read_text().split("\n") == [f"é{n}" for n in range(50)] + [""]
    text(tmp_path / "s3", "broken.json", b"\xff{")
    (tmp_path / "session.json").write_text("{}")
    (tmp_path / "s1/.session.json.left").write_text("from a job that broke off")
    found = read_store(spark, root, ["session.json", "broken.json"])
    assert rows(found.withColumn("f", F.regexp_replace("session_folder", f"^file:{root}", "")), "f", "file", "size", "content") == [
        ("", "session.json", 2, "{}"), ("/a/s2", "session.json", 9, '{"x": 1}\n'), ("/a/s2", "stats.json", 0, None),
        ("/s1", "canonical_records.jsonl", sum(len(f"é{n}".encode()) + 1 for n in range(50)), None), ("/s3", "broken.json", 2, "�{"),
    ]
    assert {r[0] for r in found.select(folder_in(root)).collect()} >= {"a/s2", "s1", "s3"}
    assert rows(read_store(spark, f"file://{root}"), "session_folder", "file") == rows(found, "session_folder", "file")
    assert read_store(spark, str(tmp_path / "nothing")).count() == 0


def test_a_job_that_breaks_off_leaves_no_session(spark, tmp_path):
    names = [("s1", "session.json", 0, "{}"), ("s2", "../x", 0, "{}"), ("..", "session.json", 0, "{}"), ("s1", "_x", 0, ""), ("", "x", 0, "")]
    for name in names[1:]:
        with pytest.raises(Exception, match="no name of a folder or file"):
            write_store(spark.createDataFrame([names[0], name], LINES), str(tmp_path))
    assert read_store(spark, str(tmp_path)).count() == 0

    class Line(dict):
        __getattr__ = dict.get

    writer = SessionWriter(str(tmp_path))
    line = lambda file, text: Line(session_folder="s", file=file, line=text)
    first = writer.write(iter([line("session.json", "{}"), line("stats.json", "{}")]))
    again = writer.write(iter([line("session.json", "{}"), line("stats.json", "{}")]))
    writer.commit([again, None])
    writer.abort([first, None])
    assert sorted(os.listdir(tmp_path / "s")) == ["session.json", "stats.json"]
    with pytest.raises(ValueError):
        writer.write(iter([line("a", ""), line("b", ""), line("a", "")]))


def test_collected_sessions_are_read_back(spark, landing, tmp_path):  # noqa: F811
    """Collect, write, read, analyse: the same as without the store in between."""
    root = str(tmp_path / "sessions")
    run = collect_once(spark, landing, "20260623-213510")
    manifest = sessions.new_manifest(spark, datetime(2026, 6, 23, 21, 35, 10), watch_files=["1_0.log"])
    store_session(run, root, manifest)
    assert sorted(os.listdir(f"{root}/20260623-213510")) == ["canonical_records.jsonl", "raw_records.jsonl", "session.json", "stats.json"]
    log, errors = lines.read_canonical(spark, root)
    assert errors.count() == 0
    same = ("order", "visible_text", "event_group", "canonical_record_id", "first_seen_at", "is_marker", "marker_keyword", "source_files")
    assert rows(log, *same) == rows(run.canonical, *same)
    ids = {(r.canonical_record_id, i) for r in log.collect() for i in r.source_raw_record_ids}
    assert ids == {(r.canonical_key, r.raw_record_id) for r in run.sources.collect()}
    for name in ("action_summary", "actor_summary", "timeline"):
        assert rows(getattr(analyze(log), name)) == rows(getattr(analyze(run.canonical), name))
    assert rows(lines.read_raw(spark, root, "jsonl"), "raw_record_id") == rows(run.deduped, "raw_record_id")
    found, stats, issues = sessions.read_sessions(spark, root)
    assert rows(found, "session_id", "status", "has_raw", "watch_files") == [("20260623-213510", "active", True, ["1_0.log"])]
    assert rows(stats, "raw_records_written", "parse_errors") == [(6, 1)] and rows(issues, "code") == [("not_completed",)]
    # The folder of the written lines is that of the manifest, so edits meet their lines.
    keys = spark.createDataFrame([("20260623-213510", "20260623-213510", "e1")], "session_folder STRING, session_id STRING, event_group STRING")
    none = spark.createDataFrame([], "session_folder STRING, session_id STRING, canonical_record_id STRING")
    sessions.save_exclusions(none, keys, root)
    records, groups, bad = sessions.read_exclusions(spark, root)
    assert (records.count(), bad.count()) == (0, 0) and rows(groups, "session_folder") == rows(log.limit(1), "session_folder")
    left = analyze(log, excluded_groups=groups, exclusion_errors=bad)
    assert left.excluded.count() == log.filter("event_group = 'e1'").count() > 0


def test_a_run_without_records(spark, tmp_path):
    put(str(tmp_path / "logs"), "1_0.log", snapshot(), 1_000)
    run = collect_once(spark, str(tmp_path / "logs"), "s")
    store_session(run, str(tmp_path / "out"), sessions.new_manifest(spark, datetime(2026, 1, 1)).withColumn("session_id", F.lit("s")))
    assert (tmp_path / "out/s/canonical_records.jsonl").read_bytes() == b""
    assert sessions.read_sessions(spark, str(tmp_path / "out"))[0].count() == 1


def test_exclusions_and_aliases_round_trip(spark, tmp_path):
    root = str(tmp_path)
    records = spark.createDataFrame([("f", "s", f'r"{n}') for n in range(20)] + [("g", "t", "r1")], "session_folder STRING, session_id STRING, canonical_record_id STRING")
    groups = spark.createDataFrame([("f", "s", "g1"), ("f", "s", "g1")], "session_folder STRING, session_id STRING, event_group STRING")
    sessions.save_exclusions(records, groups, root)
    back = sessions.read_exclusions(spark, root)
    assert rows(back[0], "session_id", "canonical_record_id") == rows(records, "session_id", "canonical_record_id")
    assert rows(back[1], "session_id", "event_group") == [("s", "g1")] and back[2].count() == 0
    strict = json.loads((tmp_path / "f/analysis_exclusions.json").read_text())
    assert strict["schema_version"] == 1 and len(strict["records"]) == 20 and len(strict["groups"]) == 1
    with pytest.raises(ValueError):
        sessions.save_exclusions(records.withColumn("canonical_record_id", F.lit(" ")), groups, root)
    owner = spark.createDataFrame([(f"file:{root}/f", "s")], "session_folder STRING, session_id STRING")
    write_store(sessions.alias_documents(spark.createDataFrame([("f", "s", "  My  run ")], "session_folder STRING, session_id STRING, alias STRING")), root)
    assert rows(sessions.read_aliases(spark, root, owner)[0], "session_id", "alias") == [("s", "My  run")]


def test_edits_keep_unknown_keys(spark, tmp_path):
    root = str(tmp_path)
    kept = {"session_id": "s1", "status": "active", "ended_at": "2026-01-01T00:00:00Z", "Own_Key": {"Deep": [1, "x"]}, "n": 12345678901}
    text(tmp_path / "a", "session.json", json.dumps(kept).encode())
    text(tmp_path / "b", "session.json", b'{"session_id": "s2", "STATUS": "completed", /* so */ "more": true,}')
    at = datetime(2026, 2, 3, 4, 5, 6)
    sessions.edit_manifest(spark, root, "s1", "completed", at, manual=True)
    edited = json.loads((tmp_path / "a/session.json").read_text())
    assert edited.pop("manually_completed_at").startswith("2026-02-03T04:05:06") and edited == kept | {"status": "completed"}
    for name in ("s1", "s2", "s3"):
        with pytest.raises(ValueError):
            sessions.edit_manifest(spark, root, name, "completed", at, manual=True)
    sessions.edit_manifest(spark, root, "s2", "aborted", at)
    edited = json.loads((tmp_path / "b/session.json").read_text())
    assert edited.pop("ended_at").startswith("2026-02-03") and edited == {"session_id": "s2", "status": "aborted", "more": True}
    with pytest.raises(ValueError):
        sessions.edit_manifest(spark, root, "s1", "active", at)


LENIENT = [
    ('{"Session_ID": "s", "ORDER": 3, "Visible_Text": "a, } // no comment", "Order_": [1,],} // end', ("s", 3, "a, } // no comment")),
    ('{"session_id": "s", /* , } */ "order": "0A", "visible_text": "q\\"\\\\", "extra": {"x": [1,2,],},}', ("s", 10, 'q"\\')),
    ('{"session_id": "s", "order": null, "visible_text": null, "is_marker": null}', ("s", None, None)),
    ('{"session_id": "s", "order": "none", "visible_text": "x"}', ("s", None, "x")),
    ("{}", (None, None, None)),
    ('{"session_id": "s", "order": true}', None),
    ('{"session_id": "s", "order": 1.5}', None),
    ('{"session_id": "s", "order": 99999999999999999999}', None),
    ('{"session_id": "s", "sequence_hint_min": {"a": 1}}', None),
    ('{"session_id": 5, "order": 1}', None),
    ('{"session_id": "s", "is_marker": "true"}', None),
    ('{"session_id": "s", "source_files": "1_0.log"}', None),
    ('{"session_id": "s", "first_seen_at": "yesterday"}', None),
    ('[{"session_id": "s"}]', None),
    ('{"session_id": "s"', None),
    ('"text"', None),
    ("null", None),
]


def test_lenient_lines(spark, tmp_path):
    text(tmp_path / "s", lines.CANONICAL_FILE, "\n".join(line for line, _ in LENIENT).encode())
    log, errors = lines.read_canonical(spark, str(tmp_path))
    assert rows(log, "session_id", "order", "visible_text") == sorted([w for _, w in LENIENT if w], key=lambda r: [(x is None, str(x)) for x in r])
    assert [r.line_number for r in errors.orderBy("line_number").collect()] == [n for n, (_, w) in enumerate(LENIENT, 1) if w is None]


def test_keys_that_differ_in_case(spark):
    frame = spark.createDataFrame([('{"A": 1, "a": 2, "aB": 3, "AB": 4, "Ab": 5}',), (None,), ("",)], "t STRING")
    found = [r[0] for r in frame.select(F.to_json(documents.parse_document("t"))).collect()]
    assert [json.loads(f) if f else f for f in found] == [{"a": 2, "ab": 3}, None, None]
