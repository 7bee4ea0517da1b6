"""Snapshots to canonical lines, in batch and as a stream."""

import hashlib
import os
import random
from datetime import datetime
from functools import reduce
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from loomlog.operators import collection as c
from loomlog.plans.collecting import collect_once
from loomlog.sources.snapshots import check_slots, cut_records, scan_snapshots
from loomlog.streaming import collect as sc
from loomlog.streaming import live
from loomlog.streaming.runs import RunTable

META = 21


def record(text, group="g", hint="1", color="80ff00aa", unix="0", meta=META, end=b"\0", raw=None):
    fields = ["0"] * META
    fields[3], fields[4], fields[5], fields[19] = color, group, hint, unix
    return ",".join(fields[:meta]).encode() + b"," + (raw if raw is not None else text.encode("cp932")) + end


def snapshot(*records, offsets=None):
    body, starts = b"", []
    for r in records:
        starts.append(100 + len(body))
        body += r
    header = b"".join(o.to_bytes(2, "little") for o in (offsets or starts)).ljust(100, b"\0")
    return header + body


def put(folder, name, content, at):
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder) / name
    path.write_bytes(content)
    os.utime(path, (at, at))


def test_cutter():
    assert [r[6] for r in cut_records(b"")] == ["error"]
    assert [r[6] for r in cut_records(b"x" * 99)] == ["error"]
    assert list(cut_records(b"\0" * 100)) == []
    one, two = record("一"), record("二")
    got = list(cut_records(snapshot(one, two)))
    assert [(r[0], r[5], r[6]) for r in got] == [(0, "一", "success"), (1, "二", "success")]
    assert got[0][2] == one and got[0][3][4] == "g"
    # Repeated offsets, offsets inside a record, and offsets outside the file.
    odd = [100, 100, 100 + 5, 100 + len(one) + 3, 7, 60000]
    assert [(r[0], r[5]) for r in cut_records(snapshot(one, two, offsets=odd))] == [(0, "一"), (3, "二")]
    few = list(cut_records(snapshot(record("x", meta=5))))
    assert few[0][6] == "error" and len(few[0][3]) == 5
    assert list(cut_records(snapshot(record("x", end=b""))))[0][6] == "error"
    codes = b"a\x1e\x01b\x1f\x02c\x7f1d\xef\x03e\x1e"
    assert list(cut_records(snapshot(record("", raw=codes))))[0][5] == "abcde"


@pytest.fixture()
def landing(tmp_path):
    """The same line in two windows, a repeated file, a marker, a broken record, a foreign file."""
    root = str(tmp_path / "logs")
    shared = record("Xitraの攻撃。", "e1", "5")
    put(root, "1_0.log", snapshot(shared, record("[21:35] ###start", "", "1"), record("壊れ", meta=3)), 1_000)
    put(root, "2_0.log", snapshot(record("Xitraの攻撃。", "e1", "3"), record("→敵に、5ダメージ。", "e1", "6")), 2_000)
    put(root, "1_19.log", snapshot(record("後", "e2", "1", unix="6A3B0000")), 3_000)
    put(root, "3_0.log", snapshot(shared), 500)
    put(root, "1_20.log", snapshot(shared), 500)
    put(root, "note.txt", b"x", 500)
    return root


def test_collect_once(spark, landing):
    assert rows(scan_snapshots(spark, landing), "source_file") == [("1_0.log",), ("1_19.log",), ("2_0.log",)]
    assert rows(scan_snapshots(spark, landing, windows=(2,)), "source_file") == [("2_0.log",)]
    assert rows(scan_snapshots(spark, landing, slots=19), "source_file") == [("1_0.log",), ("2_0.log",)]
    assert [r.source_file for r in c.snapshot_order(scan_snapshots(spark, landing)).collect()] == ["1_0.log", "2_0.log", "1_19.log"]
    with pytest.raises(ValueError):
        check_slots(21)
    run = collect_once(spark, landing, "20260623-213510")
    raw = {(r.source_file, r.record_index): r for r in run.raw.collect()}
    assert len(raw) == 6
    first = raw["1_0.log", 0]
    body = record("Xitraの攻撃。", "e1", "5")
    assert first.raw_record_hash == hashlib.sha1(body).hexdigest()
    assert first.raw_record_id == hashlib.sha1(b"1_0.log0" + body).hexdigest()
    assert (first.display.color_code, first.event_group, first.sequence_hint, first.window_id) == ("80ff00aa", "e1", "5", 1)
    marker = raw["1_0.log", 1]
    assert (marker.is_marker, marker.marker_keyword, marker.message_time_text, marker.message_time_precision) == (True, "start", "21:35", "minute")
    assert raw["1_19.log", 0].message_unix_time_hint == 0x6A3B0000
    lines = run.canonical.orderBy("order").collect()
    assert [(x.order, x.visible_text) for x in lines] == [(1, "Xitraの攻撃。"), (2, "[21:35] ###start"), (3, "→敵に、5ダメージ。"), (4, "後")]
    merged = lines[0]
    assert (merged.source_windows, merged.source_files) == ([1, 2], ["1_0.log", "2_0.log"])
    assert (merged.sequence_hint_min, merged.sequence_hint_max, merged.record_count) == ("3", "5", 2)
    assert merged.canonical_key == hashlib.sha1("e1Xitraの攻撃。".encode()).hexdigest()
    assert run.sources.count() == 5
    nested = {r.visible_text: r.source_raw_record_ids for r in c.with_source_ids(run.canonical, run.sources).collect()}
    assert nested["Xitraの攻撃。"] == sorted(nested["Xitraの攻撃。"]) and len(nested["Xitraの攻撃。"]) == 2
    ids = {(r.canonical_key, r.raw_record_id) for r in run.sources.collect()}
    assert {(x.canonical_key, i) for x in c.with_source_ids(run.canonical, run.sources).collect() for i in x.source_raw_record_ids} == ids
    stats = run.stats.first()
    assert (stats.raw_records_written, stats.canonical_records_written, stats.parse_errors) == (6, 4, 1)
    assert (stats.duplicate_raw_records_skipped, stats.duplicate_canonical_records_skipped) == (0, 1)


def test_raw_duplicates_and_baseline(spark, landing, tmp_path):
    again = str(tmp_path / "logs" / "later")
    put(again, "1_0.log", snapshot(record("Xitraの攻撃。", "e1", "5"), record("新しい", "e3", "1")), 4_000)
    put(again, "2_5.log", snapshot(record("後", "e2", "1", unix="6A3B0000")), 5_000)
    run = collect_once(spark, landing, "s")
    assert run.stats.first().duplicate_raw_records_skipped == 1
    kept = run.deduped.filter("visible_text = 'Xitraの攻撃。' AND source_file = '1_0.log'").collect()
    assert [k.file_mtime.timestamp() for k in kept] == [1_000.0]
    baseline = c.project_raw(run.records.filter("NOT path LIKE '%later%'"), "s")
    fresh = collect_once(spark, again, "s", baseline=baseline)
    assert rows(fresh.canonical, "visible_text") == [("新しい",)]
    assert fresh.stats.first().baseline_records_skipped == 2


RAW = (
    "session_id STRING, event_group STRING, visible_text STRING, sequence_hint STRING, window_id INT, source_file STRING, "
    "record_index INT, file_mtime TIMESTAMP, first_seen_at TIMESTAMP, raw_record_id STRING, parse_status STRING, "
    "message_time_text STRING, message_time_precision STRING, is_marker BOOLEAN, marker_keyword STRING"
)


def raw_rows(spark, hints, key="k", start=0):
    return spark.createDataFrame(
        [
            ("s", "g", key, h, 1 + i % 2, f"{1 + i % 2}_{i % 20}.log", 0, datetime(2026, 1, 1, 0, 0, start + i),
             datetime(2026, 1, 1, 0, 0, start + i), f"{key}{start + i}", "success", None, None, False, None)
            for i, h in enumerate(hints)
        ],
        RAW,
    )


def expected_range(hints):
    def better(a, b, low):
        try:
            x, y = int(a), int(b)
        except ValueError:
            x, y = a, b
        return b if (y < x if low else y > x) else a

    given = [h for h in hints if h is not None]
    return (reduce(lambda a, b: better(a, b, True), given), reduce(lambda a, b: better(a, b, False), given)) if given else (None, None)


HINTS = {
    "numbers": ["10", "9", "100"], "ties": ["01", "1", "001"], "hex": ["00A1", "0010", "00FF"], "mixed": ["9", "1a", "10", "9"],
    "cycle": ["10", "1a", "9", "10"], "none": [None, None], "some": [None, "7", None, "zz"], "negative": ["-5", "3", "-12"],
}


def test_runs_equal_a_plain_fold():
    rng = random.Random(2)
    pool = ["9", "10", "1a", "b", "100", "0f", "-3", "+7", "07"]
    after = lambda state, runs, low: next(
        (r for r, n, w, x in runs if c._replaces(state, None if n is None else int(n), w, x, low)), state
    )
    for _ in range(3000):
        values = [rng.choice(pool) for _ in range(rng.randrange(1, 9))]
        state = rng.choice(pool)
        for side, low in enumerate((True, False)):
            runs = c._runs(values, low)
            assert runs[0][0] == expected_range(values)[side]
            assert after(state, runs, low) == expected_range([state, *values])[side]


@pytest.mark.parametrize("slice_seconds", [1, 60])
def test_hint_ranges_follow_arrival(spark, slice_seconds):
    rng = random.Random(1)
    cases = dict(HINTS)
    for n in range(12):
        cases[f"random{n}"] = [rng.choice(["9", "10", "1a", "b", "100", "0f", None]) for _ in range(rng.randrange(1, 9))]
    raw = reduce(lambda a, b: a.unionByName(b), [raw_rows(spark, h, k) for k, h in cases.items()])
    got = {r.visible_text: (r.sequence_hint_min, r.sequence_hint_max) for r in c.canonicalize(raw.repartition(6), None, slice_seconds).collect()}
    assert got == {k: expected_range(h) for k, h in cases.items()}


def test_merging_in_batches_equals_merging_at_once(spark, tmp_path):
    path = str(tmp_path / "canonical")
    parts = [{k: h[:2] for k, h in HINTS.items()}, {k: h[2:] for k, h in HINTS.items() if h[2:]}]
    whole = None
    for batch, part in enumerate(parts):
        raw = reduce(lambda a, b: a.unionByName(b), [raw_rows(spark, h, k, 10 * batch) for k, h in part.items()])
        sc.upsert_batch(raw, batch, path)
        sc.upsert_batch(raw, batch, path)
        whole = raw if whole is None else whole.unionByName(raw)
    shape = ("canonical_key", "sequence_hint_min", "sequence_hint_max", "record_count", "source_windows", "source_files", "last_seen_at")
    state = sc.read_state(spark, path)
    assert rows(state, *shape) == rows(c.canonicalize(whole), *shape)
    assert sorted(r.order for r in state.collect()) == list(range(1, len(HINTS) + 1))
    sc.compact(spark, path, str(tmp_path / "compact"))
    assert rows(sc.read_state(spark, str(tmp_path / "compact")), *shape) == rows(state, *shape)


def test_a_known_record_never_merges_twice(spark, tmp_path):
    path = str(tmp_path / "canonical")
    first, later = raw_rows(spark, ["1", "2"]), raw_rows(spark, ["2", "3"], start=1)
    sc.upsert_batch(first, 0, path)
    sc.upsert_batch(later, 1, path)
    whole = c.canonicalize(c.dedupe_raw(first.unionByName(later)))
    shape = ("canonical_key", "record_count", "sequence_hint_min", "sequence_hint_max")
    assert rows(sc.read_state(spark, path), *shape) == rows(whole, *shape)
    assert sc.read_state(spark, path).first().record_count == 3


def test_a_new_query_goes_on_after_compaction(spark, tmp_path):
    path, target = str(tmp_path / "canonical"), str(tmp_path / "compact")
    sc.upsert_batch(raw_rows(spark, ["1"], "a").unionByName(raw_rows(spark, ["1"], "b", 1)), 0, path)
    sc.compact(spark, path, target)
    # Batch 0 of the next query: one known record, one new record of a known line, one new line.
    again = raw_rows(spark, ["1"], "a").unionByName(raw_rows(spark, ["5"], "b", 7)).unionByName(raw_rows(spark, ["2"], "c", 3))
    for _ in range(2):
        sc.upsert_batch(again, 0, target)
        assert rows(sc.read_state(spark, target), "visible_text", "record_count", "order") == [("a", 1, 1), ("b", 2, 2), ("c", 1, 3)]


def test_a_broken_state_is_an_error(spark, tmp_path):
    (tmp_path / "lines" / "batch=0").mkdir(parents=True)
    (tmp_path / "lines" / "batch=0" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        sc.upsert_batch(raw_rows(spark, ["1"]), 1, str(tmp_path))


def test_lookups_open_only_buckets_that_can_hold_a_key(spark, tmp_path):
    table = RunTable(str(tmp_path / "t"), ("k",), lambda rows: rows.groupBy("k").agg(F.max("v").alias("v")), bucket_slots=1)
    numbers = lambda begin, end, v: spark.range(begin, end).select(F.col("id").alias("k"), F.lit(v).cast("bigint").alias("v"))
    for batch in range(3):
        table.write(numbers(20_000 * batch, 20_000 * (batch + 1), batch), batch, 20_000)
    buckets = lambda found: {p.rsplit("/", 1)[0] for p in found.inputFiles()}
    assert len(buckets(table.read(spark))) == 3 * 16
    found = table.lookup(numbers(20_001, 20_004, 9), 3)
    # At most one bucket per key in its own run; a chance of one in sixteen per key in each other run.
    assert rows(found) == [(20_001, 1), (20_002, 1), (20_003, 1)] and len(buckets(found)) <= 5
    assert rows(table.lookup(numbers(20_001, 20_004, 9).unionByName(numbers(7, 8, 9)), 1)) == [(7, 0)]
    # Keys that nobody has seen: few buckets are opened by chance, and nothing is found.
    unseen = table.lookup(numbers(90_000, 90_016, 9), 3)
    assert unseen is None or (rows(unseen) == [] and len(buckets(unseen)) <= 12)
    assert table.lookup(numbers(0, 0, 9), 3) is None


def test_runs_merge_in_levels(spark, tmp_path):
    table = RunTable(str(tmp_path / "t"), ("k",), lambda rows: rows.groupBy("k").agg(F.max("v").alias("v")), fanout=2)
    expected = {}
    for batch in range(9):
        table.merge(spark, batch)
        table.merge(spark, batch)
        # Batch 4 brings nothing; every other one a key of its own and a new value of key 100.
        keys = [] if batch == 4 else [(batch, batch), (100, batch)]
        written = spark.createDataFrame(keys, "k BIGINT, v BIGINT")
        for _ in range(2):
            table.write(written, batch, len(keys))
        expected |= dict(keys)
        assert dict(rows(table.read(spark))) == expected
        assert dict(rows(table.lookup(written, None))) == dict(keys) if keys else table.lookup(written, None) is None
    spans = [(r.begin, r.end) for r in table.cover(spark)]
    assert spans == [(0, 8), (8, 9)]
    # What the merge before last replaced is gone, what the last one replaced is still there for its readers.
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["batch=8", "merged=0-4", "merged=0-8", "merged=4-8"]
    assert dict(rows(table.read(spark, 8))) == {k: 7 if k == 100 else v for k, v in expected.items() if k != 8}


def test_a_merge_that_broke_off_is_made_again(spark, tmp_path):
    table = RunTable(str(tmp_path / "t"), ("k",), lambda rows: rows.groupBy("k").agg(F.max("v").alias("v")), fanout=2)
    for batch in range(2):
        table.write(spark.createDataFrame([(batch, batch)], "k BIGINT, v BIGINT"), batch, 1)
    broken = tmp_path / "t" / "merged=0-2" / "rows"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    assert rows(table.read(spark)) == [(0, 0), (1, 1)]
    table.merge(spark, 2)
    assert [(r.begin, r.end) for r in table.cover(spark)] == [(0, 2)] and rows(table.read(spark)) == [(0, 0), (1, 1)]


def test_many_batches_equal_one(spark, tmp_path):
    path = str(tmp_path / "canonical")
    whole = None
    for batch in range(5):
        # Each batch: a new line, a new record of the first line, and a record that came before.
        raw = raw_rows(spark, [str(batch)], f"t{batch}", 10 * batch).unionByName(raw_rows(spark, [str(90 - batch)], "t0", 10 * batch + 5))
        raw = raw if batch == 0 else raw.unionByName(raw_rows(spark, ["0"], "t0", 0))
        sc.upsert_batch(raw, batch, path, fanout=2)
        whole = raw if whole is None else whole.unionByName(raw)
    sc.upsert_batch(raw_rows(spark, ["0"], "t0", 0), 5, path, fanout=2)
    once = c.assign_order(c.canonicalize(c.dedupe_raw(whole)))
    shape = ("canonical_key", "sequence_hint_min", "sequence_hint_max", "record_count", "order", "last_seen_at")
    assert rows(sc.read_state(spark, path), *shape) == rows(once, *shape)


def test_late_snapshots_are_not_lost(spark, landing, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for number, day in enumerate((10, 7, 8)):
        folder = str(tmp_path / "landing")
        put(folder + f"/day{day}", "1_1.log", snapshot(record(f"日{day}", f"e{day}", "1")), 86_400 * day)
        sc.canonicalize_stream(sc.stream_raw(spark, folder, "s"), out, check).awaitTermination(120)
        assert sc.read_state(spark, out).count() == number + 1
    with pytest.raises(ValueError):
        sc.canonicalize_stream(sc.stream_raw(spark, folder, "s"), out, str(tmp_path / "other"))


def test_stream_equals_batch(spark, landing, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    sc.canonicalize_stream(sc.stream_raw(spark, landing, "s", files_per_batch=1), out, check).awaitTermination(120)
    put(landing + "/later", "2_1.log", snapshot(record("Xitraの攻撃。", "e1", "9"), record("遅い", "e9", "1")), 9_000)
    sc.canonicalize_stream(sc.stream_raw(spark, landing, "s", files_per_batch=1), out, check).awaitTermination(120)
    shape = ("canonical_key", "sequence_hint_min", "sequence_hint_max", "source_windows", "source_files", "visible_text")
    state = sc.read_state(spark, out)
    batch = collect_once(spark, landing, "s").canonical
    assert rows(state, *shape) == rows(batch, *shape)
    assert sorted(r.order for r in state.collect()) == [1, 2, 3, 4, 5]


def test_stream_baseline(spark, landing, tmp_path):
    baseline = c.project_raw(collect_once(spark, landing, "s").records, "s").filter("window_id = 1")
    out = str(tmp_path / "out")
    stream = sc.stream_raw(spark, landing, "s", baseline=baseline)
    sc.canonicalize_stream(stream, out, str(tmp_path / "check")).awaitTermination(120)
    assert rows(sc.read_state(spark, out), "visible_text") == [("Xitraの攻撃。",), ("→敵に、5ダメージ。",)]


LINES = "session_id STRING, event_group STRING, `order` BIGINT, visible_text STRING, sequence_hint_min BIGINT, first_seen_at TIMESTAMP"


def test_live_counters_equal_batch(spark, tmp_path):
    from loomlog.operators.parsing import parse_groups
    from loomlog.operators.summaries import summarize_actions

    folder, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    at = datetime(2026, 1, 1)
    first = [("s", "a", 1, "Xitraの攻撃。", 1, at), ("s", "b", 3, "Xitraのバーサク！", 1, at)]
    second = [("s", "a", 2, "→敵に、5ダメージ。", 2, at), ("s", "c", 4, "Boroの攻撃。ミス。", 1, at)]
    for part in (first, second):
        spark.createDataFrame(part, LINES).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(LINES).parquet(folder)
        live.live_actor_counts(stream, out, check).awaitTermination(120)
    versions = spark.read.parquet(out)
    assert rows(live.current_action_summary(versions)) == rows(summarize_actions(parse_groups(spark.createDataFrame(first + second, LINES))))


def test_live_range_and_updates(spark, tmp_path):
    bounds = live.LiveRange("s").begin(2)
    assert (bounds.start, bounds.end, bounds.running) == (2, None, True)
    stopped = bounds.stop(4)
    assert (stopped.start, stopped.end, stopped.running) == (2, 4, False)
    assert stopped.stop(9) == stopped
    assert (bounds.reset(5).start, bounds.reset(5).end) == (5, None)
    assert (stopped.reset(5).start, stopped.reset(5).end) == (5, 5)
    assert bounds.follow("t").start == 0 and bounds.follow("s") is bounds
    assert live.refresh_interval(5) == "250 milliseconds" and live.refresh_interval(5000) == "1000 milliseconds"
    with pytest.raises(ValueError):
        live.poll_interval(100)
    at = datetime(2026, 1, 1)
    lines = [("s", f"g{i}", i, "Xitraの攻撃→敵に、5ダメージ。", 1, at) for i in range(1, 6)]
    log = spark.createDataFrame(lines, LINES)
    folder = str(tmp_path / "in")
    log.coalesce(1).write.parquet(folder)
    published = []
    query = live.live_analysis(
        spark.readStream.schema(LINES).parquet(folder), lambda: spark.read.parquet(folder), lambda: bounds,
        published.append, str(tmp_path / "check"), ["Xitra"],
    )
    query.awaitTermination(120)
    assert len(published) == 1
    update = published[0]
    assert update.analysis.action_summary.first().total_damage == 15
    assert update.members.first().name == "Xitra"
    assert live.live_update(log, bounds, previous=update.mark) is None
    assert live.live_update(log, stopped, previous=update.mark) is not None
