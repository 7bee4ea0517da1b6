"""Watched files that are rewritten in place, in polls and as a stream."""

import os
import random

import pytest

from pyspark.sql import functions as F

from conftest import rows
from loomlog.plans import queries
from loomlog.plans.derived import derived_log
from loomlog.sources import changed_files as cf
from loomlog.streaming import collect as sc
from test_collection import put, record, snapshot


def known(time, size):
    return [time, size]


@pytest.mark.parametrize("before, now, found", [
    ({}, {}, []),
    ({}, {"a": known(1, 1)}, [("a", "changed")]),
    ({"a": known(1, 1)}, {"a": known(1, 1)}, []),
    ({"a": known(1, 1)}, {"a": known(2, 1)}, [("a", "changed")]),
    ({"a": known(1, 1)}, {"a": known(1, 2)}, [("a", "changed")]),
    ({"a": known(1, 1)}, {}, [("a", "missing")]),
    ({"gone": known(1, 1)}, {"y/1": known(5, 1), "x/2": known(5, 1), "z": known(4, 0)},
     [("z", "changed"), ("y/1", "changed"), ("x/2", "changed"), ("gone", "missing")]),
])
def test_changes(before, now, found):
    assert list(cf.changes(before, now)) == found


def test_tasks_take_files_up_to_their_bounds(monkeypatch, tmp_path):
    reader = cf.ChangedFilesReader(str(tmp_path), cf.WATCHED)
    monkeypatch.setattr(cf, "FILES_PER_TASK", 3)
    monkeypatch.setattr(cf, "BYTES_PER_TASK", 100)
    end = {f"{n}": known(n, size) for n, size in enumerate([10, 10, 10, 10, 95, 500, 1])}
    shares = [[int(path) for path, _ in s.files] for s in reader.partitions({}, end)]
    assert shares == [[0, 1, 2], [3], [4], [5], [6]]
    assert reader.partitions(end, end) == []


def test_offsets_tell_watched_files_only(tmp_path):
    for name in ("1_0.log", "2_19.log", "3_0.log", "1_20.log", "1_1.log.tmp", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    offset = cf.ChangedFilesReader(str(tmp_path), cf.WATCHED).latestOffset()
    assert [os.path.basename(p) for p in offset] == ["1_0.log", "2_19.log"]
    assert cf.ChangedFilesReader(str(tmp_path / "none"), cf.WATCHED).latestOffset() == {}


def polled(spark, folder, out, check):
    """One poll: everything that changed, appended to a table."""
    writer = cf.stream_changes(spark, folder).writeStream.option("checkpointLocation", check).trigger(availableNow=True)
    writer.format("parquet").start(out).awaitTermination(120)
    if not os.path.exists(out):
        return []
    found = spark.read.parquet(out).selectExpr("element_at(split(path, '/'), -1) AS name", "cast(content AS string) AS text", "change")
    return rows(found)


def test_a_rewritten_file_comes_again(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    put(folder, "1_0.log", b"one", 1_000)
    put(folder, "1_1.log", b"two", 1_000)
    first = [("1_0.log", "one", "changed"), ("1_1.log", "two", "changed")]
    assert polled(spark, folder, out, check) == first
    # Nothing has changed: a query that goes on from the checkpoint reads nothing.
    assert polled(spark, folder, out, check) == first
    put(folder, "1_1.log", b"new", 1_002)
    second = sorted([*first, ("1_1.log", "new", "changed")], key=str)
    assert sorted(polled(spark, folder, out, check), key=str) == second
    os.remove(folder + "/1_0.log")
    third = sorted([*second, ("1_0.log", None, "missing")], key=str)
    assert sorted(polled(spark, folder, out, check), key=str) == third
    # Back with its old time and size.
    put(folder, "1_0.log", b"one", 1_000)
    assert sorted(polled(spark, folder, out, check), key=str) == sorted([*third, first[0]], key=str)


def test_collection_of_a_rotating_file(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    for number, text in enumerate(("まえ", "あと", "つぎ")):
        kept = [record("まえ", "e0", "1")] if number else []
        put(folder, "1_0.log", snapshot(*kept, record(text, f"e{number}", "1")), 1_000 + number)
        stream = sc.stream_raw(spark, folder, "s", in_place=True)
        sc.canonicalize_stream(stream, out, check).awaitTermination(120)
    assert rows(sc.read_state(spark, out), "visible_text", "order") == [("あと", 2), ("つぎ", 3), ("まえ", 1)]


def poll_all(reader, start):
    """One poll of a reader: its offset and what its tasks give, after the planning of a batch."""
    end = reader.latestOffset()
    shares = reader.partitions(start, end)
    found = [(r[0].removeprefix("file:"), r[4], r[3]) for s in shares for r in reader.read(s)]
    return end, shares, found


def test_stored_listings_tell_the_same_changes(monkeypatch, tmp_path):
    monkeypatch.setattr(cf, "FILES_PER_BLOCK", 3)
    rng = random.Random(4)
    folder, listings = tmp_path / "log", tmp_path / "listings"
    plain, listed = cf.ChangedFilesReader(str(folder), cf.WATCHED), cf.ListedFilesReader(str(folder), cf.WATCHED, str(listings))
    assert listed.latestOffset() == {} and listed.partitions({}, {}) == []
    names = [f"{d}{1 + n % 2}_{n}.log" for d in ("", "a/", "a/b/", "a-b/", "b/", "b/a/b/") for n in range(4)]
    before, start, files = {}, {}, {}
    for turn in range(25):
        for name in rng.sample(names, rng.choice([0, 1, 2, 12])):
            if name in files and rng.random() < 0.5:
                os.remove(folder / name)
                del files[name]
            else:
                files[name] = f"{turn}".encode()
                put(str(folder / name).rpartition("/")[0], name.rpartition("/")[2], files[name], 1_000 + turn)
        if turn == 20:
            for name in files:
                os.remove(folder / name)
            files = {}
        now = plain.latestOffset()
        expected = [(p, how) for p, how in cf.changes(before, now)]
        end, shares, found = poll_all(listed, start)
        assert sorted((p, how) for p, how, _ in found) == sorted(expected)
        assert all(text == files[p.removeprefix(f"{folder}/")] for p, how, text in found if how == "changed")
        # The offset has one size, equal states have equal offsets, and a task compares a bounded number of paths.
        assert end == ({} if not files else {"listing": end["listing"]}) and (end == start) == (now == before)
        assert all(len(list(listed.read(s))) <= 2 * 3 for s in shares)
        # A batch that is run again from its offsets, by a reader that has not polled, which also keeps what it needs.
        again = cf.ListedFilesReader(str(folder), cf.WATCHED, str(listings))
        again.commit(start)
        assert again.partitions(start, end) == shares
        listed.commit(end)
        kept = {b.digest for b in listed._index(end)}
        assert {p.name for p in listings.rglob("*") if p.is_file()} == kept | ({f"{end['listing']}.index"} if end else set())
        before, start = now, end
    with pytest.raises(ValueError):
        listed.partitions(before or {"a": [1, 1]}, {"listing": "x"})
    with pytest.raises(ValueError):
        plain.partitions({"listing": "x"}, before)


def test_listings_that_a_batch_may_need_are_kept(monkeypatch, tmp_path):
    monkeypatch.setattr(cf, "FILES_PER_BLOCK", 1)
    folder, listings = str(tmp_path / "log"), str(tmp_path / "listings")
    new = lambda: cf.ListedFilesReader(folder, cf.WATCHED, listings)
    texts = lambda reader, start, end: sorted(r[3] for s in reader.partitions(start, end) for r in reader.read(s))

    def polled(reader, number):
        put(folder, f"1_{number}.log", b"%d" % number, 1_000 + number)
        return reader.latestOffset()

    reader = new()
    first = polled(reader, 0)
    assert texts(reader, {}, first) == [b"0"]
    # The end of the next batch is polled, then a poll reports progress; only then the batch before it counts as finished.
    second, _ = polled(reader, 1), polled(reader, 2)
    reader.commit(first)
    assert texts(reader, first, second) == [b"1"]
    # It breaks off; the next process polls before that batch is run again, and goes on from there.
    reader = new()
    third = polled(reader, 3)
    assert texts(reader, first, second) == [b"1"]
    polled(reader, 4)
    reader.commit(second)
    assert texts(reader, second, third) == [b"2", b"3"]
    # A state that comes back is the end of a batch once more.
    fourth = reader.latestOffset()
    reader.commit(third)
    assert texts(reader, third, fourth) == [b"4"]
    os.remove(f"{folder}/1_4.log")
    assert reader.latestOffset() == third
    reader.commit(fourth)
    assert [r[4] for s in reader.partitions(fourth, third) for r in reader.read(s)] == ["missing"]


def test_few_changes_open_few_blocks(monkeypatch, tmp_path):
    monkeypatch.setattr(cf, "FILES_PER_BLOCK", 4)
    for n in range(40):
        put(str(tmp_path / "log" / f"{n // 4}"), f"1_{n % 4}.log", b"x", 1_000)
    reader = cf.ListedFilesReader(str(tmp_path / "log"), cf.WATCHED, str(tmp_path / "listings"))
    start, shares, found = poll_all(reader, {})
    assert len(shares) == 10 and len(found) == 40
    stored = {p for p in (tmp_path / "listings").rglob("*")}
    assert poll_all(reader, start) == (start, [], []) and {p for p in (tmp_path / "listings").rglob("*")} == stored
    put(str(tmp_path / "log" / "7"), "1_2.log", b"new", 1_002)
    end, shares, found = poll_all(reader, start)
    assert len(shares) == 1 and [(p.rpartition("/")[2], text) for p, _, text in found] == [("1_2.log", b"new")]
    # One block and the index are new.
    assert len({p for p in (tmp_path / "listings").rglob("*")} - stored) == 2
    monkeypatch.setattr(cf, "BYTES_PER_TASK", 2)
    assert len(poll_all(reader, {})[1]) >= 20


def test_a_collection_goes_on_with_stored_listings(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    for number, text in enumerate(("まえ", "あと", "つぎ", None)):
        if text:
            kept = [record("まえ", "e0", "1")] if number else []
            put(folder, "1_0.log", snapshot(*kept, record(text, f"e{number}", "1")), 1_000 + number)
        stream = sc.stream_raw(spark, folder, "s", in_place=True, listings=f"file://{tmp_path}/listings")
        sc.canonicalize_stream(stream, out, check).awaitTermination(120)
    assert rows(sc.read_state(spark, out), "visible_text", "order") == [("あと", 2), ("つぎ", 3), ("まえ", 1)]
    # The last poll found nothing, so there is no batch of its own; an offset names its listing.
    offsets = sorted(p.name for p in (tmp_path / "check" / "offsets").iterdir() if not p.name.startswith("."))
    assert offsets == ["0", "1", "2"]
    assert "1_0.log" not in (tmp_path / "check" / "offsets" / "2").read_text()


def test_the_query_holds_no_paths_in_its_offsets(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "checkpoint_folder", lambda _: f"file://{tmp_path}")
    kinds = F.array(*[F.lit(k) for k in ("click", "view", "purchase", "signup", "error")])
    spark.range(800).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 400).alias("ts"),
        (F.col("id") % 9).alias("user_id"), F.get(kinds, (F.col("id") % 5).cast("int")).alias("event_type"),
        (F.col("id") / 3).alias("value"), F.lit("{}").alias("props"),
    ).coalesce(1).write.parquet(f"{tmp_path}/in/events.parquet")
    found = queries.QUERIES["rewritten_snapshots"](spark, f"{tmp_path}/in")
    assert found.count() == derived_log(spark, f"{tmp_path}/in").count()
    offsets = [p.read_text() for p in tmp_path.glob("rotating-*/check/offsets/*") if not p.name.startswith(".")]
    assert len(offsets) == 2 and not any(".log" in text for text in offsets)
