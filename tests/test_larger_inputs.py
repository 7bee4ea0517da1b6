"""What is held at a time stays bounded, and the results stay the same."""

import os
import time
from functools import reduce

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from loomlog.operators import collection as c
from loomlog.plans import derived, derived_raw
from loomlog.plans.queries import QUERIES
from loomlog.session import checkpoint_folder, ensure_checkpoint_dir, work_folder
from loomlog.sources import snapshots
from loomlog.streaming import collect as sc
from loomlog.streaming.runs import RunTable
from test_collection import raw_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two days of a few hundred events."""
    path = str(tmp_path_factory.mktemp("tables"))
    kinds = F.array(*[F.lit(k) for k in ("click", "view", "purchase", "signup", "error")])
    spark.range(400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 400).alias("ts"),
        (F.col("id") % 9).alias("user_id"), F.get(kinds, (F.col("id") % 5).cast("int")).alias("event_type"),
        (F.col("id") / 3).alias("value"), F.lit("{}").alias("props"),
    ).coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def test_large_tables_are_spread_over_more_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(derived, "PART_BYTES", 300, raising=False)
    table = derived.read_table(spark, folder, "events")
    assert table.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert rows(table) == rows(spark.read.parquet(f"{folder}/events.parquet"))


def test_records_are_handed_on_in_bounded_frames(monkeypatch, spark, folder):
    monkeypatch.setattr(snapshots, "FRAME_RECORDS", 50, raising=False)
    files = snapshots.shape_snapshots(derived_raw.derived_snapshots(spark, folder)).toPandas()
    assert len(files) > 4
    frames = list(snapshots._cut_files(iter([files])))
    whole = [(f.path, *r) for f in files.itertuples() for r in snapshots.cut_records(f.content)]
    assert max(map(len, frames)) < 50 + 41 < len(whole)
    cut = pd.concat(frames)
    assert list(cut["message_bytes"]) == [r[5] for r in whole] and list(cut["path"]) == [r[0] for r in whole]
    # Batches of files are bounded by bytes, too.
    snapshots.explode_snapshot_records(derived_raw.derived_snapshots(spark, folder))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 8 << 20


def test_only_chosen_snapshot_files_are_made(spark, folder):
    every = derived_raw.derived_snapshots(spark, folder)
    odd = derived_raw.derived_snapshots(spark, folder, F.col("file_no") % 2 == 1)
    assert rows(odd) == [r for r in rows(every) if "/2_" in r[0]] and 0 < odd.count() < every.count()


def test_slices_of_hints_come_in_any_frames():
    whole = pd.DataFrame(
        [("s", key, part, value, value, nth)
         for key, part, values in (("a", 1, ["9", "10", "1a"]), ("a", 2, ["1a", "9"]), ("b", 1, ["10"]), ("c", None, ["9", "1a", "10"]))
         for nth, value in enumerate(values, 1)],
        columns=["session_id", "canonical_key", "slice", "low", "high", "nth"],
    )
    shown = lambda frames: pd.concat(list(c._slice_runs(iter(frames)))).astype(object).where(lambda x: x.notna(), None).values.tolist()
    at_once = shown([whole])
    for size in (1, 2, 5):
        assert shown([whole[n:n + size] for n in range(0, len(whole), size)]) == at_once
    assert {(r[1], r[2]) for r in at_once} == {("a", 1), ("a", 2), ("b", 1), ("c", None)}
    for key, part, values in (("a", 1, ["9", "10", "1a"]), ("c", None, ["9", "1a", "10"])):
        for side in ("low", "high"):
            found = [tuple(r[5:]) for r in at_once if (r[1], r[2], r[3]) == (key, part, side)]
            assert found == c._runs(values, side == "low")


def test_merging_shuffles_only_what_it_reads(spark, folder):
    raw = derived_raw.derived_raw(spark, folder)
    narrow = c.line_columns(raw.withColumn("raw_message_hex", F.lit("00")))
    assert not {"body", "raw_message_hex"} & set(narrow.columns)
    assert rows(c.canonicalize(c.dedupe_raw(narrow))) == rows(c.canonicalize(c.dedupe_raw(raw)))
    plan = QUERIES["raw_dedupe"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "_first" in plan and "body" not in plan.split("_first")[0]


def test_what_a_batch_brings_is_worked_out_once(spark, folder, monkeypatch):
    lookup, kept = RunTable.lookup, []

    def noted(self, wanted, before=None):
        kept.append(wanted.storageLevel.useMemory)
        return lookup(self, wanted, before)

    monkeypatch.setattr(RunTable, "lookup", noted)
    found = QUERIES["new_records_in_batches"](spark, folder)
    assert kept == 5 * [True]
    raw = derived_raw.derived_raw(spark, folder).select("session_id", "raw_record_id").distinct()
    assert rows(found, "session_id", "raw_record_id") == rows(raw)


def test_a_batch_leaves_only_its_runs(spark, tmp_path):
    path = str(tmp_path / "canonical")
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    pins = lambda: sum(len(names) for _, _, names in os.walk(checkpoint_folder(spark).removeprefix("file:")))
    spark.sparkContext._jvm.System.gc()
    ensure_checkpoint_dir(spark)
    before, pinned = disk.getAllFiles().size(), pins()
    for batch, hints in enumerate((["9", "10", "1a", "10"], ["9", "11"])):
        sc.upsert_batch(raw_rows(spark, hints, start=3 * batch), batch, path)
    assert pins() == pinned
    assert sorted(p.name for p in (tmp_path / "canonical").iterdir()) == ["lasts", "lines", "raw", "work"]
    assert not list((tmp_path / "canonical" / "work").iterdir())
    # Shuffle files of the steps are gone without a collection of garbage; removing them takes a moment.
    for _ in range(100):
        if disk.getAllFiles().size() <= before:
            break
        time.sleep(0.1)
    assert disk.getAllFiles().size() <= before
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != str(8 << 20)
    stored = spark.read.parquet(f"{path}/lines/batch=0/rows")
    assert not {"schema_version", "canonical_record_id"} & set(stored.columns)
    state = sc.read_state(spark, path)
    whole = c.assign_order(c.canonicalize(c.dedupe_raw(raw_rows(spark, ["9", "10", "1a", "10", "11"]))))
    shape = ("schema_version", "canonical_record_id", "session_id", "visible_text", "sequence_hint_min", "sequence_hint_max")
    assert rows(state, *shape, "record_count", "order") == rows(whole, *shape, "record_count", "order")
    assert rows(sc.read_state(spark, path, shape)) == rows(whole, *shape)


def test_lines_kept_on_the_way_are_the_same(spark, tmp_path):
    texts = {"mixed": ["9", "1a", "10", "9"], "numbers": ["10", "9"], "none": [None, None], "hex": ["00A1", "0010"]}
    raw = reduce(lambda a, b: a.unionByName(b), [raw_rows(spark, hints, text) for text, hints in texts.items()])
    with work_folder(spark, str(tmp_path / "work")) as (keep, drop):
        kept = c.canonicalize(raw, keep=keep)
        assert sorted(p.name for p in (tmp_path / "work").iterdir()) == ["folded", "settled"]
        assert rows(kept) == rows(c.canonicalize(raw))
        drop("folded", "settled")
        assert not list((tmp_path / "work").iterdir())
