"""Collection as a stream: the batch operators on micro-batches, with everything ever seen kept in tables.

Under one folder lie three tables of runs (:mod:`loomlog.streaming.runs`), to which each batch adds one:

* ``lines``: canonical lines that the batch made or changed;
* ``raw``: ids of the raw records that the batch brought for the first time;
* ``lasts``: the last order number of the sessions that the batch gave numbers to.

A batch looks up only its own keys, in runs before its own, and writes its own run anew when it is run again, so the result
is exactly once. Nothing is ever forgotten: a record may come any time later and still merges, or is known and skipped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlog.functions import fixed_values as fixed
from loomlog.operators import collection as c
from loomlog.operators.collection import CANONICAL_KEYS, RAW_KEYS
from loomlog.operators.scans import dense_order
from loomlog.session import Keep, path_exists, work_folder
from loomlog.sources.snapshots import explode_snapshot_records, stream_rewritten, stream_snapshots
from loomlog.streaming.runs import FANOUT, RunTable

# Columns of a line that follow from others and are not stored.
DERIVED = ("schema_version", "canonical_record_id")


def stream_raw(
    spark: SparkSession,
    landing: str,
    session_id: str,
    baseline: DataFrame | None = None,
    windows: Sequence[int] = (1, 2),
    slots: int = fixed.MAX_SLOTS,
    files_per_batch: int = 1000,
    in_place: bool = False,
    listings: str | None = None,
) -> DataFrame:
    """Raw records of the snapshots that land in a folder; baseline records never come out.

    ``in_place``: files are rewritten, and come again as often as they change (``files_per_batch`` has no meaning then).
    Records that were read before come out again; :func:`upsert_batch` knows them by id, however late they are. ``listings`` is
    a folder for what is known of many such files, see :func:`loomlog.sources.changed_files.stream_changes`.
    """
    if in_place:
        files = stream_rewritten(spark, landing, windows, slots, listings)
    else:
        files = stream_snapshots(spark, landing, windows, slots, files_per_batch)
    records = explode_snapshot_records(files)
    if baseline is not None:
        records = c.drop_baseline(records, baseline)
    return c.project_raw(records, session_id)


def _latest(versions: DataFrame) -> DataFrame:
    fields = [n for n in versions.columns if n not in (*CANONICAL_KEYS, *DERIVED)]
    latest = F.max_by(F.struct(*fields), F.col("batch")).alias("_v")
    return versions.groupBy(*CANONICAL_KEYS).agg(latest).select(*CANONICAL_KEYS, "_v.*")


def _lines(path: str, fanout: int = FANOUT) -> RunTable:
    return RunTable(f"{path}/lines", tuple(CANONICAL_KEYS), _latest, fanout)


def _ids(path: str, fanout: int = FANOUT) -> RunTable:
    return RunTable(f"{path}/raw", tuple(RAW_KEYS), lambda rows: rows.select(*RAW_KEYS).distinct(), fanout)


def _lasts(path: str, fanout: int = FANOUT) -> RunTable:
    last = lambda rows: rows.groupBy("session_id").agg(F.max("last").alias("last"))
    return RunTable(f"{path}/lasts", ("session_id",), last, fanout)


def read_state(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame | None:
    """The canonical lines as of now: the latest version of every key, or None when nothing is stored.

    With ``columns`` only these are read and shuffled.
    """
    lines = _lines(path)
    if columns is not None:
        wanted = {*CANONICAL_KEYS, "batch", *columns}
        pruned = lambda rows: _latest(rows.select(*[n for n in rows.columns if n in wanted]))
        lines = replace(lines, settle=pruned)
    state = lines.read(spark)
    if state is None:
        return None
    state = state.withColumns({"schema_version": F.lit(c.CANONICAL_VERSION), "canonical_record_id": F.col("canonical_key")})
    return state.select(*columns) if columns is not None else state


def new_records(records: DataFrame, batch: int, path: str, keep: Keep | None = None) -> DataFrame:
    """The first arrivals of those of a batch's records that no batch before it brought; ``keep`` writes the known keys."""
    known = _ids(path).lookup(records, batch)
    return c.dedupe_raw(records, known if known is None or keep is None else keep(known, "known"))


def upsert_batch(raw: DataFrame, batch: int, path: str, fanout: int = FANOUT) -> None:
    """Merge one micro-batch into the canonical lines.

    The batch is read once. Only lines it touches are read back; new lines get the next order numbers of their
    session. ``fanout`` says how many runs merge into one. What it works out on the way lies in a folder of its own beside the
    tables, step by step: there are rows of one or two steps at a time.
    """
    spark = raw.sparkSession
    lines, ids, lasts = _lines(path, fanout), _ids(path, fanout), _lasts(path, fanout)
    with work_folder(spark, f"{path}/work/batch={batch}") as (keep, drop):
        for table in (lines, ids, lasts):
            table.merge(spark, batch)
        fresh = keep(new_records(keep(c.line_columns(raw), "brought"), batch, path, keep), "fresh")
        drop("brought", "known")
        at_most = fresh.count()
        # A batch that broke off is run again as a whole, and does not look into its own runs.
        ids.write(fresh.select(*RAW_KEYS), batch, at_most)
        touched = c.valid_records(fresh).select("session_id", c.line_key().alias("canonical_key"))
        state = lines.lookup(touched, batch)
        merged = c.canonicalize(fresh, None if state is None else keep(state, "state"), keep=keep).drop(*DERIVED)
        last = lasts.lookup(fresh.select("session_id"), batch)
        last = None if last is None else keep(last.withColumnRenamed("last", "_last"), "last")
        drop("fresh", "state")
        numbered = dense_order(
            merged.filter(F.col("order").isNull()).drop("order"), ["first_arrival", "canonical_key"], ["session_id"], "order",
            keep=keep,
        )
        if last is not None:
            numbered = numbered.join(last, "session_id", "left").withColumn(
                "order", F.col("order") + F.coalesce(F.col("_last"), F.lit(0))
            ).drop("_last")
        version = merged.filter(F.col("order").isNotNull()).unionByName(numbered)
        written = lines.write(version.withColumn("batch", F.lit(batch).cast("bigint")), batch, at_most)
        ends = (version if written is None else written).groupBy("session_id").agg(F.max("order").alias("last"))
        lasts.write(ends, batch, at_most)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write what is current to a new folder, as a base before all batches of a query that goes on there."""
    for table, to in ((_lines(path), _lines(target)), (_ids(path), _ids(target)), (_lasts(path), _lasts(target))):
        rows = table.read(spark)
        if rows is None:
            return
        if "batch" in rows.columns:
            rows = rows.withColumn("batch", F.lit(-1).cast("bigint"))
        to.write(rows, None, rows.count())


def canonicalize_stream(raw: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep the canonical lines under ``path`` up to date. Without ``interval`` it runs what is there and ends.

    A new checkpoint counts its batches from 0, so it must not meet the batches of another one: go on in a compacted
    folder.
    """
    spark = raw.sparkSession
    if not path_exists(spark, f"{checkpoint}/metadata") and _lines(path).is_used(spark):
        raise ValueError(f"{path} holds the batches of another checkpoint: compact it to a new folder first")
    writer = (
        raw.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda frame, batch: upsert_batch(frame, batch, path))
    )
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
