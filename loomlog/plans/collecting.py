"""A collection run: snapshot files in, raw and canonical tables out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomlog.functions import fixed_values as fixed
from loomlog.operators import collection as c
from loomlog.sources.lines import canonical_documents, raw_documents
from loomlog.sources.session_store import write_store
from loomlog.sources.sessions import session_documents
from loomlog.sources.snapshots import explode_snapshot_records, scan_snapshots


@dataclass(frozen=True)
class Collected:
    records: DataFrame
    raw: DataFrame
    deduped: DataFrame
    canonical: DataFrame
    sources: DataFrame
    stats: DataFrame


def collect_once(
    spark: SparkSession,
    path: str,
    session_id: str,
    windows: Sequence[int] = (1, 2),
    slots: int = fixed.MAX_SLOTS,
    seen_at: Column | None = None,
    baseline: DataFrame | None = None,
    marker_prefix: str | None = fixed.MARKER_PREFIX,
    dedupe: bool = True,
) -> Collected:
    """Scan, cut, project, drop the baseline and duplicates, merge, number.

    The baseline goes before the text work: a record known from before is never decoded further.
    """
    records = explode_snapshot_records(scan_snapshots(spark, path, windows, slots))
    skipped = None
    kept = records
    if baseline is not None:
        kept = c.drop_baseline(records, baseline)
        skipped = c.drop_baseline(records, c.project_raw(kept, session_id))
        skipped = skipped.filter("record_index IS NOT NULL")
    raw = c.project_raw(kept, session_id, seen_at, marker_prefix)
    deduped = c.dedupe_raw(raw) if dedupe else raw
    canonical = c.assign_order(c.canonicalize(deduped))
    stats = c.collection_stats(kept, raw, deduped, canonical, skipped)
    return Collected(records, raw, deduped, canonical, c.canonical_sources(deduped), stats)


def store_session(run: Collected, root: str, manifest: DataFrame) -> None:
    """Write a run as a session folder named after its session: lines, raw records, counters and manifest, in one commit."""
    session = manifest.select("session_id").scalar()
    folder = lambda df: df.withColumn("session_folder", session)
    documents = session_documents(folder(manifest), folder(run.stats))
    lines = canonical_documents(run.canonical.withColumn("session_folder", F.col("session_id")), run.sources)
    raw = raw_documents(run.deduped.withColumn("session_folder", F.col("session_id")))
    # A run without records still has its files.
    empty = folder(run.canonical.sparkSession.range(1)).select(
        "session_folder", F.explode(F.array(F.lit("canonical_records.jsonl"), F.lit("raw_records.jsonl"))).alias("file"),
        F.lit(-1).cast("bigint").alias("place"), F.lit(None).cast("string").alias("line"),
    )
    write_store(documents.unionByName(lines).unionByName(raw).unionByName(empty), root)
