"""Stored state as runs: what batches wrote, merged in levels, with a filter that tells where a few keys can be.

A table is a folder of runs. Each batch writes one; ``fanout`` neighbouring runs of a level merge into one of the next, so
after n batches there are about ``fanout * log(n)`` of them and a row is rewritten ``log(n)`` times. Within a run, rows lie
in buckets of the hash of their keys, as many as its size asks for. Beside them lies a bitmap of the hashes that occur, 16
bits or more per row: a lookup asks the bitmaps first and then opens only buckets that can hold one of its keys. So keys
that were never seen cost hardly any reading, and k old ones at most k buckets (and about a sixteenth of the others'
chances) of each run, however long the history is. The bitmaps are read whole: two to four bytes for each stored row.

A run counts when its bitmap is complete, which is written last. Only batches before the one at hand are merged: Structured
Streaming never runs those again. Runs that a merge replaces go when its result is merged too, so readers finish in peace.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomlog.session import COMPRESSION, children, delete, path_exists

FANOUT = 8
# Bits of one bitmap (what ``bitmap_construct_agg`` makes) and rows that fill it to a sixteenth.
SLOT_BITS = 32768
SLOT_ROWS = SLOT_BITS // 16
# Bitmaps that share a bucket: 262,144 rows.
BUCKET_SLOTS = 128


@dataclass(frozen=True)
class Run:
    """A complete run of the batches from ``begin`` to before ``end``; the base has -1 to 0. Without slots it is empty."""

    folder: str
    begin: int
    end: int
    slots: int


def _power(least: int) -> int:
    return 1 << max(0, least - 1).bit_length()


def _parquet(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    # Folder names are no columns here; several roots with such names would else be refused.
    return spark.read.option("recursiveFileLookup", "true").parquet(*folders)


def _bit(keys: Sequence[str], slots: Column | int) -> Column:
    """The bit of a row's keys among all bits of a run."""
    bits = slots * SLOT_BITS
    return F.pmod(F.xxhash64(*keys), F.lit(bits) if isinstance(bits, int) else bits)


@dataclass(frozen=True)
class RunTable:
    """Rows under ``path`` by ``keys``; ``settle`` is what remains of the rows that several runs hold of a key."""

    path: str
    keys: tuple[str, ...]
    settle: Callable[[DataFrame], DataFrame]
    fanout: int = FANOUT
    bucket_slots: int = BUCKET_SLOTS

    def _folder(self, begin: int, end: int) -> str:
        name = "base=0" if begin < 0 else f"batch={begin}" if end == begin + 1 else f"merged={begin}-{end}"
        return f"{self.path}/{name}"

    def _runs(self, spark: SparkSession) -> tuple[list[Run], list[int]]:
        """All complete runs, and the batches whose run is not complete."""
        complete, broken = [], []
        for name in children(spark, self.path):
            kind, _, value = name.partition("=")
            if kind not in ("base", "batch", "merged"):
                continue
            numbers = [int(n) for n in value.split("-")]
            begin, end = (-1, 0) if kind == "base" else numbers if kind == "merged" else (numbers[0], numbers[0] + 1)
            folder = self._folder(begin, end)
            slots = [n.partition("=")[2] for n in children(spark, folder) if n.startswith("filter=")]
            if slots and path_exists(spark, f"{folder}/filter={slots[0]}/_SUCCESS"):
                complete.append(Run(folder, begin, end, int(slots[0])))
            elif kind != "merged":
                broken.append(begin)
        return complete, broken

    def cover(self, spark: SparkSession, before: int | None = None) -> list[Run]:
        """The fewest runs that hold everything before a batch (all, if None). A run that broke off is an error."""
        complete, broken = self._runs(spark)
        chosen: list[Run] = []
        for run in sorted(complete, key=lambda r: r.begin - r.end):
            inside = any(c.begin <= run.begin and run.end <= c.end for c in chosen)
            if not inside and (before is None or run.end <= before or run.begin < 0):
                chosen.append(run)
        for batch in broken:
            # Nobody runs batches before this one again; without one at hand, the last may still be running.
            if before is not None and batch < before and not any(c.begin <= batch < c.end for c in chosen):
                raise ValueError(f"{self.path}: batch {batch} is not complete")
        return sorted(chosen, key=lambda r: r.begin)

    def is_used(self, spark: SparkSession) -> bool:
        """Whether batches, not only a base, are stored."""
        return any(n.startswith(("batch=", "merged=")) for n in children(spark, self.path))

    def _rows(self, spark: SparkSession, runs: Sequence[Run]) -> DataFrame | None:
        filled = [f"{r.folder}/rows" for r in runs if r.slots]
        # A run holds a key once, so there is nothing to settle before the rows are shuffled.
        return self.settle(_parquet(spark, filled).repartition(*self.keys)) if filled else None

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The settled rows of all runs, or None when there are none."""
        return self._rows(spark, self.cover(spark, before))

    def lookup(self, wanted: DataFrame, before: int | None = None) -> DataFrame | None:
        """The settled rows whose keys are in ``wanted``; None when no bucket can hold one.

        The driver sees the names of buckets to open, which it would list in any case.
        """
        spark = wanted.sparkSession
        runs = [r for r in self.cover(spark, before) if r.slots]
        if not runs:
            return None
        # A run's number stands for its folder, whose name is longer than a row's keys.
        places = F.array(*[F.struct(F.lit(n).alias("run"), F.lit(r.slots).cast("long").alias("slots")) for n, r in enumerate(runs)])
        bits = (
            wanted.select(*self.keys).distinct()
            .select(*self.keys, F.inline(places))
            .select("run", _bit(self.keys, F.col("slots")).alias("bit"))
            .select("run", F.expr(f"bit div {SLOT_BITS}").alias("slot"), (F.col("bit") % SLOT_BITS).cast("int").alias("place"))
        )
        number = F.array_position(F.array(*[F.lit(r.folder) for r in runs]), F.col("run")) - 1
        filters = _parquet(spark, [f"{r.folder}/filter={r.slots}" for r in runs]).withColumn("run", number.cast("int"))
        byte = F.conv(F.hex(F.expr("substring(bitmap, place div 8 + 1, 1)")), 16, 10).cast("int")
        held = F.expr("shiftright(byte, place % 8) & 1") == 1
        found = (
            bits.join(filters, ["run", "slot"]).withColumn("byte", byte).filter(held).select("run", "bucket").distinct().collect()
        )
        if not found:
            return None
        rows = _parquet(spark, sorted(f"{runs[f.run].folder}/rows/bucket={f.bucket}" for f in found))
        return self.settle(rows.join(wanted.select(*self.keys).distinct(), list(self.keys), "left_semi"))

    def write(self, rows: DataFrame, batch: int | None, at_most: int) -> DataFrame | None:
        """Write the run of a batch anew (None: the base) and give what it holds; ``at_most`` bounds its rows."""
        begin = -1 if batch is None else batch
        return self._write(rows, begin, begin + 1, _power(-(-at_most // SLOT_ROWS)))

    def _write(self, rows: DataFrame, begin: int, end: int, slots: int) -> DataFrame | None:
        spark, folder = rows.sparkSession, self._folder(begin, end)
        delete(spark, folder)
        bucket = F.expr(f"bit div {SLOT_BITS * self.bucket_slots}").cast("int")
        (
            rows.withColumn("bit", _bit(self.keys, slots)).withColumn("bucket", bucket)
            .repartition(max(1, slots // self.bucket_slots), "bucket").sortWithinPartitions("bucket", "bit").drop("bit")
            .write.option("compression", COMPRESSION).partitionBy("bucket").parquet(f"{folder}/rows")
        )
        if not any(n.startswith("bucket=") for n in children(spark, f"{folder}/rows")):
            spark.range(0).write.parquet(f"{folder}/filter=0")
            return None
        stored = _parquet(spark, [f"{folder}/rows"])
        bits = stored.select(_bit(self.keys, slots).alias("bit"))
        (
            bits.groupBy(F.expr(f"bit div {SLOT_BITS}").alias("slot"))
            .agg(F.bitmap_construct_agg(F.col("bit") % SLOT_BITS).alias("bitmap"))
            .select(
                F.lit(folder).alias("run"), "slot", F.expr(f"slot div {self.bucket_slots}").cast("int").alias("bucket"), "bitmap"
            )
            .write.parquet(f"{folder}/filter={slots}")
        )
        return stored

    def merge(self, spark: SparkSession, before: int) -> None:
        """Merge what batches before this one have written, level by level; blocks that are merged already stay."""
        part = 1
        while part * self.fanout <= before:
            width = part * self.fanout
            blocks: dict[int, list[Run]] = {}
            for run in self.cover(spark, before):
                if run.begin >= 0 and run.end - run.begin == part:
                    blocks.setdefault(run.begin // width * width, []).append(run)
            for begin, parts in blocks.items():
                if begin + width <= before:
                    self._merge(spark, begin, begin + width, parts)
            part = width

    def _merge(self, spark: SparkSession, begin: int, end: int, parts: Sequence[Run]) -> None:
        rows = self._rows(spark, parts)
        if rows is None:
            spark.range(0).write.mode("overwrite").parquet(f"{self._folder(begin, end)}/filter=0")
        else:
            self._write(rows, begin, end, _power(sum(r.slots for r in parts)))
        # What the merges of the parts replaced: nobody has chosen it since.
        for run in self._runs(spark)[0]:
            if any(p.begin <= run.begin and run.end <= p.end and run.end - run.begin < p.end - p.begin for p in parts):
                delete(spark, run.folder)
