"""Exact deduplication through an extendible-hash index on shared files.

A text's key is a 64-bit hash of its normalised form. The directory names buckets by the first bits of keys. It starts
with one bucket and doubles: as long as a bucket holds more keys than ``capacity``, it splits into two by one more bit, up
to ``DEPTH`` bits. A key counts once, however many rows have it, so a hot group never fills a bucket.

Rows are first put together into partial groups, in ``SALTS`` parts of a text, so that a text in a third of all rows
reaches its owner as a few rows. The directory routes partial groups to their bucket; owner tasks take ranges of buckets
and keys. Inside a bucket, the texts of one key form a chain: the owner walks it in the order of bytes and compares each
text with the one before; where they differ, the next entry begins. An entry is what the query's rows are read from:
the row that stays and the number of rows. Entries of a key are numbered in the order of their smallest ``doc_id``. The
index is written to the shared folder, sorted by bucket and key; rows look theirs up by bucket, key, and the digest of
the text along the chain.

Nulls count as empty, so null and empty texts are equal. Rows with a null ``doc_id`` never name a group unless no other
row has the text; then ``keep_id`` is null and all of them are kept. Rows that repeat a ``doc_id`` are kept or dropped
together. An empty table gives an empty index. Texts are compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.llm.common import stored, texts

CAPACITY = 100_000
# A directory has at most 2 ** DEPTH slots: the only table here that is broadcast, at most 65,536 rows of 12 bytes.
DEPTH = 16
# Partial groups of one text at most.
SALTS = 16


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]+", " ")


def _slot(key: Column, depth: int = DEPTH) -> Column:
    """The first ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth)


def directory(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The directory after all splits: ``slot``, and the ``bucket`` and ``depth`` that it points to.

    A bucket of a depth exists where the bucket one bit shorter is overfull and it is not (or no bit is left).
    """
    slots = entries.groupBy(_slot(F.col("key")).alias("slot")).agg(F.count(F.lit(1)).alias("entries"))
    levels = slots.select(
        "slot", "entries", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("depth")
    ).withColumn("bucket", F.expr(f"shiftright(slot, {DEPTH} - depth)"))
    # Fewer than twice as many as there are slots, so they are sent to all tasks.
    overfull = levels.groupBy("depth", "bucket").agg(F.sum("entries").alias("held")).filter(F.col("held") > capacity)
    # Whatever lies below a bucket that is not overfull fits as well, so the depth is the number of overfull levels.
    return (
        levels.join(F.broadcast(overfull), ["depth", "bucket"], "left")
        .groupBy("slot")
        .agg(F.least(F.count("held"), F.lit(DEPTH)).cast("int").alias("depth"))
        .withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {DEPTH} - depth), {DEPTH} - depth)"))
        .select("slot", "bucket", "depth")
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, normalised ``text`` and its ``key``."""
    return texts(docs).select("doc_id", normalised().alias("text")).withColumn("key", F.xxhash64("text"))


def _routed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the ``bucket`` that the directory names for their key."""
    return rows.join(F.broadcast(found.select("slot", "bucket")), _slot(F.col("key")) == F.col("slot")).drop("slot")


def _index(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The entries of keyed rows, made by the owners of the directory's buckets and stored in their order."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    partial = rows.groupBy("key", "text", salt).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    # All that follows finds a key's rows where this puts them: nothing is shuffled again.
    owned = _routed(partial.drop("salt"), found).repartitionByRange("bucket", "key")
    chain = W.partitionBy("bucket", "key")
    walk = chain.orderBy("text")
    entries = (
        owned.withColumn("next", F.coalesce(F.col("text") != F.lag("text").over(walk), F.lit(False)).cast("int"))
        .withColumn("entry", F.sum("next").over(walk.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("text_sha256", F.sha2("text", 256))
        .groupBy("bucket", "key", "entry", "text_sha256")
        .agg(F.min("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
        .withColumn("chain", F.row_number().over(chain.orderBy(F.asc_nulls_last("keep_id"), "text_sha256")) - 1)
    )
    return stored(
        entries.sortWithinPartitions("bucket", "key", "chain")
        .select("bucket", "key", "chain", "text_sha256", "keep_id", "group_size"),
        "exact-index",
    )


def _directory_of(rows: DataFrame, capacity: int) -> DataFrame:
    """The directory of keyed rows, stored beside the index; only keys are shuffled for it."""
    return stored(directory(rows.select("key").distinct(), capacity), "exact-directory")


def index(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One entry per normalised text: ``bucket``, ``key``, ``chain``, ``text_sha256``, ``keep_id``, ``group_size``.

    Stored on shared files in the order of buckets and keys, one task per range of buckets.
    """
    rows = _keyed(docs)
    return _index(rows, _directory_of(rows, capacity))


def exact_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per row the row that stays, the size of its group, and the digest of its normalised text: its entry in the index."""
    rows = _keyed(docs)
    found = _directory_of(rows, capacity)
    entries = _index(rows, found).select("bucket", "key", "text_sha256", "keep_id", "group_size")
    sought = _routed(rows.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256")), found)
    return sought.join(entries, ["bucket", "key", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256",
    )
