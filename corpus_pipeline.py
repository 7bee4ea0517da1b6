"""The corpus pipeline: language ID, exact dedup, near dedup, source mixing and tokenisation of ``documents``.

Every stage works on all rows that the one before kept and hands on the columns of ``documents``; the last one gives
the token counts and digests. ``run`` writes each stage to the shared checkpoint folder and reads it back, so a lost
executor never costs more than one stage.

Every row is a document of its own: a stage decides in the row, or numbers its rows and joins its decision on that number,
never on ``doc_id``. Where one row of several stays it is the one with the smallest ``doc_id``, null last.

What a stage stores on its way is deleted when the next one begins, unless that one still reads it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.bpe import round_trip
from loomlog.llm.common import drop_stored, prepared, shared_folder, stored, table_scope
from loomlog.llm.exact import exact_groups
from loomlog.llm.langid import accepted, learn
from loomlog.llm.minhash import near_duplicates
from loomlog.llm.mixing import mix, n_words

# A language model, a near-duplicate search and a mix are no SQL; tests compare them with brute force.
ORACLE_SQL = None

# The row key that a stage joins its decision on; it is not handed on.
KEY = "__row_key"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Where the stages so far have stored tables.
_FOLDERS: list[str] = []


def _stage(work: Stage) -> Stage:
    """A stage that first deletes what stages before it have stored."""

    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_stored(prepared(spark), _FOLDERS, docs)
        with table_scope(_FOLDERS):
            return work(spark, docs, sf_dir)

    return stage


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for every row, stored so that the number holds however often it is read."""
    return stored(docs.withColumn(KEY, F.monotonically_increasing_id()), "pipeline-rows")


def _by_row(rows: DataFrame) -> DataFrame:
    """What operators see of keyed rows when each row is a document of its own: its key stands for ``doc_id``."""
    return rows.select(F.col(KEY).alias("doc_id"), "text")


def _chosen(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is in ``keys`` (``chosen_key``), without their key."""
    return rows.join(keys, rows[KEY] == keys["chosen_key"], "left_semi").drop(KEY)


def _first_of(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The one row that stays of each group (``member``: a row's key, ``of``: its group), as ``chosen_key``.

    It is the one with the smallest ``doc_id``, null last; ties fall to the text's hash, then to the row's key.
    """
    ranks = rows.select(
        KEY, F.struct(
            F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64("text").alias("text"), F.col(KEY).alias("key"),
        ).alias("rank"),
    )
    return (
        ranks.join(groups, F.col(KEY) == F.col("member"))
        .groupBy("of").agg(F.min("rank").alias("rank")).select(F.col("rank.key").alias("chosen_key"))
    )


@_stage
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: rows whose language prediction is rejected go, each by its own text."""
    return accepted(docs, learn(docs))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one row of each group of equal texts stays, also where rows repeat a ``doc_id`` or have none."""
    rows = _keyed(docs)
    groups = exact_groups(_by_row(rows))
    return _chosen(rows, _first_of(rows, groups.select(F.col("doc_id").alias("member"), F.col("keep_id").alias("of"))))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one row of each component of near duplicates stays (five-word shingles, 0.8 or more).

    Rows that repeat a ``doc_id`` or have none are compared like all others; rows without words all stay.
    """
    rows = _keyed(docs)
    groups = near_duplicates(_by_row(rows), shingle=5)
    members = groups.select(F.col("doc_id").alias("member"), F.col("component_id").alias("of"))
    return _chosen(rows, _first_of(rows, members))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: a row appears as often as the mix takes it, rounded to whole documents; others go.

    Rows that repeat a ``doc_id`` are taken one by one; rows without one have their place in the seeded order by text.
    """
    rows = _keyed(docs)
    members = rows.select(
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("doc_id"), n_words().alias("size"),
        F.array(F.col("source").cast("string")).alias("sources"), KEY,
    )
    times = F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    copies = mix(members).documents.select(F.col(KEY).alias("chosen_key"), times.alias("mix_times")).filter("mix_times > 0")
    columns = [rows[name] for name in docs.columns]
    return (
        rows.join(copies, rows[KEY] == copies["chosen_key"])
        .select(*columns, F.explode(F.sequence(F.lit(1), copies["mix_times"])).alias("__mix_copy"))
        .drop("__mix_copy")
    )


@_stage
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: token counts and digests of every document that is left."""
    return round_trip(docs)


STAGES = [
    ("language ID", keep_languages),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("byte-level BPE", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
