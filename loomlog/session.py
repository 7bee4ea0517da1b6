"""Session settings and the few places where the library has to touch the driver."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Lines per slice of an ordered scan. A slice is the largest run of rows one task sorts.
SLICE_ROWS = 1_000_000
# Groups above this many lines are ordered by the distributed path instead of one window partition.
HOT_GROUP_ROWS = 2_000_000


def build_session(app: str = "loomlog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, AQE with skew handling)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The JVM never compiles methods above 8000 bytes, so a stage of many patterns runs faster
        # as separate expressions than fused into one huge method.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Call-site capture costs more than building the plans here.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked of the store that it lies in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """How many bytes a file or folder holds, asked of the store that it lies in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(place).getLength()


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bound the batches that go to Python by bytes: a row may hold a whole file."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []


def delete(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


# Writes ``frame`` under a name and gives it back as it was written.
Keep = Callable[[DataFrame, str], DataFrame]
# Compression of what is stored: digests in hex stay whole in the default one.
COMPRESSION = "zstd"
# Steps free their shuffle files, and a task begins with few bytes of what an earlier step wrote: these are some thirty a row.
_STEPS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(8 << 20),
}


@contextmanager
def work_folder(spark: SparkSession, folder: str) -> Iterator[tuple[Keep, Callable[..., None]]]:
    """Steps of a long job as compressed tables: one function keeps a frame, the other lets go of some by their names.

    Meanwhile every step frees its shuffle files when it ends; Spark else keeps those of all steps until the driver happens to
    collect its garbage. What was left of a job that broke off goes first, and everything goes at the end.
    """
    def keep(frame: DataFrame, name: str) -> DataFrame:
        frame.write.option("compression", COMPRESSION).parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    def drop(*names: str) -> None:
        for name in names:
            delete(spark, f"{folder}/{name}")

    before = {key: spark.conf.get(key, None) for key in _STEPS}
    delete(spark, folder)
    try:
        for key, value in _STEPS.items():
            spark.conf.set(key, value)
        yield keep, drop
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
        delete(spark, folder)


_SCRATCH: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor can reach; in local mode a scratch one if unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is not None:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _SCRATCH:
        _SCRATCH.append(tempfile.mkdtemp(prefix="loomlog-checkpoint-"))
    return _SCRATCH[0]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give Spark the shared checkpoint folder before the first ``checkpoint()``."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder so that every later read sees the same partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
