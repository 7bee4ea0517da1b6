"""Helpers that the corpus operators share: tables, batches of bounded size, words and their hashes."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.session import checkpoint_folder

# Bytes of text that one numpy step works on. A longer text is a step of its own.
STEP_BYTES = 2 << 20
# Bytes of one piece of a text in byte-wise arithmetic; pieces end at white space where there is any.
PIECE_BYTES = 1 << 19
SEPARATORS = b" \t\n\x0b\x0c\r"


def prepared(spark: SparkSession) -> SparkSession:
    """Bound the batches that go to Python by bytes, since a row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty): columns of other names never meet those of an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def raw_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the text's UTF-8 bytes."""
    return texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors and the driver share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Folders that tables were stored in since a scope was opened in this thread, or nothing.
_SCOPE = threading.local()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, lost executors cost nothing.

    An aggregate that a table with hot keys is joined with is stored too: adaptive execution splits a hot key of a join
    only where both sides come straight from a shuffle.
    """
    path = shared_folder(df.sparkSession, name)
    folders = getattr(_SCOPE, "folders", None)
    if folders is not None:
        folders.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def table_scope(folders: list[str]) -> Iterator[None]:
    """Note in ``folders`` where tables are stored, so that they can be taken away once nothing reads them."""
    before = getattr(_SCOPE, "folders", None)
    _SCOPE.folders = folders
    try:
        yield
    finally:
        _SCOPE.folders = before


def drop_stored(spark: SparkSession, folders: list[str], read_by: DataFrame | None = None) -> None:
    """Delete stored tables, but none that ``read_by`` still reads, and forget those that are gone."""
    used = read_by.inputFiles() if read_by is not None else []
    for folder in list(folders):
        name = folder.rsplit("/", 1)[1]
        if any(f"/{name}/" in file for file in used):
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
        folders.remove(folder)


def steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices whose ``text`` has about ``limit`` bytes; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index("text"))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin, done = 0, 0
        while begin < len(ends):
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin, done = end, int(ends[end - 1])


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column in a row, and where each value begins (one place more than values)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    places = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[places[0]:places[-1]], places - places[0]


def _random(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False
_BYTE = _random(256, 11)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 5


def _powers(count: int, base: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < count:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:count]


_POWER: list[np.ndarray] = []


def _power_tables(count: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWER or len(_POWER[0]) < count:
        made = max(count, PIECE_BYTES + 1)
        _POWER[:] = [_powers(made, _BASE), _powers(made, pow(_BASE, -1, 1 << 64))]
    return _POWER[0][:count], _POWER[1][:count]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def word_places(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end in ``data``, and the number of words before each value."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[places] = True
    begins = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return begins, ends, np.searchsorted(begins, places)


def _long_word(word: np.ndarray, table: np.ndarray) -> np.uint64:
    """What :func:`word_hashes` gives for one word, summed over pieces of it."""
    power, _ = _power_tables(PIECE_BYTES)
    total = len(word)
    for at in range(0, len(word), PIECE_BYTES):
        piece = table[word[at:at + PIECE_BYTES]]
        total += int((piece * power[:len(piece)]).sum()) * pow(_BASE, at, 1 << 64)
    return mixed(np.array([total % (1 << 64)], np.uint64))[0]


def folded_table(seed: int) -> np.ndarray:
    """Other numbers for bytes than the usual ones, A-Z counting as a-z, for :func:`word_hashes`."""
    table = _random(256, seed)
    table[65:91] = table[97:123]
    return table


def word_hashes(
    data: np.ndarray, begins: np.ndarray, ends: np.ndarray, folded: bool = False, table: np.ndarray | None = None
) -> np.ndarray:
    """A 64-bit hash of each word (``folded``: A-Z count as a-z), piece by piece so that memory stays bounded."""
    if table is None:
        table = _FOLDED if folded else _BYTE
    out = np.empty(len(begins), np.uint64)
    first = 0
    while first < len(begins):
        low = begins[first]
        last = max(first + 1, int(np.searchsorted(ends, low + PIECE_BYTES, "right")))
        high = ends[last - 1]
        if high - low > PIECE_BYTES:
            out[first] = _long_word(data[low:high], table)
            first = last
            continue
        power, inverse = _power_tables(int(high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * power[:-1], out=sums[1:])
        b, e = begins[first:last] - low, ends[first:last] - low
        out[first:last] = mixed((sums[e] - sums[b]) * inverse[b] + (e - b).astype(np.uint64))
        first = last
    return out


_CHAIN = _random(64, 23)


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of ``length`` neighbours; run ``i`` begins at ``i``."""
    count = max(0, len(hashes) - length + 1)
    out = np.zeros(count, np.uint64)
    for k in range(length):
        out += hashes[k:k + count] * _CHAIN[k]
    return mixed(out)
