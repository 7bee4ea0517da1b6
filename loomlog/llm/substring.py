"""Removal of repeated passages with fixed-block anchors.

A passage is a run of ``WINDOW`` words. Whichever way it lies in a document, it holds one whole block of ``BLOCK`` words
of that document's fixed blocks (words 0-24, 25-49, ...). So the blocks of documents are indexed with the smallest
``doc_id`` that has them, every rolling window of ``BLOCK`` words of the other documents probes the index, and a hit
is extended: all passages around it are looked up among the passages of the indexed documents, which keep the smallest
``doc_id`` too. Passages found side by side join to the maximal repeat. No pairs of documents are made anywhere.

Most text repeats nowhere, so blocks and probes are limited beforehand to places that can matter: in each passage the
least hash of ``GRAM`` words is marked. Equal passages have equal marks, so a passage none of whose marks is in another
document cannot be repeated. Whole copies of a smaller document (equal word sequences) are settled first, as all their
passages repeat there, and take no further part.

Null texts have no words. A null ``doc_id`` is smaller than none and no document is smaller than it: its words stay and
remove nothing. Rows that repeat a ``doc_id`` count as one document that cannot repeat itself. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import byte_column, raw_texts, run_hashes, steps, stored, word_hashes, word_places

WINDOW, BLOCK, GRAM = 50, 25, 13
_REACH = WINDOW - GRAM + 1
_THIN = _REACH // 2

SKETCH = "doc_id long, n_words long, words_hash binary, kept_sha256 string, marks array<struct<mark:bigint,place:int>>"


def _sliding(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest of each run of ``size`` values, by doubling."""
    done = 1
    while done * 2 <= size:
        values = best(values[:-done], values[done:])
        done *= 2
    return best(values[:len(values) - (size - done)], values[size - done:]) if size > done else values


def marks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the marks of a document and their hashes: each passage holds one, or one begins less than half a
    passage's reach before it with the same hash."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = run_hashes(hashes, GRAM)
    least = _sliding(grams, _REACH, np.minimum)
    around = np.concatenate([np.zeros(_REACH - 1, np.uint64), least, np.zeros(_REACH - 1, np.uint64)])
    places = np.flatnonzero(_sliding(around, _REACH, np.maximum) == grams)
    values = grams[places]
    # In a run of the same words everything is least: one mark per stretch is enough there.
    begins = np.ones(len(places), bool)
    begins[1:] = (values[1:] != values[:-1]) | (np.diff(places) >= _REACH)
    start = places[begins][np.cumsum(begins) - 1]
    stretch = (places - start) // _THIN
    keep = begins.copy()
    keep[1:] |= stretch[1:] != stretch[:-1]
    return places[keep], values[keep]


def _intervals(places: np.ndarray, count: int) -> Iterator[tuple[int, int]]:
    """The words of all passages that may hold the marks, as separate intervals."""
    if not len(places):
        return
    places = np.sort(places)
    begins = np.maximum(places - (WINDOW - GRAM), 0)
    ends = np.minimum(places + WINDOW + _THIN, count)
    cuts = np.flatnonzero(begins[1:] > ends[:-1]) + 1
    for first, last in zip([0, *cuts], [*cuts, len(places)]):
        yield int(begins[first]), int(ends[last - 1])


def _hashes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    begins, ends, _ = word_places(data, np.array([0, len(data)]))
    return word_hashes(data, begins, ends)


def sketches(docs: DataFrame) -> DataFrame:
    """Per row the words, the hash of the word sequence, the digest of the words, and the marks."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, 1 << 20):
            data, places = byte_column(step.column(1))
            begins, ends, counts = word_places(data, places)
            hashes = word_hashes(data, begins, ends)
            digests, sequences, listed, held = [], [], [0], []
            for n in range(step.num_rows):
                own = hashes[counts[n]:counts[n + 1]]
                # bytes.split() cuts at exactly the six separators.
                digests.append(hashlib.sha256(b" ".join(data[places[n]:places[n + 1]].tobytes().split())).hexdigest())
                sequences.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                held.append(marks(own))
                listed.append(listed[-1] + len(held[-1][0]))
            pairs = pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate([v for _, v in held]).view(np.int64)),
                    pa.array(np.concatenate([p for p, _ in held]).astype(np.int32)),
                ],
                names=["mark", "place"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    step.column(0), pa.array(np.diff(counts).astype(np.int64)),
                    pa.array(sequences, pa.binary()), pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(pa.array(listed, pa.int32()), pairs),
                ],
                names=["doc_id", "n_words", "words_hash", "kept_sha256", "marks"],
            )

    return raw_texts(docs).mapInArrow(sketch, SKETCH)


def _rolling(texts: DataFrame, places: str, size: int, every: int = 1) -> DataFrame:
    """``hash``, ``doc_id`` and ``place`` of the runs of ``size`` words (at multiples of ``every``) near marks."""

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, 1 << 20):
            values, owners, found = [], [], []
            for doc_id, text, near in zip(*(c.to_pylist() for c in step.columns)):
                hashes = _hashes(text)
                for begin, end in _intervals(np.array(near, np.int64), len(hashes)):
                    begin += -begin % every
                    runs = run_hashes(hashes[begin:end], size)[::every]
                    values.append(runs)
                    found.append(begin + every * np.arange(len(runs)))
                    owners.append(np.full(len(runs), doc_id))
            yield _placed(values, owners, found)

    return texts.filter(F.size(places) > 0).select("doc_id", "text", places).mapInArrow(roll, _PLACED)


_PLACED = "hash long, doc_id long, place int"


def _placed(values: list[np.ndarray], owners: list[np.ndarray], places: list[np.ndarray]) -> pa.RecordBatch:
    def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
        return np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)

    hashes = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(hashes), pa.array(joined(owners, np.int64)), pa.array(joined(places, np.int32))],
        names=["hash", "doc_id", "place"],
    )


def _passages(texts: DataFrame) -> DataFrame:
    """The passages around hits (``hits``: places of blocks found in smaller documents)."""

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, 1 << 20):
            values, owners, found = [], [], []
            for doc_id, text, hits in zip(*(c.to_pylist() for c in step.columns)):
                hashes = _hashes(text)
                count = len(hashes) - WINDOW + 1
                hits = np.sort(np.array(hits, np.int64))
                begins, ends = np.maximum(hits - (WINDOW - BLOCK), 0), np.minimum(hits + 1, count)
                cuts = np.flatnonzero(begins[1:] > ends[:-1]) + 1
                for first, last in zip([0, *cuts], [*cuts, len(hits)]):
                    begin, end = int(begins[first]), int(ends[last - 1])
                    if begin < end:
                        values.append(run_hashes(hashes[begin:end + WINDOW - 1], WINDOW))
                        found.append(np.arange(begin, end))
                        owners.append(np.full(end - begin, doc_id))
            yield _placed(values, owners, found)

    return texts.select("doc_id", "text", "hits").mapInArrow(around, _PLACED)


def _found_before(places: DataFrame, index: DataFrame) -> DataFrame:
    """Places whose hash a smaller document has too, listed per document."""
    firsts = stored(index.groupBy("hash").agg(F.min("doc_id").alias("first")), "substring-index")
    return (
        places.join(firsts, "hash")
        .filter(F.col("first") < F.col("doc_id"))
        .groupBy("doc_id")
        .agg(F.collect_set("place").alias("found"))
    )


def _removed(text: bytes, starts: list[int]) -> tuple[int, str]:
    """How many words the passages that begin at ``starts`` cover, and the digest of the others."""
    words = text.split()
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.array(starts, np.int64)
    edges[starts] += 1
    np.subtract.at(edges, starts + WINDOW, 1)
    stays = np.cumsum(edges[:-1]) == 0
    kept = b" ".join(words[n] for n in np.flatnonzero(stays))
    return int(len(words) - stays.sum()), hashlib.sha256(kept).hexdigest()


def removals(texts: DataFrame) -> DataFrame:
    """What is left of documents with repeated passages: ``doc_id``, ``text``, ``starts``."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, 1 << 20):
            found = [_removed(t, s) for t, s in zip(step.column(1).to_pylist(), step.column(2).to_pylist())]
            counts, digests = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [step.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
                names=["changed_id", "n_removed", "left_sha256"],
            )

    return texts.select("doc_id", "text", "starts").mapInArrow(
        remove, "changed_id long, n_removed long, left_sha256 string"
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per document its words, those removed because a smaller document has the passage, and what is left."""
    seen = stored(sketches(docs), "substring-sketches")
    firsts = stored(
        seen.filter(F.col("n_words") >= WINDOW).groupBy("words_hash", "n_words").agg(F.min("doc_id").alias("first")),
        "substring-firsts",
    )
    narrow = seen.select("doc_id", "n_words", "words_hash", "kept_sha256")
    facts = narrow.join(firsts, ["words_hash", "n_words"], "left").select(
        "doc_id", "n_words", "kept_sha256", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("is_copy")
    )
    # Of equal word sequences only the smallest document takes part from here on.
    unique = firsts.filter(F.col("first").isNotNull()).select(F.col("first").alias("doc_id"))
    listed = (
        seen.join(unique, "doc_id", "left_semi").select("doc_id", F.explode("marks").alias("m"))
        .select("doc_id", F.col("m.mark").alias("mark"), F.col("m.place").alias("place"))
    )
    shared = stored(
        listed.groupBy("mark").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter(F.col("first") < F.col("last")),
        "substring-shared",
    )
    probing, indexed = F.col("first") < F.col("doc_id"), F.col("last") > F.col("doc_id")
    near = listed.join(shared, "mark").groupBy("doc_id").agg(
        F.collect_set(F.when(probing, F.col("place"))).alias("probe_places"),
        F.collect_set(F.when(indexed, F.col("place"))).alias("index_places"),
    )
    texts = stored(raw_texts(docs).join(near, "doc_id").dropDuplicates(["doc_id"]), "substring-texts")
    hits = _found_before(
        _rolling(texts, "probe_places", BLOCK), _rolling(texts, "index_places", BLOCK, every=BLOCK)
    ).withColumnRenamed("found", "hits")
    extended = _found_before(
        _passages(texts.join(hits, "doc_id")), _rolling(texts, "index_places", WINDOW)
    ).withColumnRenamed("found", "starts")
    changed = removals(texts.join(extended, "doc_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return facts.join(changed, F.col("doc_id") == F.col("changed_id"), "left").select(
        "doc_id", "n_words",
        F.when(F.col("is_copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("is_copy"), nothing).otherwise(F.coalesce("left_sha256", "kept_sha256")).alias("kept_sha256"),
    )
