"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by gradient descent.

A word is a run of ASCII letters and of bytes above 127; A-Z count as a-z. Its subwords are the runs of two to four
bytes of the word with one blank on each side. Subwords are hashed to rows of an embedding table; the rows of a text
are averaged and a linear softmax gives the languages. Training is stochastic gradient descent in numpy on a bounded
sample of labelled rows: the ``SAMPLE_ROWS`` first in a seeded order that takes languages in turn, texts of more than
``SAMPLE_CHARS`` characters after all others of their language, shortest first, and only up to ``SAMPLE_ROWS`` times
``SAMPLE_CHARS`` characters in all, but each language's first row is always taken. A fifth of the sample is kept apart to
fit a temperature, so that scores are probabilities, and the threshold below which a prediction is rejected: one half, or
less if more than ``REJECTED_RIGHT`` of the rightly named texts kept apart would fall below it.

For prediction the table and the softmax are multiplied out and rounded to whole numbers, so that the sum over a text
does not depend on how it is cut. A null text, or one without a letter, is ``und`` with score 0 and rejected. With no
labelled row there is no language to learn: every row is ``und``. Labels that are null teach nothing; a null ``doc_id``
counts as held out. Repeated rows each get a row, and teach once. Every text is read whole, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.llm.common import byte_column, steps, stored

SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
# Slots of the seeded order of a language; longer texts have as many behind them.
SLOTS = 4096
# The share of rightly named texts that may be rejected.
REJECTED_RIGHT = 0.01
BUCKETS, WIDTH = 1 << 16, 16
EPOCHS, RATE, SEED = 6, 4.0, 5
# The largest value of a weight or embedding: what a subword adds stays below WIDTH * LIMIT ** 2, 31 bits when scaled.
LIMIT = 32.0
LENGTHS = (2, 3, 4)
UNKNOWN = "und"
# Bytes of text whose subwords are held at a time.
PIECE = 1 << 18
_SCALE = 1 << 16
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"

_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


class Model(NamedTuple):
    """``table``: per bucket and language what a subword adds; ``bias`` per language; scores below are rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def _spaced(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with a blank before each text and three behind the last, and where each text's blank stands."""
    count = len(places) - 1
    out = np.full(len(data) + count + 3, 32, np.uint32)
    out[np.arange(len(data)) + np.repeat(np.arange(1, count + 1), np.diff(places))] = _FOLD[data]
    return out, places[:-1] + np.arange(count)


def _subwords(codes: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the buckets of the subwords that begin at the first ``count`` places, and which are subwords."""
    blank = codes == 32
    for length in LENGTHS:
        key = np.full(count, length, np.uint32)
        inner = np.zeros(count, bool)
        for n in range(length):
            key = key * np.uint32(0x01000193) ^ codes[n:n + count]
            if 0 < n < length - 1:
                inner |= blank[n:n + count]
        # Longer runs have a word between their blanks.
        whole = ~inner if length > 2 else ~(blank[:count] & blank[1:1 + count])
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
        yield (key >> np.uint32(16)) % np.uint32(BUCKETS), whole


def sums(table: np.ndarray, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sum of the table's rows over its subwords, and their number."""
    codes, begins = _spaced(data, places)
    # A row of zeros for places where no subword begins.
    table = np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])
    total = np.zeros((len(begins), table.shape[1]), np.int64)
    number = np.zeros(len(begins), np.int64)
    end = len(codes) - 3
    for low in range(0, end, PIECE):
        high = min(low + PIECE, end)
        # Texts with places in this piece, and where in the piece each of them begins.
        first = np.searchsorted(begins, low, "right") - 1
        last = np.searchsorted(begins, high, "left")
        cuts = np.maximum(begins[first:last] - low, 0)
        for buckets, whole in _subwords(codes[low:high + 3], high - low):
            rows = table[np.where(whole, buckets, BUCKETS)]
            total[first:last] += np.add.reduceat(rows, cuts, axis=0, dtype=np.int64)
            number[first:last] += np.add.reduceat(whole, cuts, dtype=np.int64)
    return total, number


class _Bags:
    """Per text its distinct buckets and their shares.

    All texts share two large arrays, which go back to the system as a whole once they are dropped.
    """

    def __init__(self, data: np.ndarray, places: np.ndarray):
        # A text of n bytes has at most 3 * (n + 1) subwords; pages that are never written cost nothing.
        most = 3 * (len(data) + len(places))
        self.buckets, self.counts = np.empty(most, np.uint16), np.empty(most, np.uint32)
        self.ends = [0]
        for begin, end in zip(places, places[1:]):
            codes, _ = _spaced(data[begin:end], np.array([0, end - begin]))
            parts = [b[w] for b, w in _subwords(codes, len(codes) - 3)]
            buckets, counts = np.unique(np.concatenate(parts), return_counts=True)
            at, to = self.ends[-1], self.ends[-1] + len(buckets)
            self.buckets[at:to], self.counts[at:to] = buckets, counts
            self.ends.append(to)

    def __getitem__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.ends[n], self.ends[n + 1])
        counts = self.counts[own].astype(np.int64)
        return self.buckets[own].astype(np.int64), counts / max(1, counts.sum())


def _softmax(values: np.ndarray) -> np.ndarray:
    values = np.exp(values - values.max(axis=-1, keepdims=True))
    return values / values.sum(axis=-1, keepdims=True)


def train(texts: list[bytes], labels: list[str]) -> Model:
    """Fit a model to labelled texts; one in five is for calibration (none of fewer than 20)."""
    languages = sorted(set(labels))
    answer = np.array([languages.index(x) for x in labels], np.int64)
    places = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    bags = _Bags(np.frombuffer(b"".join(texts), np.uint8), places)
    random = np.random.default_rng(SEED)
    order = random.permutation(len(texts))
    apart = order[: len(order) // 5] if len(order) >= 20 else order[:0]
    taught = order[len(apart):]
    embeddings = random.uniform(-1, 1, (BUCKETS, WIDTH))
    weights, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    steps_left = total = EPOCHS * len(taught)
    for _ in range(EPOCHS):
        for n in random.permutation(taught):
            rate = RATE * steps_left / total
            steps_left -= 1
            buckets, shares = bags[n]
            if not len(buckets):
                continue
            rows = embeddings[buckets]
            mean = shares @ rows
            error = _softmax(mean @ weights + bias)
            error[answer[n]] -= 1
            back = weights @ error
            # Bounded, since labels that contradict each other make such steps grow without end.
            weights = np.clip(weights - rate * np.outer(mean, error), -LIMIT, LIMIT)
            bias -= 0.1 * rate * error
            embeddings[buckets] = np.clip(rows - rate * np.outer(shares, back), -LIMIT, LIMIT)
    table = embeddings @ weights
    # A subword that no taught text has says nothing; its embedding is still the random one it began with.
    taught_buckets = np.unique(np.concatenate([bags[n][0] for n in taught]))
    table[np.setdiff1d(np.arange(BUCKETS), taught_buckets)] = 0
    calibration = apart if len(apart) else taught
    logits = np.array([bags[n][1] @ table[bags[n][0]] + bias for n in calibration]).reshape(-1, len(languages))
    right = answer[calibration]
    rounded = np.rint(table * _SCALE).astype(np.int32)
    # The temperature under which the calibration texts' labels are likeliest, then the threshold.
    grid = np.geomspace(0.05, 20, 60)
    # Labels count with the doubt that so few texts leave, so that flawless ones do not make every score 1.
    doubt = np.full(logits.shape, 1 / (len(right) + len(languages)) / len(languages))
    doubt[np.arange(len(right)), right] += 1 - doubt.sum(axis=1)
    losses = [-(doubt * np.log(_softmax(logits / t) + 1e-12)).sum(axis=1).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    scores = _softmax(logits / temperature)
    sure = scores.max(axis=1)[scores.argmax(axis=1) == right]
    return Model(languages, rounded, bias, temperature, rejection_threshold(sure))


def rejection_threshold(right: np.ndarray) -> float:
    """The score below which predictions are rejected, from the scores of rightly named texts."""
    kept = np.quantile(right, REJECTED_RIGHT, method="lower") if len(right) else 0.5
    return min(0.5, float(kept)) * 0.999


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """The bounded sample: ``doc_id``, ``text`` (bytes) and ``lang`` of rows that may be learned from, each once.

    A language's rows are counted by slot of their order first, so that no more than its first ``rows`` rows and the rest of
    one slot are ever sorted.
    """
    labelled = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("lang")
    ).filter(~_held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("key", F.xxhash64("text"))
    length = F.length("text")
    facts = stored(
        labelled.select("doc_id", "lang", "key", length.alias("chars"), F.when(length > chars, length).otherwise(0).alias("above"))
        .distinct()
        .withColumn("seeded", F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 1))
        .withColumn(
            "slot", F.when(F.col("above") == 0, F.shiftright("seeded", 51)).otherwise(
                SLOTS + F.least(F.floor(F.col("above") / chars), F.lit(SLOTS - 1))
            )
        ),
        "language-sample",
    )
    before = F.sum("held").over(W.partitionBy("lang").orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    # One row per language, as the model itself has.
    cuts = (
        facts.groupBy("lang", "slot").agg(F.count(F.lit(1)).alias("held"))
        .withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < rows)
        .groupBy("lang").agg(F.max("slot").alias("last"))
    )
    order = ["above", "seeded", "doc_id", "key"]
    early = facts.join(F.broadcast(cuts), "lang").filter("slot <= last")
    first = (
        early.withColumn("turn", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
        .orderBy("turn", *order, "lang").limit(rows)
    )
    # Over at most ``rows`` rows, which are then sent to all tasks.
    spent = F.sum("chars").over(W.orderBy("above", "turn", *order[1:], "lang").rowsBetween(W.unboundedPreceding, W.currentRow))
    chosen = first.withColumn("spent", spent).filter((F.col("spent") <= rows * chars) | (F.col("turn") == 1))
    taught = labelled.join(F.broadcast(chosen.select("doc_id", "lang", "key")), ["doc_id", "lang", "key"], "left_semi")
    return taught.groupBy("doc_id", "lang", "key").agg(F.first("text").cast("binary").alias("text")).select(
        "doc_id", "text", "lang"
    )


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame) -> Model | None:
    """A model from the bounded sample, fitted on the driver; none if nothing is labelled."""
    rows = sorted(sample(docs).collect(), key=lambda r: (r["doc_id"], r["lang"], bytes(r["text"])))
    return train([bytes(r["text"]) for r in rows], [r["lang"] for r in rows]) if rows else None


def _scored(model: Model, texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the number of its language, its score, and whether that is rejected; ``known``: it has a letter."""
    total, number = sums(model.table, *byte_column(texts))
    logits = total / (_SCALE * np.maximum(number, 1)[:, None]) + model.bias
    scores = _softmax(logits / model.temperature)
    best = scores.argmax(axis=1)
    score = np.where(known, scores[np.arange(len(best)), best], 0.0)
    return best, score, ~known | (score < model.threshold)


def _has_letter():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row the language of the whole text, its score, and whether the prediction is rejected."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"),
        _has_letter().alias("has_letter"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    if model is None:
        return rows.select(
            "doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")
        )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for step in steps(batches, 1 << 20):
            known = step.column(2).to_numpy(zero_copy_only=False)
            best, score, rejected = _scored(model, step.column(3), known)
            named = [model.languages[n] if k else UNKNOWN for n, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [step.column(0), step.column(1), pa.array(named, pa.string()), pa.array(score), pa.array(rejected)],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(name, PREDICTED)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The whole rows of ``docs`` whose prediction is not rejected: each row by its own text, so nothing is joined."""
    if model is None:
        return docs.filter(F.lit(False))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, 1 << 20):
            last = step.num_columns - 1
            known = step.column(last).to_numpy(zero_copy_only=False)
            texts = step.column(step.schema.get_field_index("text"))
            _, _, rejected = _scored(sent.value, texts, known)
            yield step.select(list(range(last))).filter(pa.array(~rejected))

    return docs.withColumn("__has_letter", _has_letter()).mapInArrow(keep, docs.schema)


def languages(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows of ``docs`` and name the language of every row."""
    return predict(docs, learn(docs))
