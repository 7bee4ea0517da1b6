r"""Phrase collocations by vertically partitioned suffix trees of bounded depth.

Words are counted first; these counts are the frequencies of all one-word prefixes of suffixes. Prefixes are put into
groups so that no group holds more than ``BUDGET`` suffixes: words share a fixed number of slots, neighbouring slots are
packed up to the budget, and where a slot is too frequent its suffixes are told apart by their second word as well,
in slots of two-word prefixes counted by one more pass, and finally by all three words. Suffixes are cut off after three
words, at the end of their piece, and before a word that is too rare to be in any candidate. Each task writes sorted runs
of its suffixes by group. Each group then builds its subtree alone: the runs are merged into leaves, leaf totals are
the counts of the phrases, and an inner node is the sum of its leaves.

Words have 64-bit ids, made from language and word. The word counts show whether two words share an id; then all is
counted again with other ids. Counts are exact, scores are computed in decimals of 38 digits (up to 10^15 words a language).

Null and empty texts have no words, a null ``lang`` counts as ``und``. Repeated rows count as often as they are there; an
empty table gives no row; extra columns are ignored. Texts of any length are read whole, in parts that end at a piece's end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import count as count_from
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.common import byte_column, folded_table, mixed, steps, stored, word_hashes

LEAST, TOP, CONTAINED = 10, 2000, 50
# Suffixes of a group, and those that a task sorts at a time; suffixes of one row of a run.
BUDGET, SORTED, ROW = 1 << 21, 1 << 20, 1 << 15
# Distinct words that a task counts before it hands them on.
COUNTED = 1 << 19
# Bytes of a part of a text.
PART = 2 << 20
# Sizes of what every task gets: bits that tell frequent words (at most 16 MB), slots of prefixes (at most 16 MB each).
LEAST_BITS, MOST_BITS, LEAST_SLOTS, MOST_SLOTS = 15, 27, 10, 22

_BLANK, _BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANK)] = 1
_KIND[list(_BREAK)] = 2


class Words(NamedTuple):
    """Words of a part: ids, where they lie in its bytes, their row, and whether the next one is in the same piece."""

    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    goes_on: np.ndarray


def _read(data: np.ndarray, places: np.ndarray, salts: np.ndarray, table: np.ndarray) -> Words:
    kind = _KIND[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[places] = True
    begins = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    row = np.searchsorted(places, begins, "right") - 1
    breaks = np.cumsum(kind == 2, dtype=np.int32)[begins]
    goes_on = np.zeros(len(begins), bool)
    goes_on[:-1] = (breaks[1:] == breaks[:-1]) & (row[1:] == row[:-1])
    # Nought stands for the end of a suffix.
    ids = np.maximum(mixed(word_hashes(data, begins, ends, table=table) ^ salts[row]), np.uint64(1))
    return Words(ids, begins, ends, row, goes_on)


def _parts(data: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Several texts as they are, or one long text cut behind breaks (a piece that is longer stays whole)."""
    if len(data) <= PART or len(places) > 2:
        yield data, places
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + PART)
        if end < len(data):
            cuts = np.flatnonzero(_KIND[data[at:end]] == 2)
            while not len(cuts) and end < len(data):
                behind = min(len(data), end + PART)
                cuts = np.flatnonzero(_KIND[data[end:behind]] == 2)[:1] + (end - at)
                end = behind
            end = at + int(cuts[-1]) + 1 if len(cuts) else len(data)
        yield data[at:end], np.array([0, end - at])
        at = end


def _words(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[tuple[np.ndarray, list[str], Words]]:
    """The words of rows (``lang``, ``text``), part by part, with the part's bytes and the languages of its rows."""
    salts: dict[str, int] = {}
    for step in steps(batches):
        langs = step.column(0).to_pylist()
        for lang in langs:
            if lang not in salts:
                salts[lang] = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest())
        salt = np.array([salts[lang] for lang in langs], np.uint64)
        for data, places in _parts(*byte_column(step.column(1))):
            yield data, langs, _read(data, places, salt, table)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def vocabulary(docs: DataFrame, tables: Callable[[int], np.ndarray] = folded_table) -> tuple[DataFrame, np.ndarray]:
    """Per language and word its id and how often it occurs (``id``, ``lang``, ``word``, ``f``), and what ids are made from."""
    for seed in count_from(1):
        table = tables(seed)

        def count(batches: Iterator[pa.RecordBatch], table: np.ndarray = table) -> Iterator[pa.RecordBatch]:
            known: dict[int, list] = {}
            # A second hash tells words of one id apart; each of them gets a row, so that the counts show the clash.
            clashing: list[tuple] = []
            other = folded_table(0)

            def handed() -> pa.RecordBatch:
                rows = [(key, *entry[:3]) for key, entry in known.items()] + clashing
                ids, langs, words, counts = zip(*rows)
                ids = np.fromiter(ids, np.uint64, len(ids)).view(np.int64)
                return pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts)],
                    names=["id", "lang", "word", "f"],
                )

            for data, langs, words in _words(batches, table):
                found, first, inverse, counts = np.unique(
                    words.ids, return_index=True, return_inverse=True, return_counts=True
                )
                checks = word_hashes(data, words.begins, words.ends, table=other)
                held = data.tobytes()
                for at in np.flatnonzero(checks != checks[first][inverse]).tolist():
                    clashing.append((int(words.ids[at]), langs[words.row[at]], held[words.begins[at]:words.ends[at]].lower(), 1))
                where = zip(words.row[first].tolist(), words.begins[first].tolist(), words.ends[first].tolist(), checks[first].tolist())
                for key, (row, begin, end, check), n in zip(found.tolist(), where, counts.tolist()):
                    entry = known.get(key)
                    if entry is None:
                        known[key] = [langs[row], held[begin:end].lower(), n, (check, langs[row])]
                    elif entry[3] == (check, langs[row]):
                        entry[2] += n
                    else:
                        clashing.append((key, langs[row], held[begin:end].lower(), n))
                if len(known) + len(clashing) >= COUNTED:
                    yield handed()
                    known, clashing = {}, []
            if known:
                yield handed()

        counted = _rows(docs).mapInArrow(count, "id long, lang string, word string, f long")
        words = stored(counted.groupBy("id", "lang", "word").agg(F.sum("f").alias("f")), "phrase-words")
        if words.groupBy("id").agg(F.count(F.lit(1)).alias("words")).filter("words > 1").isEmpty():
            return words, table


def _bits(count: int, least: int, most: int) -> int:
    return min(most, max(least, math.ceil(math.log2(max(count, 1)))))


def _frequent_bits(frequent: DataFrame, count: int) -> np.ndarray:
    """A bit for each place that some frequent word's id points to; 16 places a word, as far as the bound goes."""
    bits = _bits(16 * count, LEAST_BITS, MOST_BITS)
    place = F.col("id").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    rows = frequent.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    found = np.zeros(1 << bits - 3, np.uint8)
    for row in rows.toLocalIterator():
        begin = (row.bucket - 1) << 12
        found[begin:begin + 4096] = np.frombuffer(row.bits, np.uint8)
    return np.unpackbits(found, bitorder="little").view(bool) if bits <= 23 else found


def _is_frequent(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if bits.dtype == bool:
        return bits[ids & np.uint64(len(bits) - 1)]
    at = ids & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _pair(w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    return mixed(w1 * _ODD ^ w2)


class Groups(NamedTuple):
    """The group of each slot of one-word and of two-word prefixes (-1: tell by one word more), and of triples."""

    bits: int
    ones: np.ndarray
    twos: np.ndarray
    # Where a slot of two-word prefixes is told by three words: the first of its groups, and how many there are.
    first: np.ndarray
    parts: np.ndarray
    # Groups from this one on hold prefixes of three words.
    threes: int

    def slot(self, ids: np.ndarray) -> np.ndarray:
        return (ids >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> np.ndarray:
        group = self.ones[self.slot(w1)]
        open_ = np.flatnonzero(group < 0)
        if len(open_):
            pair = _pair(w1[open_], w2[open_])
            slot = self.slot(pair)
            group[open_] = self.twos[slot]
            still = np.flatnonzero(self.twos[slot] < 0)
            if len(still):
                at, slot = open_[still], slot[still]
                group[at] = self.first[slot] + (_pair(pair[still], w3[at]) % self.parts[slot].astype(np.uint64)).astype(np.int64)
        return group


def _packed(held: np.ndarray, budget: int, begin: int) -> tuple[np.ndarray, int]:
    """Neighbouring slots in groups from ``begin`` on, ``budget`` suffixes at most; -1 for slots above half of it."""
    half = max(budget // 2, 1)
    light = held <= half
    before = np.cumsum(np.where(light, held, 0)) - np.where(light, held, 0)
    group = np.where(light, begin + before // half, -1)
    return group, int(group.max(initial=begin - 1)) + 1


def _slots(counts: DataFrame, bits: int) -> np.ndarray:
    """Suffixes of each slot (``slot``, ``f``); at most 2 ** ``MOST_SLOTS`` rows come to the driver."""
    found = np.zeros(1 << bits, np.int64)
    table = counts.groupBy("slot").agg(F.sum("f").alias("f")).toArrow()
    found[table.column("slot").to_numpy()] = table.column("f").to_numpy()
    return found


def groups(docs: DataFrame, frequent: DataFrame, total: int, shared: Broadcast, table: np.ndarray, budget: int = BUDGET) -> Groups:
    """Prefixes of suffixes put into groups of at most ``budget`` suffixes."""
    bits = _bits(8 * total // budget, LEAST_SLOTS, MOST_SLOTS)
    slot = F.shiftrightunsigned("id", 64 - bits)
    ones, used = _packed(_slots(frequent.select(slot.alias("slot"), "f"), bits), budget, 0)
    none = np.zeros(1 << bits, np.int64)
    found = Groups(bits, ones, none, none, none, used)
    if not (ones < 0).any():
        return found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, np.int64)
        for w1, w2, _ in _suffixes(batches, table, shared.value):
            open_ = ones[found.slot(w1)] < 0
            held += np.bincount(found.slot(_pair(w1[open_], w2[open_])), minlength=1 << bits)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["slot", "f"])

    held = _slots(_rows(docs).mapInArrow(count, "slot long, f long"), bits)
    twos, used = _packed(held, budget, used)
    parts = np.where(twos < 0, -(-held // max(budget // 2, 1)), 0)
    return Groups(bits, ones, twos, used + np.cumsum(parts) - parts, parts, used)


def _suffixes(batches: Iterator[pa.RecordBatch], table: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Suffixes of two words or more, cut off after three and before words that are too rare; a missing word is 0."""
    for _, _, words in _words(batches, table):
        ids = words.ids
        goes_on = words.goes_on.copy()
        known = _is_frequent(bits, ids)
        goes_on[:-1] &= known[:-1] & known[1:]
        at = np.flatnonzero(goes_on)
        if len(at):
            third = goes_on[at + 1]
            yield ids[at], ids[at + 1], np.where(third, ids[np.minimum(at + 2, len(ids) - 1)], np.uint64(0))


def _leaves(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct suffixes with their totals."""
    order = np.lexsort((w3, w2, w1))
    w1, w2, w3 = w1[order], w2[order], w3[order]
    new = np.ones(len(w1), bool)
    new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (w3[1:] != w3[:-1])
    at = np.flatnonzero(new)
    return w1[at], w2[at], w3[at], np.add.reduceat(f[order], at)


RUN = "`group` long, w1 binary, w2 binary, w3 binary, f binary"
NODE = "w1 long, w2 long, w3 long, f long"


def runs(docs: DataFrame, plan: Broadcast, shared: Broadcast, table: np.ndarray) -> DataFrame:
    """Suffixes of the texts as sorted runs by group; each row has some of one group, as arrays."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def sorted_runs() -> Iterator[pa.RecordBatch]:
            w1, w2, w3 = map(np.concatenate, zip(*held))
            w1, w2, w3, f = _leaves(w1, w2, w3, np.ones(len(w1), np.int64))
            group = plan.value.of(w1, w2, w3)
            order = np.argsort(group, kind="stable")
            group, f = group[order], f.astype(np.int32)
            begins = np.flatnonzero(np.diff(group, prepend=-1))
            rows: list[list] = [[], [], [], [], []]
            for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(group)]):
                for at in range(begin, end, ROW):
                    chosen = order[at:min(end, at + ROW)]
                    for out, value in zip(rows, (int(group[at]), *(c[chosen].tobytes() for c in (w1, w2, w3, f)))):
                        out.append(value)
                if len(rows[0]) >= 64:
                    yield batch(rows)
                    rows = [[], [], [], [], []]
            if rows[0]:
                yield batch(rows)

        def batch(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["group", "w1", "w2", "w3", "f"]
            )

        for suffixes in _suffixes(batches, table, shared.value):
            held.append(suffixes)
            size += len(suffixes[0])
            if size >= SORTED:
                yield from sorted_runs()
                held, size = [], 0
        if held:
            yield from sorted_runs()

    return _rows(docs).mapInArrow(write, RUN)


def subtrees(listed: DataFrame, least: int, threes: int) -> DataFrame:
    """Nodes of two and three words (``w3`` 0 for two) with at least ``least`` suffixes, from each group's own subtree."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def subtree() -> pa.RecordBatch:
            w1, w2, w3, f = (np.concatenate([np.frombuffer(row[n], t) for row in held]) for n, t in enumerate(("u8", "u8", "u8", "i4")))
            w1, w2, w3, f = _leaves(w1, w2, w3, f.astype(np.int64))
            new = np.ones(len(w1), bool)
            new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            inner = np.flatnonzero(new)
            totals = np.add.reduceat(f, inner)
            # Where prefixes have three words, other groups have leaves of the same inner nodes.
            whole = inner[totals >= least] if at < threes else inner
            sums = totals[totals >= least] if at < threes else totals
            leaf = np.flatnonzero((w3 != 0) & (f >= least))
            columns = (
                np.concatenate([w1[whole], w1[leaf]]), np.concatenate([w2[whole], w2[leaf]]),
                np.concatenate([np.zeros(len(whole), np.uint64), w3[leaf]]),
            )
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c.view(np.int64)) for c in columns), pa.array(np.concatenate([sums, f[leaf]]))], names=["w1", "w2", "w3", "f"]
            )

        for batch in batches:
            for group, *arrays in zip(*(c.to_pylist() for c in batch.columns)):
                if group != at and held:
                    yield subtree()
                    held = []
                at = group
                held.append(arrays)
        if held:
            yield subtree()

    owned = listed.repartition("group").sortWithinPartitions("group")
    nodes = owned.mapInArrow(build, NODE)
    return nodes.groupBy("w1", "w2", "w3").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """All words (``id``, ``lang``, ``word``, ``f``), and all phrases of two and three words that occur ``least`` times (by ids)."""
    spark = docs.sparkSession
    words, table = vocabulary(docs)
    frequent = words.filter(F.col("f") >= least)
    count, total = frequent.agg(F.count(F.lit(1)), F.coalesce(F.sum("f"), F.lit(0))).first()
    shared = spark.sparkContext.broadcast(_frequent_bits(frequent, count))
    plan = groups(docs, frequent, total, shared, table, budget)
    listed = runs(docs, spark.sparkContext.broadcast(plan), shared, table)
    return words, stored(subtrees(listed, least, plan.threes), "phrase-nodes")


def _score(a: str, left: str, right: str) -> Column:
    """``floor(1000000 * a * a / (left * right))`` in whole numbers."""
    a, left, right = (f"CAST({name} AS DECIMAL(19, 0))" for name in (a, left, right))
    return F.expr(f"({a} * {a} * CAST(1000000 AS DECIMAL(7, 0))) div ({left} * {right})")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, contained: int = CONTAINED, budget: int = BUDGET) -> DataFrame:
    """Each language's ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    words, nodes = phrase_counts(docs, least, budget)
    known = words.filter(F.col("f") >= least)
    first = known.select(F.col("id").alias("w1"), "lang", F.col("word").alias("word1"), F.col("f").alias("f1"))
    second = known.select(F.col("id").alias("w2"), F.col("word").alias("word2"), F.col("f").alias("f2"))
    twos = stored(
        nodes.filter("w3 = 0").select("w1", "w2", F.col("f").alias("a")).join(first, "w1").join(second, "w2"), "phrase-pairs"
    )
    threes = nodes.filter("w3 <> 0").withColumnRenamed("f", "a")
    longer = (
        threes.select("w1", "w2", "a").unionByName(threes.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
        .groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    )
    pairs = (
        twos.join(longer, ["w1", "w2"], "left").filter(F.coalesce(100 * F.col("longer") < contained * F.col("a"), F.lit(True)))
        .select(
            "lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
            _score("a", "f1", "f2").alias("score"),
        )
    )
    behind = twos.select(
        F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("word2").alias("word3"), F.col("a").alias("f23"), F.col("f2").alias("f3")
    )
    triples = threes.join(twos.withColumnRenamed("a", "f12"), ["w1", "w2"]).join(behind, ["w2", "w3"])
    early, late = _score("a", "f1", "f23"), _score("a", "f12", "f3")
    cut = F.when(early <= late, F.struct(F.col("f1").alias("l"), F.col("f23").alias("r"), early.alias("score"))).otherwise(
        F.struct(F.col("f12").alias("l"), F.col("f3").alias("r"), late.alias("score"))
    )
    found = triples.select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", cut.alias("cut")
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").unionByName(pairs)

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may have any number of phrases: its parts are ranked first, and the best of each part together.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = found.withColumn("part", part).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    ).filter(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(
        F.col("rank") <= top
    )
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
