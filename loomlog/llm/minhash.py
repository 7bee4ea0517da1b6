"""Near-duplicate detection with circulant MinHash.

A document's set are the distinct shingles of ``shingle`` words (``SHINGLE`` unless said otherwise), A-Z taken as a-z. Two permutations of the 32-bit
numbers make the whole signature: the first one scatters the shingles, the second one is read at each of ``ROWS`` times
``BANDS`` circular shifts, and a coordinate is the least number met. Equal sets are one class. Classes that agree in a
band meet in a bucket, and links are confirmed on the full sets (``100 * intersection >= 80 * union``).

No bucket is paired out. First every member is compared with the smallest leader of its buckets, then with a bucket's
centre (the member most like its leader) unless a chain of links joins them already; only members that are still in
different components are compared one by one. Shingles that one document alone has, or few have, bound each comparison
from above, so most copies with too many changes to be linked are never compared: for equal sizes, more than a ninth of
shingles that the other one lacks rules a link out. So a group of thousands costs comparisons about in proportion to its
size, and no link is left out that joins two components. Two sets with a similarity of 0.8 share no band with a probability
of (1 - 0.8**4)**32, less than one in twenty million.

Documents without words (null or empty texts) have an empty set, are linked with nothing and are kept. Texts below one
shingle have their whole word sequence as the one shingle. Rows that repeat a ``doc_id`` are one document. Rows with a null
``doc_id`` join the component of equal sets but never name one; with no named row they have no component and are kept.
Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import byte_column, mixed, raw_texts, run_hashes, steps, stored, word_hashes, word_places
from loomlog.llm.components import components

SHINGLE = 4
BANDS, ROWS = 32, 4
SIMILARITY = 80
# Comparisons with centres before the rest is compared one by one.
CENTRES = 2
# A shingle that so few of the documents compared last have tells nearly alone whom to compare.
RARE = 8
SKETCH = "doc_id long, n_shingles long, set_hash binary, bands array<long>"

# The first permutation and the second one: bijections of 32-bit numbers.
_SCATTER, _READ = (0x7FEB352D, 0x846CA68B), (0x21F0AAAD, 0xD35A2D97)


def _permuted(values: np.ndarray, constants: tuple[int, int]) -> np.ndarray:
    values = values ^ (values >> np.uint32(16))
    values *= np.uint32(constants[0])
    values ^= values >> np.uint32(15)
    values *= np.uint32(constants[1])
    values ^= values >> np.uint32(16)
    return values


def signatures(shingles: np.ndarray, begins: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """One signature per set; sets lie one behind the other in ``shingles`` and none is empty."""
    scattered = _permuted(shingles.astype(np.uint32), _SCATTER)
    out = np.empty((len(begins), count), np.uint32)
    for shift in range(count):
        out[:, shift] = np.minimum.reduceat(_permuted(scattered + np.uint32(shift), _READ), begins)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; the band's number is part of it."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for row in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, row])
    return key


def shingle_lists(text: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Per text the hashes of its shingles in the order of places, repeated ones too."""
    data, places = byte_column(text)
    begins, ends, counts = word_places(data, places)
    hashes = word_hashes(data, begins, ends, folded=True)
    found = []
    for first, last in zip(counts, counts[1:]):
        own = hashes[first:last]
        # A short sequence is told apart from a shingle by its number of words.
        found.append(run_hashes(own, shingle) if len(own) >= shingle else run_hashes(own, len(own)) + np.uint64(len(own))
                     if len(own) else own)
    return found


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row the size and the hash of its set, and its band keys (none for an empty set)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, 1 << 20):
            lists = shingle_lists(step.column(1), shingle)
            sets = [np.unique(x) for x in lists]
            hashes = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            full = [n for n, x in enumerate(sets) if len(x)]
            keys: list[np.ndarray | None] = [None] * len(sets)
            if full:
                sizes = np.array([len(sets[n]) for n in full])
                begins = np.cumsum(sizes) - sizes
                for n, key in zip(full, band_keys(signatures(np.concatenate([sets[n] for n in full]), begins))):
                    keys[n] = key.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    step.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(hashes, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_hash", "bands"],
            )

    return raw_texts(docs).mapInArrow(sketch, SKETCH)


def full_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and the distinct shingles of ``doc_id``, ``text`` (bytes)."""

    def list_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, 1 << 20):
            sets = [np.unique(x).view(np.int64) for x in shingle_lists(step.column(1), shingle)]
            yield pa.RecordBatch.from_arrays(
                [step.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"]
            )

    return docs.mapInArrow(list_sets, "doc_id long, shingles array<long>")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b`` and their similarity in hundredths, rounded down, from the full sets; stored."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    common = F.size(F.array_intersect("left", "right"))
    return stored(
        pairs.join(right, "b").join(left, "a")
        .select("a", "b", common.alias("common"), (F.size("left") + F.size("right") - common).alias("all"))
        .select("a", "b", F.floor(100 * F.col("common") / F.col("all")).cast("int").alias("similarity"),
                (100 * F.col("common") >= SIMILARITY * F.col("all")).alias("linked")),
        "minhash-compared",
    )


def _may_link(a: str, b: str) -> Column:
    """Sets whose sizes allow the similarity, when shingles of their own (``_own``) cannot be common."""
    most = F.least(F.col(f"{a}size") - F.col(f"{a}own"), F.col(f"{b}size") - F.col(f"{b}own"))
    return 100 * most >= SIMILARITY * (F.col(f"{a}size") + F.col(f"{b}size") - most)


def own_shingles(sets: DataFrame) -> DataFrame:
    """How many shingles of each document no other one of ``sets`` has; documents without any are left out."""
    return (
        sets.select("doc_id", F.explode("shingles").alias("shingle"))
        .groupBy("shingle").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("doc"))
        .filter("documents = 1").groupBy("doc").agg(F.count(F.lit(1)).alias("own"))
    )


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn(
        "component", F.coalesce("component", "doc")
    )


def links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) that join all linked members of the buckets (``key``, ``doc``, ``size``, ``own``)."""
    leads = stored(
        members.groupBy("key").agg(F.min_by(F.struct("doc", "size", "own"), F.col("doc")).alias("lead")), "minhash-leads"
    )
    led = (
        members.join(leads, "key")
        .filter((F.col("doc") != F.col("lead.doc")) & _may_link("", "lead."))
        .groupBy("doc").agg(F.min("lead.doc").alias("lead"))
    )
    tested = _compared(led.select(F.col("lead").alias("a"), F.col("doc").alias("b")), sets)
    found = tested.filter("linked").select("a", "b")
    for _ in range(CENTRES):
        labels = components(found)
        placed = _labelled(members, labels)
        likeness = tested.groupBy(F.col("b").alias("doc")).agg(F.max("similarity").alias("similarity"))
        centres = stored(
            placed.join(likeness, "doc", "left")
            .groupBy("key").agg(
                F.max_by(
                    F.struct("doc", "size", "own", "component"), F.struct(F.coalesce("similarity", F.lit(-1)), -F.col("doc"))
                ).alias("centre"),
                F.min("component").alias("least"), F.max("component").alias("most"),
            )
            .filter("least < most"),
            "minhash-centres",
        )
        pairs = (
            placed.join(centres, "key")
            .filter((F.col("component") != F.col("centre.component")) & _may_link("", "centre."))
            .select(F.col("centre.doc").alias("a"), F.col("doc").alias("b")).distinct()
        )
        known = tested.select("a", "b").unionAll(tested.select("b", "a"))
        fresh = _compared(pairs.join(known, ["a", "b"], "left_anti"), sets)
        tested, found = tested.unionAll(fresh), found.unionAll(fresh.filter("linked").select("a", "b"))
    # Whatever is still apart in a bucket is compared one by one, if its shingles allow a link.
    placed = _labelled(members, components(found))
    apart = _mixed_buckets(placed)
    rest = stored(placed.join(apart, "key", "left_semi"), "minhash-apart")
    pairs = stored(remaining_pairs(rest, sets), "minhash-pairs")
    known = tested.select("a", "b").unionAll(tested.select("b", "a"))
    return found.unionAll(_compared(pairs.join(known, ["a", "b"], "left_anti"), sets).filter("linked").select("a", "b"))


def _mixed_buckets(placed: DataFrame) -> DataFrame:
    """Keys of buckets with members of several components."""
    ends = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return stored(ends.filter("least < most").select("key"), "minhash-mixed")


def remaining_pairs(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (``a`` < ``b``) of members of one bucket and different components that may be linked.

    A shingle is rare if at most ``RARE`` of the remaining documents have it. Two documents that share rare shingles are
    found through these, at most ``RARE`` per shingle; for all other pairs none of the rare shingles is common. Either way
    it is known how many rare shingles are common, and the others of them bound the intersection from above.
    """
    wanted = rest.select(F.col("doc").alias("doc_id")).distinct()
    parts = stored(
        sets.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), F.explode("shingles").alias("shingle"))
        .distinct(),
        "minhash-parts",
    )
    few = parts.groupBy("shingle").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") <= RARE)
    rare = stored(parts.join(few, "shingle"), "minhash-rare")
    counts = rare.groupBy("doc").agg(F.count(F.lit(1)).alias("rare"))
    known = stored(
        rest.drop("own").join(counts, "doc", "left").withColumn("own", F.coalesce("rare", F.lit(0))).drop("rare"),
        "minhash-rest",
    )
    # No rare shingle in common: sets too large, without theirs, for the smallest set of the bucket fit none in it.
    least = known.groupBy("key").agg(F.min("size").alias("least_size"))
    able = known.join(least, "key").filter(
        100 * (F.col("size") - F.col("own")) >= SIMILARITY * (F.col("least_size") + F.col("own"))
    ).drop("least_size")
    able = stored(able.join(_mixed_buckets(able), "key", "left_semi"), "minhash-able")
    buckets = able.groupBy("doc").agg(F.collect_set("key").alias("keys"))
    able = stored(able.join(buckets, "doc"), "minhash-keyed")
    other = able.select("key", *(F.col(n).alias(f"b_{n}") for n in ("doc", "size", "own", "component", "keys")))
    apart = F.col("component") != F.col("b_component")
    # A pair is made in the first bucket that it shares, not in all of them.
    first = F.array_min(F.array_intersect("keys", "b_keys")) == F.col("key")
    plain = able.join(other, "key").filter((F.col("doc") < F.col("b_doc")) & apart & _may_link("", "b_") & first)
    # Some in common: as many fewer are the documents' own.
    facts = known.select("doc", "size", "own", "component").distinct()
    shared = stored(rare.filter("documents > 1").select("shingle", "doc").join(facts, "doc"), "minhash-shared")
    names = ("doc", "size", "own", "component")
    sizes = 100 * F.least("size", "b_size") >= SIMILARITY * F.greatest("size", "b_size")
    met = (
        shared.join(shared.select("shingle", *(F.col(n).alias(f"b_{n}") for n in names)), "shingle")
        .filter((F.col("doc") < F.col("b_doc")) & apart & sizes)
        .groupBy("doc", "b_doc", "size", "b_size", "own", "b_own").agg(F.count(F.lit(1)).alias("common"))
        .withColumns({"own": F.col("own") - F.col("common"), "b_own": F.col("b_own") - F.col("common")})
        .filter(_may_link("", "b_"))
    )
    ends = (F.col("doc").alias("a"), F.col("b_doc").alias("b"))
    return plain.select(*ends).unionAll(met.select(*ends)).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row the size of its set, the smallest ``doc_id`` reachable by links, and whether that is its own."""
    seen = stored(sketches(docs, shingle), "minhash-sketches")
    classes = seen.filter("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("class_id"))
    banded = seen.join(
        classes.filter(F.col("class_id").isNotNull()), (seen.set_hash == classes.set_hash) & (seen.doc_id == classes.class_id)
    ).select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    buckets = stored(
        banded.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most"),
        "minhash-buckets",
    )
    members = stored(
        banded.join(buckets.select("key"), "key", "left_semi").select(
            "key", F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size")
        ),
        "minhash-members",
    )
    wanted = members.select(F.col("doc").alias("doc_id")).distinct()
    sets = stored(full_sets(raw_texts(docs).join(wanted, "doc_id", "left_semi"), shingle), "minhash-sets")
    # Sets of which more than a fifth is their own are linked with nothing.
    counted = stored(
        members.join(own_shingles(sets), "doc", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        .filter(100 * (F.col("size") - F.col("own")) >= SIMILARITY * F.col("size")),
        "minhash-counted",
    )
    labels = components(links(counted, sets)).withColumnRenamed("node", "class_id")
    named = stored(
        classes.join(labels, "class_id", "left").select(
            "set_hash", F.coalesce("component", "class_id").alias("component_id")
        ),
        "minhash-classes",
    )
    return seen.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
