"""The prefix trie of conversations by ROLLUP over positional turn columns.

Every turn has an id (a digest of role and text, with the text's length). Eight ids side by side are a block of a
conversation; ``ROLLUP`` over these columns counts the members of all prefixes in one pass, and ``grouping_id`` tells
the depth of each. A longer conversation goes on in further blocks, grouped under the node that the block before ended
in. That node is named by its path: the exclusive-or of two 64-bit hashes of each (depth, id) so far. Thus all blocks
of all conversations go through the same ROLLUP, however deep they lie.

Sums over subtrees need no walk along the tree. A node is represented by its smallest member, so each conversation
represents one run of its own path. A second ROLLUP adds up what the members represent in all; of this only the
representative's own part above the node is too much, and a running sum along its path takes it off.

Turns are ordered by ``turn``, null first; equal numbers by their ids. Null roles and texts are empty texts. Rows
without ``conv_id`` belong to no conversation and are left out; repeated rows are turns of their own; an empty table has
no node. Extra columns are ignored. A conversation of any length is numbered and summed in slices, a node of any number
of members is a partial sum in every task, and what its digest of ids reads is streamed in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.common import stored

# Turn columns of a block; depths that one slice of a running sum has; bytes of ids that one piece of a digest has.
WIDTH = 8
SLICE = 4096
PIECE = 1 << 16
HEAD = 9


def turn_ids(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn`` and the id of every turn: ``a`` (60 bits of a digest) and ``b`` (28 bits and the text's bytes)."""
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return turns.select("conv_id", "turn", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")).select(
        "conv_id", "turn", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("a"),
        (F.shiftleft(F.conv(F.substring("digest", 16, 7), 16, 10).cast("long"), 32) + F.col("bytes")).alias("b"),
    )


def numbered(turns: DataFrame) -> DataFrame:
    """``place`` (from 0) of every turn in its conversation, for conversations of any length.

    The turns are sorted over range partitions and stored with their places there. A part of a conversation then only
    needs the number of its turns in earlier parts.
    """
    ordered = turns.repartitionByRange("conv_id", "turn", "a", "b").sortWithinPartitions("conv_id", "turn", "a", "b")
    placed = stored(ordered.drop("turn").withColumn("at", F.monotonically_increasing_id()), "trie-turns").withColumn(
        "part", F.shiftright("at", 33)
    )
    parts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("turns"), F.min("at").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select("conv_id", "part", (F.coalesce(F.sum("turns").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(begins, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "a", "b")


def rebuilt(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Numbered turns of rebuilt conversations (``conv_id``, ``place``, ``a``, ``b``); ``lengths``: see :func:`rebuilt_lengths`."""
    heads = turns.filter(F.col("place") < HEAD).select(F.col("conv_id").alias("base"), "place", "a", "b")
    taken = lengths.filter("taken > 0").select("conv_id", "base", "taken")
    first = taken.join(heads, "base").filter(F.col("place") < F.col("taken")).select("conv_id", "place", "a", "b")
    # A long conversation meets its row slice by slice.
    slices = lengths.filter("own > head").select(
        "conv_id", "head", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(own - 1) div {SLICE}"))).alias("slice"),
    )
    own = turns.withColumn("slice", F.expr(f"place div {SLICE}")).join(slices, ["conv_id", "slice"])
    later = own.filter(F.col("place") >= F.col("head")).select(
        "conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("place"), "a", "b"
    )
    return first.unionByName(later)


def rebuilt_lengths(turns: DataFrame) -> DataFrame:
    """Per conversation its ``base``, ``head`` (turns it may take), ``taken`` (turns it takes), ``own`` turns and ``length``."""
    head = F.crc32(F.col("conv_id").cast("string")) % HEAD
    own = stored(
        turns.groupBy("conv_id").agg((F.max("place") + 1).alias("own")).select(
            "conv_id", "own", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base")
        ),
        "trie-lengths",
    )
    bases = own.select(F.col("conv_id").alias("base"), F.col("own").alias("based"))
    taken = F.least("head", F.coalesce("based", F.lit(0)))
    return own.join(bases, "base", "left").select(
        "conv_id", "base", "head", taken.alias("taken"), "own",
        (taken + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length"),
    )


def _names(seed: int, depth: Column, a: Column, b: Column) -> Column:
    return F.xxhash64(F.lit(seed), depth, a, b)


def blocks(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per conversation and block: its turn columns, the node before it, and the node it ends in.

    A conversation without turns has one block without any.
    """
    depth = F.col("place") + 1
    within = F.col("place") % WIDTH
    columns = [
        F.max(F.when(within == n, F.col(c))).alias(f"{c}{n + 1}") for n in range(WIDTH) for c in ("a", "b")
    ]
    filled = turns.groupBy("conv_id", F.expr(f"place div {WIDTH}").alias("block")).agg(
        *columns, F.count(F.lit(1)).alias("turns"),
        *[F.bit_xor(_names(n, depth, F.col("a"), F.col("b"))).alias(f"x{n}") for n in (1, 2)],
    )
    zero = F.lit(0).cast("long")
    bare = lengths.filter("length = 0").select("conv_id").withColumns(
        {"block": zero}
        | {f"{c}{n + 1}": F.lit(None).cast("long") for n in range(WIDTH) for c in ("a", "b")}
        | {"turns": zero, "x1": zero, "x2": zero}
    )
    sliced = stored(filled.unionByName(bare).withColumn("slice", F.expr(f"block * {WIDTH} div {SLICE}")), "trie-filled")
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy("conv_id", "slice").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    carried = totals.select(
        "conv_id", "slice", *[F.coalesce(F.bit_xor(f"x{n}").over(earlier), F.lit(0)).alias(f"c{n}") for n in (1, 2)]
    ).filter("slice > 0")
    inside = Window.partitionBy("conv_id", "slice").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumns({f"l{n}": F.coalesce(F.bit_xor(f"x{n}").over(inside), F.lit(0)) for n in (1, 2)})
    named = local.join(carried, ["conv_id", "slice"], "left").withColumns(
        {f"p{n}": F.col(f"l{n}").bitwiseXOR(F.coalesce(f"c{n}", F.lit(0))) for n in (1, 2)}
    )
    ends = {f"e{n}": F.col(f"p{n}").bitwiseXOR(F.col(f"x{n}")) for n in (1, 2)}
    return stored(named.withColumns(ends).drop("l1", "l2", "c1", "c2", "x1", "x2"), "trie-blocks")


TURNS = ", ".join(f"(a{n}, b{n})" for n in range(1, WIDTH + 1))


def rolled(rows: DataFrame, *sums: str) -> DataFrame:
    """All prefixes of the blocks: ``depth``, node (``q1``, ``q2``), parent (``u1``, ``u2``), ``bytes`` of the last text.

    The key of a node follows from its block and its turn columns. Columns that ROLLUP has left out are null and count
    for nothing; a group whose last column is null only repeats a shorter prefix, and so does a block's empty prefix but
    the first block's.
    """
    spark = rows.sparkSession
    grouped = spark.sql(
        f"SELECT block, p1, p2, {', '.join(f'a{n}, b{n}' for n in range(1, WIDTH + 1))}, "
        f"grouping_id() AS left_out, count(*) AS n_convs, min(conv_id) AS conv_id"
        + "".join(f", sum({name}) AS {name}" for name in sums)
        + f" FROM {{rows}} GROUP BY block, p1, p2, ROLLUP({TURNS})",
        rows=rows,
    ).withColumn("level", F.lit(WIDTH) - F.bit_count("left_out") / 2).withColumn("level", F.col("level").cast("int"))
    last_a = F.coalesce(*[F.when(F.col("level") == n, F.col(f"a{n}")) for n in range(1, WIDTH + 1)])
    last_b = F.coalesce(*[F.when(F.col("level") == n, F.col(f"b{n}")) for n in range(1, WIDTH + 1)])
    live = grouped.withColumns({"a": last_a, "b": last_b}).filter(
        F.col("a").isNotNull() | ((F.col("level") == 0) & (F.col("block") == 0))
    )

    def place(n: int) -> Column:
        return F.col("block") * WIDTH + n

    def path(seed: int) -> Column:
        out = F.col(f"p{seed}")
        for n in range(1, WIDTH + 1):
            here = _names(seed, place(n), F.col(f"a{n}"), F.col(f"b{n}"))
            out = out.bitwiseXOR(F.when(F.col("level") >= n, here).otherwise(0))
        return out

    depth = F.col("block") * WIDTH + F.col("level")
    nodes = live.select(
        depth.alias("depth"), path(1).alias("q1"), path(2).alias("q2"), "a", "b", "n_convs", "conv_id", *sums
    )
    above = {
        f"u{n}": F.when(F.col("depth") > 0, F.col(f"q{n}").bitwiseXOR(_names(n, F.col("depth"), F.col("a"), F.col("b"))))
        for n in (1, 2)
    }
    length = F.coalesce(F.col("b").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0)).cast("long")
    return nodes.withColumns(above | {"bytes": length}).drop("a", "b")


def ends(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per node (``depth``, ``q1``, ``q2``) that conversations end in, ``ends_sha256`` of their ids in order.

    Ids are sorted over range partitions, so a node's ids lie in many; each writes its ids as pieces of text. The pieces
    of a node are read in order by one task, which holds one at a time.
    """
    last = rows.join(
        lengths.select("conv_id", "length", F.expr(f"greatest(length - 1, 0) div {WIDTH}").alias("block")), ["conv_id", "block"]
    ).select(F.col("e1").alias("q1"), F.col("e2").alias("q2"), F.col("length").alias("depth"), "conv_id")
    order = ("q1", "q2", "depth", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, held, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [dict(zip(("q1", "q2", "depth"), at), first=first, ids=",".join(held))], schema=listed
            )

        listed = pa.schema([*((n, pa.int64()) for n in ("q1", "q2", "depth", "first")), ("ids", pa.string())])
        for batch in batches:
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (node != at or size >= PIECE):
                    yield piece()
                    held, size = [], 0
                if not held:
                    at, first = node, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield piece()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, done = None, None, []
        found = pa.schema([*((n, pa.int64()) for n in ("q1", "q2", "depth")), ("ends_sha256", pa.string())])
        for batch in batches:
            for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = node, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(found.names, row)) for row in done], schema=found)
                done = []
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(found.names, (*at, digest.hexdigest())))], schema=found)

    listed = last.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        pieces, "q1 long, q2 long, depth long, first long, ids string"
    )
    return (
        listed.repartition("q1", "q2", "depth").sortWithinPartitions("q1", "q2", "depth", "first")
        .mapInArrow(digests, "q1 long, q2 long, depth long, ends_sha256 string")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    own = numbered(turn_ids(conversations))
    lengths = stored(rebuilt_lengths(own), "trie-rebuilt")
    rows = blocks(rebuilt(own, lengths), lengths)
    key = ["depth", "q1", "q2"]

    first = stored(rolled(rows), "trie-nodes")
    children = first.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("u1").alias("q1"), F.col("u2").alias("q2")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(
        first.join(children, key, "left").withColumns({
            "n_children": F.coalesce("n_children", F.lit(0).cast("long")),
            "leaf": F.col("n_children").isNull().cast("long"),
            "saved": (F.col("n_convs") - 1) * F.col("bytes"),
        }),
        "trie-family",
    )

    # What a conversation represents, handed to its blocks slice by slice.
    shares = nodes.groupBy("conv_id").agg(
        F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"), F.min("depth").alias("top")
    )
    slices = rows.select("conv_id", "slice").distinct()
    shared = slices.join(shares, "conv_id").select("conv_id", "slice", "leaves", "saved")
    summed = rolled(
        rows.join(shared, ["conv_id", "slice"], "left").withColumns(
            {n: F.coalesce(n, F.lit(0).cast("long")) for n in ("leaves", "saved")}
        ),
        "leaves", "saved",
    ).select(*key, "leaves", "saved")

    # What a node's representative represents above the node.
    parts = nodes.withColumn("slice", F.expr(f"depth div {SLICE}"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.groupBy("conv_id", "slice").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).select(
        "conv_id", "slice", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in ("leaf", "saved")]
    ).filter("slice > 0")
    inside = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = parts.withColumns({f"{n}_above": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in ("leaf", "saved")}).join(
        carried, ["conv_id", "slice"], "left"
    ).select(
        *key, F.col("conv_id"), "n_convs", "n_children",
        *[(F.col(f"{n}_above") + F.coalesce(f"{n}_before", F.lit(0))).alias(f"{n}_above") for n in ("leaf", "saved")],
    )

    # A node has its parent's representative, unless it is the first one on its representative's run. Below the root,
    # which may have more children than any other node, the parent is known.
    tops = nodes.join(shares.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"]).filter("depth > 1")
    named = tops.select(*key, (F.col("depth") - 1).alias("depth_above"), "u1", "u2").join(
        nodes.select(
            F.col("depth").alias("depth_above"), F.col("q1").alias("u1"), F.col("q2").alias("u2"),
            F.col("conv_id").alias("parent"),
        ),
        ["depth_above", "u1", "u2"],
    ).select(*key, "parent")
    root = nodes.filter("depth = 0").select(F.min("conv_id")).scalar()
    parent = F.when(F.col("depth") == 1, root).when(F.col("depth") > 1, F.coalesce("parent", "conv_id"))

    return (
        above.join(summed, key).join(named, key, "left").join(ends(rows, lengths), key, "left")
        .select(
            "conv_id", "depth", parent.alias("parent_conv_id"),
            "n_convs", "n_children", (F.col("leaves") - F.col("leaf_above")).alias("n_leaves"),
            (F.col("saved") - F.col("saved_above")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
