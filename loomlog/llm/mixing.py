"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Each pattern offers its words once
for nothing, a second time at a cost, a third at a higher one, up to ``repeats`` times; each source takes its quota.
Costs sit on the offers alone, so the cheapest flow is found by filling level after level with augmenting paths. The
flow is solved on the driver over one node per pattern and source. What a pattern has to give is taken from its
documents in an order seeded by a hash: whole passes first, then documents up to the words still missing, of which the
last one gives only the missing part. Running totals of a pattern are kept per slice of the hash, and only the slice
where the total is reached is sorted, so a source with a third of all documents is no single task.

Null texts have no words and are taken with 0. A null source is a source of its own, last in order. Rows that repeat a
``doc_id`` count as documents of their own. An empty table gives an empty result. Sizes are those of whole texts.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.llm.common import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SEED = 17
# Slices of the seeded order of a pattern.
SLICES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, repeats: int = REPEATS) -> list[float]:
    """Shares of ``total`` by weight; what lies above ``repeats`` times a size is shared anew among the others."""
    found: list[float | None] = [None] * len(sizes)
    left, rest = float(total), list(range(len(sizes)))
    while rest:
        per_weight = left / sum(weights[n] for n in rest)
        above = [n for n in rest if per_weight * weights[n] > repeats * sizes[n]]
        if not above:
            for n in rest:
                found[n] = per_weight * weights[n]
            break
        for n in above:
            found[n] = float(repeats * sizes[n])
            left -= found[n]
        rest = [n for n in rest if found[n] is None]
    return [x or 0.0 for x in found]


def quotas(shares: Sequence[float]) -> list[int]:
    """Whole numbers with the same rounded sum; the largest remainders are rounded up."""
    whole = [int(x) for x in shares]
    missing = round(sum(shares)) - sum(whole)
    for n in sorted(range(len(shares)), key=lambda n: whole[n] - shares[n])[:max(0, missing)]:
        whole[n] += 1
    return whole


def cheapest_flow(
    supplies: Sequence[int], members: Sequence[Sequence[int]], wanted: Sequence[int], repeats: int = REPEATS
) -> list[dict[int, int]]:
    """For each pattern the words it gives to each of its sources.

    ``members[p]`` are the sources of pattern ``p``. The k-th use of a pattern costs more than all before, so uses are
    opened level by level; within a level, breadth-first augmenting paths move earlier words between sources.
    """
    flow: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
    givers: list[set[int]] = [set() for _ in wanted]
    missing = list(wanted)
    for _ in range(repeats):
        offers = list(supplies)
        for pattern in range(len(supplies)):
            while offers[pattern] and (path := _path(pattern, members, givers, missing)):
                # path: pattern, source, pattern, source, ..., source
                amount = min(
                    offers[pattern], missing[path[-1]], *(flow[path[n + 1]][path[n]] for n in range(1, len(path) - 1, 2))
                )
                for n in range(0, len(path), 2):
                    flow[path[n]][path[n + 1]] += amount
                    givers[path[n + 1]].add(path[n])
                    if n:
                        flow[path[n]][path[n - 1]] -= amount
                        if not flow[path[n]][path[n - 1]]:
                            givers[path[n - 1]].discard(path[n])
                offers[pattern] -= amount
                missing[path[-1]] -= amount
    return flow


def _path(
    start: int, members: Sequence[Sequence[int]], givers: Sequence[set[int]], missing: Sequence[int]
) -> list[int] | None:
    """A shortest way from a pattern to a source that lacks words; other patterns may move theirs aside."""
    from_pattern: dict[int, int] = {}
    from_source: dict[int, int] = {start: -1}
    queue = deque([start])
    while queue:
        pattern = queue.popleft()
        for source in members[pattern]:
            if source in from_pattern:
                continue
            from_pattern[source] = pattern
            if missing[source]:
                path = [source]
                while True:
                    path.append(from_pattern[path[-1]])
                    if path[-1] == start:
                        return path[::-1]
                    path.append(from_source[path[-1]])
            for other in givers[source]:
                if other not in from_source:
                    from_source[other] = source
                    queue.append(other)
    return None


class Mix(NamedTuple):
    """``documents``: doc_id, size, sources, further columns of the members, taken. ``sources``: source, source_size, target."""

    documents: DataFrame
    sources: DataFrame


def _cycle(weights: Sequence[float]) -> Callable[[int], float]:
    return lambda n: float(weights[n % len(weights)])


def mix(
    members: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED
) -> Mix:
    """Mix documents given as ``doc_id``, ``size`` (words) and ``sources`` (an array of names, null for none).

    Sources in the order of code points, null last, have the weights in turn; together they get ``share`` of all words.
    Further columns of ``members`` (such as a key of the row) are handed on.
    """
    spark = members.sparkSession
    handed = ["doc_id", "size", "sources", *(name for name in members.columns if name not in ("doc_id", "size", "sources"))]
    sources = F.array_sort(F.array_distinct("sources"))
    rows = stored(
        members.withColumn("sources", sources).select(
            *handed, F.to_json("sources").alias("pattern"),
            F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(SLICES)).cast("int").alias("slice"),
            F.xxhash64(F.lit(seed + 1), "doc_id").alias("rank"),
        ),
        "mix-documents",
    )
    slices = stored(
        rows.groupBy("pattern", "slice").agg(F.sum("size").alias("size"), F.first("sources").alias("sources")), "mix-slices"
    )
    # One row per membership pattern reaches the driver, never one per document.
    patterns = sorted(
        slices.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("sources").alias("sources")).collect(),
        key=lambda r: r["pattern"],
    )
    names = sorted({s for r in patterns for s in r["sources"]}, key=lambda s: (s is None, s or ""))
    number = {name: n for n, name in enumerate(names)}
    sizes = [0] * len(names)
    for r in patterns:
        for s in r["sources"]:
            sizes[number[s]] += r["size"]
    weight = _cycle(weights)
    wanted = targets(sizes, [weight(n) for n in range(len(names))], share * sum(r["size"] for r in patterns), repeats)
    flow = cheapest_flow(
        [r["size"] for r in patterns], [[number[s] for s in r["sources"]] for r in patterns], quotas(wanted), repeats
    )
    plan = spark.createDataFrame(
        [
            (r["pattern"], *(divmod(sum(given.values()), r["size"]) if r["size"] else (0, 0)))
            for r, given in zip(patterns, flow)
        ],
        "pattern string, passes long, rest long",
    )
    facts = spark.createDataFrame(list(zip(names, sizes, wanted)), "source string, source_size long, target double")

    # What a slice of a pattern gives: whole passes, and whether the pattern's rest is reached before, in or after it. Rows
    # are joined by pattern and slice, so a pattern of a third of all rows is as many keys as there are slices.
    running = W.partitionBy("pattern").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    parts = stored(
        slices.join(plan, "pattern")
        .withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .select(
            "pattern", "slice", "passes", (F.col("rest") - F.col("before")).alias("still"),
            ((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest"))).alias("edge"),
        ),
        "mix-parts",
    )
    planned = rows.join(parts, ["pattern", "slice"])
    passes = F.col("passes") * F.col("size")
    clear = planned.filter(~F.col("edge")).select(
        *handed, (passes + F.when(F.col("still") > 0, F.col("size")).otherwise(0)).alias("taken")
    )
    earlier = W.partitionBy("pattern").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    still = F.col("still") - F.coalesce(F.sum("size").over(earlier), F.lit(0))
    edge = planned.filter("edge").select(
        *handed, (passes + F.greatest(F.lit(0), F.least(F.col("size"), still))).alias("taken")
    )
    return Mix(clear.unionAll(edge), facts)


def mixed_documents(docs: DataFrame, **options) -> Mix:
    """Mix documents by their ``source``."""
    return mix(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), n_words().alias("size"),
            F.array(F.col("source").cast("string")).alias("sources"),
        ),
        **options,
    )


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document its size, its source's size and target, and the words that the mix takes of it."""
    found = mixed_documents(docs, **options)
    return found.documents.join(found.sources, F.col("sources")[0].eqNullSafe(F.col("source")), "left").select(
        "doc_id", "size", "source_size", "target", "taken"
    )
