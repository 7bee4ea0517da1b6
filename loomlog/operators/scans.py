"""Ordered scans that never put an unbounded key into one task.

Spark's own window is right for small keys, but it sorts a whole key in one task. Logs here are
ordered over sessions, or over everything, so one key may be a third of the data. Both helpers cut
the order into slices, work inside slices, and carry small per-slice totals across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomlog.session import Keep, SLICE_ROWS, pinned


def running(
    df: DataFrame,
    order: str,
    keys: Sequence[str] = (),
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    ties: Sequence[Column | str] = (),
    slice_rows: int = SLICE_ROWS,
    carriers: DataFrame | None = None,
) -> DataFrame:
    """Running totals and running last-non-null values up to and including each row.

    ``order`` must be a non-null whole number (a line number, say); ``ties`` orders equal numbers.
    Rows ``[k * slice_rows, (k + 1) * slice_rows)`` form slice ``k``: the scan runs inside slices and
    takes what came before from one row per slice. ``carriers`` may name other rows
    to take the per-slice totals from: all that carry values, and at least one row in every slice.
    """
    sums, lasts, keys = sums or {}, lasts or {}, list(keys)
    position = F.struct(F.col(order).alias("_o"), *[F.col(t) if isinstance(t, str) else t for t in ties])
    inputs = {f"_in_{n}": e for n, e in {**sums, **lasts}.items()}
    added = {"_slice": F.floor(F.col(order) / F.lit(slice_rows)), **inputs, "_position": position}
    sliced = df.withColumns(added)

    inside = Window.partitionBy(*keys, "_slice").orderBy("_position").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = {n: F.sum(f"_in_{n}").over(inside) for n in sums}
    local |= {n: F.last(f"_in_{n}", ignorenulls=True).over(inside) for n in lasts}

    totals = (sliced if carriers is None else carriers.withColumns(added)).groupBy(*keys, "_slice").agg(
        *[F.sum(f"_in_{n}").alias(f"_end_{n}") for n in sums],
        *[
            F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col("_position"))).alias(f"_end_{n}")
            for n in lasts
        ],
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_slice").alias("_key_slice"),
        *[F.sum(f"_end_{n}").over(earlier).alias(f"_carry_{n}") for n in sums],
        *[F.last(f"_end_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in lasts],
    )
    same = F.col("_slice") == F.col("_key_slice")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    joined = sliced.withColumns(local).join(carried, same, "left")
    result = {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0)) for n in sums}
    result |= {n: F.coalesce(F.col(n), F.col(f"_carry_{n}")) for n in lasts}
    return joined.withColumns(result).select(*df.columns, *[n for n in result if n not in df.columns])


def dense_order(
    df: DataFrame,
    by: Sequence[Column | str],
    keys: Sequence[str] = (),
    name: str = "order",
    start: int | Column = 0,
    partitions: int | None = None,
    keep: Keep | None = None,
) -> DataFrame:
    """Exact positions ``start + 1 ...`` by a total sort order, over everything or per key.

    The rows are range-partitioned and sorted once and written to the checkpoint folder, so the
    pass that counts rows per partition and the pass that numbers them see the same partitions even
    if executors are lost in between. Only one count per partition meets in a single task. With ``keep`` the sorted rows and
    the first place of each key are written by it instead, compressed and not for good, and keys that turn out to be few are
    joined without another shuffle of the rows.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(c) if isinstance(c, str) else c for c in [*keys, *by]]
    ranged = df.repartitionByRange(count, *columns).sortWithinPartitions(*columns)
    placed = ranged.withColumn("_place", F.monotonically_increasing_id())
    placed = keep(placed, f"{name}_placed") if keep else pinned(placed)

    part = F.shiftright(F.col("_place"), 33)
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition: at most `count` rows, so broadcasting it is bounded.
    offsets = sizes.select(
        F.col("_part"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        "_rank", F.col("_offset") + within + 1
    )
    if keys:
        firsts = numbered.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(
            F.min("_rank").alias("_first")
        )
        firsts = keep(firsts, f"{name}_firsts") if keep else firsts
        same = None
        for key in keys:
            test = F.col(key).eqNullSafe(F.col(f"_key_{key}"))
            same = test if same is None else same & test
        numbered = numbered.join(firsts, same).withColumn("_rank", F.col("_rank") - F.col("_first") + 1)
    begin = F.lit(start) if isinstance(start, int) else start
    rank = (F.col("_rank") + begin).cast("bigint")
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return numbered.select(*kept, rank.alias(name))
