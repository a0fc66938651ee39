"""Ordered per-group streams that stay correct when one group is huge.

A normal match is a few thousand rows: window functions partitioned by match are the right
plan. A group above the row limit is cut into blocks of consecutive rows instead. Blocks are
built from a dense position (range partitioning plus per-partition offsets), neighbours come
from rows copied over the block edge, and running aggregates add the total of earlier blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitchloom.runtime import BLOCK_ROWS, durable

POSITION = "_position"


def dense_position(df: DataFrame, keys, order, name: str = POSITION) -> DataFrame:
    """0-based position inside each group without ever gathering a group in one task."""
    keys, order = list(keys), list(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(
        df.repartitionByRange(max(parts, 2), *keys, *order).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    local = Window.partitionBy("_part", *keys).orderBy(*order)
    earlier = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy("_part", *keys)
        .count()
        .withColumn("_offset", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .drop("count")
    )
    return (
        ranged.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, ["_part", *keys])
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop("_part", "_local", "_offset")
    )


def global_position(df: DataFrame, order, name: str = POSITION) -> DataFrame:
    """0-based dense position over a whole table, ordered, without a single-task sort."""
    return dense_position(df.withColumn("_all", F.lit(0)), ["_all"], order, name).drop("_all")


def block_neighbours(
    df: DataFrame, keys, specs: dict[str, tuple[str, int]], block: int = BLOCK_ROWS
) -> DataFrame:
    """Values at fixed offsets (negative: earlier) on a densely positioned stream."""
    ahead = max([n for _, n in specs.values()] + [0])
    back = max([-n for _, n in specs.values()] + [0])
    if max(ahead, back) > block:
        raise ValueError("block must be at least as long as the furthest offset")
    own = F.floor(F.col(POSITION) / block)
    inside = F.col(POSITION) % block
    copies = [own]
    if ahead:
        copies.append(F.when((inside < ahead) & (own > 0), own - 1))
    if back:
        copies.append(F.when(inside >= block - back, own + 1))
    window = Window.partitionBy(*keys, "_block").orderBy(POSITION)
    spread = df.withColumn("_block", F.explode(F.array_compact(F.array(*copies))))
    return (
        spread.withColumns(
            {
                name: F.lead(col, n).over(window) if n > 0 else F.lag(col, -n).over(window)
                for name, (col, n) in specs.items()
            }
        )
        .where(F.col("_block") == own)
        .drop("_block")
    )


def block_running(
    df: DataFrame, keys, specs: dict[str, tuple[Column, str]], block: int = BLOCK_ROWS
) -> DataFrame:
    """Inclusive running 'sum' or 'max' on a densely positioned stream."""
    keys = list(keys)
    folds = {"sum": F.sum, "max": F.max}
    df = df.withColumn("_block", F.floor(F.col(POSITION) / block))
    df = df.withColumns({f"_in_{name}": expr for name, (expr, _) in specs.items()})
    earlier = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = df.groupBy(*keys, "_block").agg(
        *[folds[how](f"_in_{name}").alias(f"_total_{name}") for name, (_, how) in specs.items()]
    )
    carried = totals.select(
        *keys, "_block",
        *[
            folds[how](f"_total_{name}").over(earlier).alias(f"_carry_{name}")
            for name, (_, how) in specs.items()
        ],
    )
    here = (
        Window.partitionBy(*keys, "_block")
        .orderBy(POSITION)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = df.join(carried, [*keys, "_block"])
    for name, (_, how) in specs.items():
        running = folds[how](f"_in_{name}").over(here)
        carry = F.col(f"_carry_{name}")
        if how == "sum":
            merged = F.coalesce(carry, F.lit(0)) + F.coalesce(running, F.lit(0))
        else:
            merged = F.greatest(carry, running)
        out = out.withColumn(name, merged)
    return out.drop(
        "_block", *[f"_in_{n}" for n in specs], *[f"_carry_{n}" for n in specs]
    )


def prefix_totals(df: DataFrame, keys, bucket: str, sums: dict[str, str]) -> DataFrame:
    """Sums over strictly earlier buckets of each group; one row per (keys, bucket).

    Pre-aggregated by bucket first, so a hot group shrinks to its number of buckets.
    """
    earlier = (
        Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    per_bucket = df.groupBy(*keys, bucket).agg(
        *[F.sum(column).alias(f"_t_{name}") for name, column in sums.items()]
    )
    return per_bucket.select(
        *keys, bucket,
        *[
            F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(name)
            for name in sums
        ],
    )
