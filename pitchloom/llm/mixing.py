"""Mixing sources to target weights by Pfair scheduling.

Every source's documents are dealt into blocks of equal size. Block j of a source with weight w may
be placed from slot floor((j - 1) / w) on and must be by slot ceil(j / w); the earliest deadline goes
first. Weights are exact fractions, so at any slot every source has had its share of the given weights
to within one block. One task walks the slots and writes a row for each block, which the documents
join; it holds one entry per source. Sources that end before the longest one has been placed once
begin again, so no document is left out and the shares hold to the end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pitchloom.runtime import staged

# Characters of a block, about one training sequence.
BLOCK_CHARS = 16_384
# Slots of a period where whole slots are wanted (``shares``); the mixture has no period.
PERIOD = 1_000
# Slots that are handed on at once.
BATCH_SLOTS = 1 << 16
# Default weights are the source's size to this power.
POWER = 0.7
# Buckets of the order in which a source's documents are placed, and rows aimed at in each.
LEAST_BUCKETS, BUCKET_ROWS = 256, 20_000
# Characters aimed at in a file of mixed documents.
FILE_CHARS = 64 << 20
# Passes of a document that one step lists.
PASSES = 4_096
SEED = 11


def shares(weights: dict, period: int) -> dict:
    """Whole slots of a period for each source, at least one, nearest to its weight."""
    total = sum(weights.values())
    exact = {s: period * w / total for s, w in weights.items()}
    given = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (given[s] - exact[s], str(s)))
    at = 0
    while sum(given.values()) != period:
        more = sum(given.values()) < period
        source = order[at % len(order)] if more else order[-1 - at % len(order)]
        if more or given[source] > 1:
            given[source] += 1 if more else -1
        at += 1
    return given


def whole_weights(weights: dict) -> dict:
    """The exact weights as whole numbers over a common denominator, their sum."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    over = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * over) for s, w in exact.items()}


def placements(parts: list[int], first: list[int] | None = None, end: int | None = None) -> Iterator[int]:
    """The number of the source of each slot, for whole-number weights: earliest deadline first.

    Without ``end`` it goes on for ever. With it, the ``first`` blocks of every source are due by slot
    ``end`` at the latest, and the slots stop there. A missed deadline raises an error; without ``end``
    there is none.
    """
    total = sum(parts)
    done = [0] * len(parts)

    def due(source):
        j = done[source] + 1
        deadline = -(-j * total // parts[source])
        return min(deadline, end) if end is not None and j <= first[source] else deadline

    ready = [(due(s), s) for s in range(len(parts))]
    heapq.heapify(ready)
    waiting: list[tuple] = []
    slot = 0
    while end is None or slot < end:
        while waiting and waiting[0][0] <= slot:
            source = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (due(source), source))
        deadline, source = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a block missed its deadline")
        yield source
        done[source] += 1
        heapq.heappush(waiting, (done[source] * total // parts[source], source))
        slot += 1
    if any(n < least for n, least in zip(done, first or [])):
        raise AssertionError("a block missed its deadline")


def horizon(parts: list[int], first: list[int]) -> int:
    """Slots of the mixture: enough for the ``first`` blocks of every source, each within its window.

    The least is where the last of them may be placed. A small source's only block can be due long
    after that, so an end is tried before its deadline; ends grow by a quarter until one is kept.
    Several such sources can stretch the mixture, as far as the largest n / w at most: shares come first.
    """
    total = sum(parts)
    least = max((n - 1) * total // w + 1 for w, n in zip(parts, first))
    most = max(-(-n * total // w) for w, n in zip(parts, first))
    end = max(least, sum(first))
    while end < most:
        try:
            for _ in placements(parts, first, end):
                pass
            return end
        except AssertionError:
            end += max(1, end // 4)
    return most


def schedule(given: dict) -> list:
    """The sources of one period's slots, for weights of whole numbers."""
    order = sorted(given, key=str)
    return [order[k] for k in islice(placements([given[s] for s in order]), sum(given.values()))]


def mix(docs: DataFrame, weights: dict | None = None, block_chars: int = BLOCK_CHARS,
        carry=("doc_id", "source")) -> DataFrame:
    """The columns ``carry`` of ``docs`` with pass, slot and offset, once for each pass.

    ``docs`` has doc_id, source, text and any others. A document counts its characters plus one, so
    empty and null texts are placed too. slot: the block's place in the mixture; offset: where in the
    block the document begins; pass: 0 when a document is placed first. A block holds the documents
    that begin in it. Null is a source of its own. Sources that ``weights`` leaves out, or gives no
    positive weight, raise an error, because their documents could not be placed. One row of
    ``weights`` or of sizes per source comes to the driver. Ties in the order of documents are broken
    by id; repeated rows are placed each.
    """
    spark = docs.sparkSession
    rows = docs.select(
        *carry, F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("_size"),
        F.col("source").alias("_source"), F.xxhash64(F.lit(SEED), "doc_id").alias("_order"),
        F.col("doc_id").alias("_id"),
    ).withColumn("_size", F.col("_size") + 1)
    n = docs.count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(LEAST_BUCKETS, 4 * partitions, n // BUCKET_ROWS)
    # High bits of the order give the bucket, so buckets follow each other in the order.
    rows = rows.withColumn(
        "_bucket", F.floor((F.shiftrightunsigned("_order", 11) / F.lit(float(1 << 53))) * buckets).cast("int"))
    sizes = staged(rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_total")))
    totals = {r["_source"]: r["n"] for r in
              sizes.groupBy("_source").agg(F.sum("_total").alias("n")).collect()}
    empty = rows.select(*carry, F.lit(0).cast("long").alias("pass"), F.lit(0).cast("long").alias("slot"),
                        F.lit(0).cast("long").alias("offset"))
    if not totals:
        return empty
    weights = weights or {source: size ** POWER for source, size in totals.items()}
    missing = [s for s in totals if not weights.get(s, 0) > 0]
    if missing:
        raise ValueError(f"sources without a positive weight: {missing[:10]}")
    order = sorted(totals, key=str)
    exact = whole_weights({s: weights[s] for s in totals})
    parts, first = [exact[s] for s in order], [-(-totals[s] // block_chars) for s in order]

    def place(batches):
        for _ in batches:
            done, at = np.zeros(len(parts), np.int64), 0
            slots = placements(parts, first, horizon(parts, first))
            while len(sources := np.fromiter(islice(slots, BATCH_SLOTS), np.int32)):
                # A source's blocks in a batch are numbered on from those before.
                sort = np.argsort(sources, kind="stable")
                had = np.bincount(sources, minlength=len(parts))
                block = np.empty(len(sources), np.int64)
                block[sort] = np.arange(len(sources)) + np.repeat(done - np.cumsum(had) + had, had)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sources), pa.array(block), pa.array(at + np.arange(len(sources)))],
                    names=["_number", "_block", "slot"])
                done, at = done + had, at + len(sources)

    slots = staged(spark.range(1, numPartitions=1).mapInArrow(place, "_number int, _block bigint, slot bigint"))
    blocks = {r["_number"]: r["n"] for r in slots.groupBy("_number").agg(F.count("slot").alias("n")).collect()}
    plan = spark.createDataFrame(
        [(s, k, totals[s], blocks[k] * block_chars) for k, s in enumerate(order)],
        "_source string, _number int, _all bigint, _until bigint",
    ).withColumn("_source", F.col("_source").cast(docs.schema["source"].dataType))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_source", "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = (
        Window.partitionBy("_bucket", "_source").orderBy("_order", "_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        rows.repartition("_bucket")
        .withColumn("_within", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    )
    same = placed["_source"].eqNullSafe(starts["_source"]) & (placed["_bucket"] == starts["_bucket"])
    placed = placed.join(starts, same).drop(starts["_source"]).drop(starts["_bucket"])
    same = placed["_source"].eqNullSafe(plan["_source"])
    placed = placed.join(F.broadcast(plan), same).drop(plan["_source"])
    start = F.col("_start") + F.col("_within")
    # In two steps, so that the arrays stay short however often a source is placed.
    last = F.expr("(_until - 1 - _first) div _all")
    some = F.expr(f"sequence(_from, least(_last, _from + {PASSES - 1}))")
    return (
        placed.withColumn("_first", start).where("_first < _until")
        .withColumn("_last", last)
        .withColumn("_from", F.explode(F.expr(f"sequence(0L, _last, {PASSES}L)")))
        .withColumn("pass", F.explode(some))
        .withColumn("_at", F.expr("_first + pass * _all"))
        .withColumn("_block", F.expr(f"_at div {block_chars}"))
        .join(slots, ["_number", "_block"])
        .select(*carry, "pass", "slot", F.expr(f"_at % {block_chars}").alias("offset"))
    )


def mixed_documents(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """``docs`` in the order of the mixture, a document once for each pass, with its own columns only.

    Rows are placed by two hashes of all their columns; equal rows share them, and one of them then meets
    all of their places. So texts move twice: to their places, and into the stretch of the
    mixture that a file holds, in its order.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", "text").withColumns(
        {"_k1": F.xxhash64("_row"), "_k2": F.xxhash64(F.lit(SEED), "_row")})
    placed = staged(mix(keyed, weights, carry=("_k1", "_k2")).select("_k1", "_k2", "slot", "offset"))
    slots = (placed.agg(F.max("slot")).first()[0] or 0) + 1
    files = max(spark.sparkContext.defaultParallelism, slots * BLOCK_CHARS // FILE_CHARS)
    one = Window.partitionBy("_k1", "_k2").orderBy("_k1")
    texts = keyed.select("_k1", "_k2", "_row").withColumn("_copy", F.row_number().over(one)).where("_copy = 1")
    ordered = (
        texts.hint("merge").join(placed, ["_k1", "_k2"])
        .repartitionById(files, F.expr(f"CAST(slot * {files} div {slots} AS INT)"))
        .sortWithinPartitions("slot", "offset")
    )
    return ordered.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def deviation(slots: list, given: dict) -> Fraction:
    """The largest distance in blocks between a source's blocks so far and its share of the slots."""
    period, had, worst = sum(given.values()), dict.fromkeys(given, 0), Fraction(0)
    for at, source in enumerate(slots, 1):
        had[source] += 1
        worst = max(worst, *(abs(had[s] - Fraction(at * given[s], period)) for s in given))
    return worst
