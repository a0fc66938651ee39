"""What several corpus operators share: tables, words, word counts, connected components."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pitchloom.runtime import staged

# Bytes of text that are split into words at once; longer texts are walked in slices of this size.
SLICE_BYTES = 1 << 20
# Distinct words one task holds before it hands its partial counts on.
COUNTER_WORDS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def byte_values(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null reads as empty."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def word_slices(data: bytes, size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Words between ASCII white space, in lists whose source text is about ``size`` bytes."""
    if len(data) <= size:
        yield data.split()
        return
    start = 0
    while start < len(data):
        end = min(len(data), start + size)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            # Cut only at white space, so a longer word is kept whole.
            following = [p for p in (data.find(c, end, end + size) for c in
                                     (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) if p >= 0]
            end = min(following) if following else min(len(data), end + size)
        yield data[start:end].split()
        start = end


def word_counts(texts: DataFrame, ends: bool = False) -> DataFrame:
    """(word, count) over the column ``text``: words in lower-cased (A-Z) whole texts.

    Each task pre-aggregates, so only distinct words of a task are shuffled. With ``ends`` every
    row also counts one end token, which is the empty string (no word is empty).
    """

    def count(batches):
        held = Counter()
        for batch in batches:
            for data in byte_values(batch.column(0)):
                for words in word_slices(data.lower()):
                    held.update(words)
                if ends:
                    held[b""] += 1
                if len(held) > COUNTER_WORDS:
                    yield from _partial(held)
                    held = Counter()
        yield from _partial(held)

    def _partial(held):
        words = list(held)
        for at in range(0, len(words), 50_000):
            part = words[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), pa.array([held[w] for w in part], pa.int64())],
                names=["word", "n"],
            )

    partial = texts.select("text").mapInArrow(count, "word binary, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b), for nodes with an edge.

    Alternating star contraction: every node points its larger neighbours, then its smaller ones,
    at the smallest of them. The number of rounds grows with the logarithm of the path length and
    no round makes more edges than it was given. Each round is written out, so a lost executor
    costs one round. The minimum is pre-aggregated and joined back, which adaptive execution can
    split when one node has very many neighbours.
    """
    current = staged(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = _mark(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("low"))
        large = (
            both.join(smallest, "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()
        )
        smallest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(smallest, "u")
            .select(F.explode(F.array(
                F.struct(F.col("u"), F.col("low").alias("v")),
                F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
            )).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        )
        current = staged(small)
        now = _mark(current)
        if now == before:
            break
        before = now
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots)


def union_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the labels of linked rows a[k] and b[k], in place, to the smallest of each linked set."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")),
    ).first())
