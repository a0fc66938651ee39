"""Toxicity: a linear classifier on hashed character n-grams scaled by naive Bayes ratios.

An n-gram's value in a text is its naive Bayes log-count ratio if the text holds it, else zero, and
a logistic model weighs these values: ratios above zero speak for toxic texts, those below for clean ones.
The ratios are counted over the labelled texts of the fit. N-grams whose ratio is within chance are left
out of the model, and texts that repeat count once, so a large group of copies cannot pass for evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, functions as F

from pitchloom.llm.common import byte_values, remainder
from pitchloom.runtime import staged

# Lengths in code points of the n-grams, and how many hash slots they share.
LENGTHS = (4, 5, 6)
SLOTS = 1 << 20
# Features of the linear model, and the least |ratio| in standard deviations that a feature needs.
FEATURES = 8192
LEAST_SIGMA = 3.0
# Added to each count before the ratio is taken.
SMOOTHING = 0.5
# Labelled rows that a model is fitted on, at most, and the seed of their choice.
MOST_ROWS, SEED = 40_000, 5
# Rows of the table of partial counts.
BLOCKS = 64
THRESHOLD = 0.7
# Characters of text whose n-grams are hashed at once.
PIECE = 1 << 20


@dataclass
class Model:
    """slots: feature slots in rising order; weights: what the presence of each adds to the margin."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float


def present(data: bytes, wanted: np.ndarray) -> np.ndarray:
    """The different slots that the lower-cased (A-Z) text's n-grams hit and ``wanted`` marks.

    White space runs count as one space, and the text's ends as a space.
    """
    text = (b" " + b" ".join(data.lower().split()) + b" ").decode("utf-8", "replace")
    found = []
    for at in range(0, len(text), PIECE):
        # Neighbouring pieces share what an n-gram over the cut needs.
        part = text[at:at + PIECE + max(LENGTHS) - 1].encode("utf-32-le", "surrogatepass")
        chars = np.frombuffer(part, "<u4").astype(np.uint64)
        for n in LENGTHS:
            if len(chars) < n:
                continue
            value = np.full(len(chars) - n + 1, n, np.uint64)
            for k in range(n):
                value = value * np.uint64(0x9E3779B97F4A7C15) + chars[k:len(chars) - n + 1 + k]
            value = (value * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)
            found.append(np.unique(value[wanted[value]]))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.empty(0, np.int64)


def _counts(texts: DataFrame) -> np.ndarray:
    """[class, slot]: in how many texts (text, toxic) of a class a slot is present."""
    width = 2 * SLOTS // BLOCKS

    def partial(batches):
        held, every = np.zeros((2, SLOTS), np.int64), np.ones(SLOTS, bool)
        for batch in batches:
            for data, label in zip(byte_values(batch.column(0)), batch.column(1).to_pylist()):
                held[label, present(data, every)] += 1
        flat = held.reshape(BLOCKS, width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BLOCKS), pa.int32()), pa.array([row.tobytes() for row in flat], pa.binary())],
            names=["block", "counts"])

    def total(batches):
        # A task adds up what it is sent as it comes, so it holds one row of sums for each block.
        held: dict = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[block] = held.get(block, 0) + np.frombuffer(counts, np.int64)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())],
                names=["block", "counts"])

    kind = "block int, counts binary"
    summed = texts.mapInArrow(partial, kind).repartition("block").mapInArrow(total, kind)
    result = np.zeros((BLOCKS, width), np.int64)
    for row in summed.toLocalIterator():
        result[row["block"]] += np.frombuffer(row["counts"], np.int64)
    return result.reshape(2, SLOTS)


def log_ratios(counts: np.ndarray, clean: int, toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-count ratio, its size in standard deviations) of each slot, from the texts of both classes that
    hold it; a slot of fewer than two texts is within chance."""
    of_clean, of_toxic = counts + SMOOTHING
    ratio = np.log(of_toxic / (toxic + 2 * SMOOTHING)) - np.log(of_clean / (clean + 2 * SMOOTHING))
    sigma = np.abs(ratio) / np.sqrt(1 / of_toxic + 1 / of_clean)
    sigma[counts.sum(axis=0) < 2] = 0
    return ratio, sigma


def fit(labelled: DataFrame) -> Model:
    """A model from (text, toxic 0 or 1). Null labels are left out, equal texts count once.

    A text that is labelled both ways counts as toxic. Without texts of both classes the model
    has no features and gives every text the smoothed share of toxic ones.
    """
    known = labelled.where("toxic in (0, 1)").select(
        F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    # The digest stands for the text while copies are found; the text itself is carried once.
    texts = staged(
        known.groupBy(F.sha2("text", 256).alias("digest"))
        .agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("text", "toxic")
    )
    sizes = {row["toxic"]: row["count"] for row in texts.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    prior = float(np.log((toxic + SMOOTHING) / (clean + 2 * SMOOTHING)))
    if not clean or not toxic:
        return Model(np.empty(0, np.int64), np.empty(0), prior)
    counts = _counts(texts)
    ratio, sigma = log_ratios(counts, clean, toxic)
    best = np.argsort(-sigma, kind="stable")[:FEATURES]
    slots = np.sort(best[sigma[best] >= LEAST_SIGMA])
    if not len(slots):
        return Model(np.empty(0, np.int64), np.empty(0), prior)
    ratios = ratio[slots]
    wanted = np.zeros(SLOTS, bool)
    wanted[slots] = True

    @F.udf(VectorUDT())
    def scaled(text):
        at = np.searchsorted(slots, present(text.encode(), wanted))
        return SparseVector(len(slots), at.tolist(), ratios[at].tolist())

    rows = staged(texts.select(scaled("text").alias("features"), F.col("toxic").alias("label")))
    fitted = LogisticRegression(
        regParam=1e-5, elasticNetParam=0.0, maxIter=60, standardization=False).fit(rows)
    return Model(slots, fitted.coefficients.toArray() * ratios, float(fitted.intercept))


def score(docs: DataFrame, model: Model, out: str = "_score") -> DataFrame:
    """The columns of ``docs`` and ``out`` in 0 to 1, from ``text`` alone; null reads as empty."""
    wanted = np.zeros(SLOTS, bool)
    wanted[model.slots] = True
    shared = docs.sparkSession.sparkContext.broadcast((wanted, model.slots, model.weights, model.bias))

    @F.pandas_udf("double")
    def margin(texts: pd.Series) -> pd.Series:
        wanted, slots, weights, bias = shared.value
        out = [
            bias + weights[np.searchsorted(slots, present((t or "").encode(), wanted))].sum()
            for t in texts
        ]
        return pd.Series(out, dtype="float64")

    return docs.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-margin("text"))))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(text, toxic) of labelled documents that are not held out: all, or if they are more than
    ``most``, a share of them by a hash of the id that keeps their number below it."""
    known = labels.select("doc_id", "toxic").where(
        F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), 3) != 1))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(n)) < int(0.95 * most))
    # At most ``most`` ids and labels are sent to the tasks, so no text moves but the sample's.
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Rows whose id has crc32 remainder 1 of 3 are held out of the fit; a null id counts as the empty
    text's and is never labelled. Empty and null texts have no n-gram and score the model's bias.
    """
    model = fit(training_rows(docs, labels))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
