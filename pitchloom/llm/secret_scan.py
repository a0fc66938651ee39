"""Secrets: candidate strings, judged by a random forest that removes false positives.

Candidates are long runs of key characters. The forest sees their length, how their characters change,
how much of them dictionary words cover, the path of the document, and the words beside them. Which
changes are usual and which words make the dictionary is counted over all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from pitchloom.llm.common import COUNTER_WORDS, byte_values
from pitchloom.runtime import staged

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/=_-]{16})[A-Za-z0-9+/=_-]+")
SHORT_LETTERS = 24
# Words of the dictionary: letters only, of so many bytes, the most frequent of the corpus.
DICTIONARY_WORDS, LEAST_LETTERS, MOST_LETTERS = 5_000, 3, 8
WORD = re.compile(rb"[a-z]+")
# Hash slots for neighbouring words and for the path.
NEIGHBOUR_SLOTS, PATH_SLOTS = 16, 8
NEIGHBOURS = 2
# Labelled findings that the forest is grown on, at most; its trees, depth and seed.
MOST_ROWS, TREES, DEPTH, SEED = 20_000, 40, 6, 9
THRESHOLD = 0.5
# How labels are read off the text around a finding, where none are given.
ASSIGNED = re.compile(r"(?i)(token|secret|api_?key|access_?key|passw(or)?d|credential)\w*[\"']?\s*[=:]\s*[\"'`]$")
QUOTES = "\"'`"


def corpus_tables(docs: DataFrame) -> tuple[set, np.ndarray]:
    """The dictionary and log probabilities of byte changes, counted over all texts of ``docs``."""

    def count(batches):
        words, changes = Counter(), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for data in byte_values(batch.column(0)):
                chars = np.frombuffer(data, np.uint8).astype(np.int64)
                changes += np.bincount(chars[:-1] * 256 + chars[1:], minlength=1 << 16)
                words.update(w for w in data.lower().split() if LEAST_LETTERS <= len(w) <= MOST_LETTERS)
            if len(words) > COUNTER_WORDS:
                yield _counted(words)
                words = Counter()
        yield _counted(words)
        seen = np.flatnonzero(changes)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(seen), pa.string()), pa.array(seen), pa.array(changes[seen])], names=["word", "change", "n"])

    def _counted(words):
        some = [w for w in words if WORD.fullmatch(w)]
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in some], pa.string()), pa.nulls(len(some), pa.int64()),
             pa.array([words[w] for w in some], pa.int64())], names=["word", "change", "n"])

    counts = staged(
        docs.select("text").mapInArrow(count, "word string, change bigint, n bigint")
        .groupBy("word", "change").agg(F.sum("n").alias("n")))
    top = counts.where("word is not null").orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS)
    dictionary = {row["word"] for row in top.collect()}
    changes = np.full(1 << 16, 0.5)
    # At most one row for each pair of bytes.
    for row in counts.where("change is not null").collect():
        changes[row["change"]] += row["n"]
    changes = changes.reshape(256, 256)
    return dictionary, np.log(changes / changes.sum(axis=1, keepdims=True))


def covered(value: str, dictionary: set) -> float:
    """The share of characters in dictionary words, taken from the left, longest first."""
    value, at, hit = value.lower(), 0, 0
    while at < len(value):
        for size in range(MOST_LETTERS, LEAST_LETTERS - 1, -1):
            if value[at:at + size] in dictionary and at + size <= len(value):
                hit, at = hit + size, at + size
                break
        else:
            at += 1
    return hit / len(value)


def _slot(word: str, slots: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % slots


def features(value: str, before: str, after: str, path: str, dictionary: set, changes: np.ndarray) -> list[float]:
    chars = np.frombuffer(value.encode("ascii"), np.uint8)
    kinds = np.select([(chars >= 97) & (chars <= 122), (chars >= 65) & (chars <= 90), (chars >= 48) & (chars <= 57)],
                      [0, 1, 2], 3)
    share = np.bincount(kinds, minlength=4) / len(chars)
    counts = np.bincount(chars)
    counts = counts[counts > 0] / len(chars)
    out = [
        float(len(chars)), *share.tolist(), float((kinds[1:] != kinds[:-1]).mean()),
        float(changes[chars[:-1], chars[1:]].mean()), float(-(counts * np.log2(counts)).sum()),
        covered(value, dictionary), float(re.fullmatch(r"(?:[0-9a-f]+|[0-9A-F]+)", value) is not None),
    ]
    near = np.zeros(3 * NEIGHBOUR_SLOTS)
    words = re.findall(r"\w+", before.lower())[-NEIGHBOURS:]
    for place, word in enumerate(reversed(words)):
        near[place * NEIGHBOUR_SLOTS + _slot(word, NEIGHBOUR_SLOTS)] = 1
    for word in re.findall(r"\w+", after.lower())[:1]:
        near[2 * NEIGHBOUR_SLOTS + _slot(word, NEIGHBOUR_SLOTS)] = 1
    where = np.zeros(PATH_SLOTS)
    where[_slot(path, PATH_SLOTS)] = 1
    return [*out, *near.tolist(), *where.tolist()]


def weak_label(value: str, before: str, after: str) -> int | None:
    """1: a quoted value that is assigned to a key name; 0: digits only, an address's part, or no
    digit; None: undecided."""
    if ASSIGNED.search(before) and after[:1] in QUOTES and after:
        return 1
    if not re.search(r"[0-9]", value) or value.isdigit() or before.endswith(("@", ".")) or after[:1] == "@":
        return 0
    return None


def candidates(docs: DataFrame, tables: tuple[set, np.ndarray]) -> DataFrame:
    """(doc_id, start, length, value_sha256, features, label) of each candidate in whole texts.

    start and length are in code points. ``docs`` has doc_id, text and source, which is the path; null
    texts have no candidate and null paths read as empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, value_sha256 string, features array<double>, label int"
    names = ["doc_id", "start", "length", "value", "features", "label"]
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        dictionary, changes = shared.value
        for batch in batches:
            found = []
            ids = batch.column(0)
            for row, (text, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for match in CANDIDATE.finditer(text or ""):
                    value = match.group()
                    if len(value) < SHORT_LETTERS and not re.search("[0-9]", value):
                        continue
                    before, after = text[max(0, match.start() - 80):match.start()], text[match.end():match.end() + 40]
                    found.append((ids[row].as_py(), match.start(), len(value), value,
                                  features(value, before, after, path or "", dictionary, changes),
                                  weak_label(value, before, after)))
            columns = list(zip(*found)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    found = docs.select("doc_id", "text", "source").mapInArrow(run, schema.replace("value_sha256", "value"))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "features", "label")


def fit(labelled: DataFrame, most: int = MOST_ROWS):
    """A forest grown on findings with a label 0 or 1, or None if there is only one class."""
    known = labelled.where("label in (0, 1)")
    sizes = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    # Each class keeps a share by a hash of the value, so that both fit in half of the bound.
    bound = F.when(F.col("label") == 1, 0.475 * most / sizes[1]).otherwise(0.475 * most / sizes[0])
    some = known.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "start"), F.lit(1 << 20)) < bound * (1 << 20))
    rows = some.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, length, value_sha256, label, probability, is_secret) of every candidate.

    ``labelled`` (features, label, doc_id, start) trains the forest; without it the labels are read off
    the candidates' surroundings (``weak_label``), and undecided ones are only judged. With labels of
    one class only, a finding is a secret unless it is labelled otherwise. Repeated rows each come back.
    """
    found = staged(candidates(docs, corpus_tables(docs)))
    forest = fit(found if labelled is None else labelled)
    if forest is None:
        scored = found.withColumn("probability", F.when(F.col("label") == 0, 0.0).otherwise(1.0))
    else:
        scored = (
            forest.transform(found.withColumn("features", array_to_vector("features")))
            .withColumn("probability", vector_to_array("probability")[1])
        )
    return scored.select(
        "doc_id", "start", "length", "value_sha256", "label", "probability",
        (F.col("probability") >= THRESHOLD).alias("is_secret"))
