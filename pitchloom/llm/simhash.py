"""SimHash near-duplicates, found by bit-sliced comparison.

Fingerprints that differ in at most ``RADIUS`` = 4 of 64 bits agree on at least two of six bit
groups, so each fingerprint is listed under the 15 pairs of groups. Inside a bucket the
fingerprints stand as vertical bit planes, 64 of them to a machine word. A probe runs down the
planes, carry-save adders count its differing bits against 64 fingerprints at once, and a word is
abandoned when all its fingerprints have more than the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pitchloom.llm.common import byte_values, components, union_labels, word_slices
from pitchloom.runtime import staged

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
GROUP_BITS = (11, 11, 11, 11, 10, 10)
# Fingerprints in a part of a bucket; larger buckets are compared part against part.
PART = 1024
# Rows and (probe, word) pairs that one step of a task holds.
STEP_ROWS, STEP_PAIRS = 1 << 16, 1 << 18
ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(data: bytes) -> int:
    """The fingerprint of one UTF-8 text; zero for a text without words."""
    tail: list[bytes] = []
    ones, total = np.zeros(64, np.int64), 0
    for words in word_slices(data.lower()):
        words = tail + words
        if len(words) >= SHINGLE_WORDS:
            hashes = _hashes(words)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
        tail = words[-(SHINGLE_WORDS - 1):]
    if not total and tail:
        value = xxhash.xxh64_intdigest(b" ".join(tail), SEED)
        return value
    if not total:
        return 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _hashes(words: list[bytes]) -> np.ndarray:
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - SHINGLE_WORDS + 1].tolist()
    stops = ends[SHINGLE_WORDS - 1:].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. A null text counts as empty."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(d) for d in byte_values(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def bucket_keys():
    """The 15 bucket keys of column ``fp``: the number of the pair, then the bits of both groups."""
    at, groups = 0, []
    for bits in GROUP_BITS:
        groups.append(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1)))
        at += bits
    width = max(GROUP_BITS)
    return F.array(*[
        F.lit(n << (2 * width)) + F.shiftleft(groups[i], width) + groups[j]
        for n, (i, j) in enumerate(combinations(range(len(groups)), 2))
    ])


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints, whose number is a multiple of 64: [word, plane] over 64 lanes."""
    planes = np.empty((len(values) // 64, 64), np.uint64)
    for at in range(0, len(planes), 2048):
        part = values[at * 64:(at + 2048) * 64]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lanes = np.ascontiguousarray(bits.reshape(-1, 64, 64).transpose(0, 2, 1))
        planes[at:at + 2048] = np.packbits(lanes, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    return planes


def within(values, planes, probe, word, valid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probe, word, lanes) of pairs whose word holds fingerprints within the radius of the probe."""
    ones = np.zeros(len(probe), np.uint64)
    twos, fours, over = ones.copy(), ones.copy(), ones.copy()
    alive = valid[word]

    def differing(p):
        return planes[word, p] ^ (np.uint64(0) - ((values[probe] >> np.uint64(p)) & ONE))

    for p in range(0, 64, 3):
        if p < 63:
            a, b, c = differing(p), differing(p + 1), differing(p + 2)
            half = a ^ b
            low, high = half ^ c, (a & b) | (half & c)
        else:
            low, high = differing(p), np.zeros(len(probe), np.uint64)
        carry = ones & low
        ones ^= low
        half = twos ^ carry
        up = (twos & carry) | (half & high)
        twos = half ^ high
        over |= fours & up
        fours ^= up
        if p % 6 == 0 or p == 63:
            alive &= ~(over | (fours & (ones | twos)))
            left = np.flatnonzero(alive)
            if len(left) < 0.7 * len(probe) or p == 63:
                probe, word, alive = probe[left], word[left], alive[left]
                ones, twos, fours, over = ones[left], twos[left], fours[left], over[left]
        if not len(probe):
            break
    return probe, word, alive


def _link(values: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The row that stands for each row's linked set, where equal numbers in ``units`` are a unit.

    ``units`` is sorted. Links that join sets already joined are not kept, so what comes back has
    the size of the rows.
    """
    starts = np.flatnonzero(np.r_[True, units[1:] != units[:-1]])
    sizes = np.diff(np.r_[starts, len(units)])
    n_words = -(-sizes // 64)
    first_word = np.cumsum(n_words) - n_words
    unit_of = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(len(units)) - starts[unit_of]
    own_word, lane = first_word[unit_of] + inside // 64, inside % 64
    slots = np.zeros(int(n_words.sum()) * 64, np.uint64)
    row_at = np.zeros(len(slots), np.int64)
    slots[own_word * 64 + lane] = values
    row_at[own_word * 64 + lane] = np.arange(len(values))
    valid = np.zeros(int(n_words.sum()), np.uint64)
    np.bitwise_or.at(valid, own_word, ONE << lane.astype(np.uint64))
    planes = planes_of(slots)
    label = np.arange(len(values))
    tries = (first_word + n_words)[unit_of] - own_word
    upto = np.cumsum(tries)
    begin = 0
    while begin < len(values):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + STEP_PAIRS, "right")))
        n = tries[begin:end]
        probe = np.repeat(np.arange(begin, end), n)
        word = np.arange(len(probe)) - np.repeat(np.cumsum(n) - n, n) + own_word[probe]
        probe, word, lanes = within(values, planes, probe, word, valid)
        own = own_word[probe] == word
        lanes[own] &= ~(ONE << lane[probe[own]].astype(np.uint64))
        hit = np.flatnonzero(lanes)
        for at in range(0, len(hit), 1 << 14):
            some = hit[at:at + (1 << 14)]
            bits = np.unpackbits(lanes[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero(bits)
            union_labels(label, probe[some][i], row_at[word[some][i] * 64 + j])
        begin = end
    return label


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join all linked sets: no link is lost.

    Buckets beyond ``PART`` fingerprints are cut by hash into parts, and each pair of parts is a
    unit of its own, so no task holds a bucket.
    """
    listed = distinct.select("fp", F.explode(bucket_keys()).alias("key"))
    counts = (
        listed.groupBy("key").agg(F.count("fp").alias("n")).where("n > 1")
        .select("key", F.ceil(F.col("n") / PART).cast("long").alias("parts"))
    )
    other = F.expr(
        "if(parts = 1, array(0L), filter(sequence(0L, parts - 1), "
        f"o -> o <> pmod(xxhash64(fp), parts)))")
    units = (
        listed.join(counts, "key")
        .withColumn("own", F.expr("if(parts = 1, 0L, pmod(xxhash64(fp), parts))"))
        .withColumn("other", F.explode(other))
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    )
    placed = units.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "fp")

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= STEP_ROWS:
                columns = _columns(held)
                cut = _last_unit(columns)
                if cut:
                    yield from _edges([c[:cut] for c in columns])
                held = [pa.RecordBatch.from_arrays([pa.array(c[cut:]) for c in columns], names=names)]
                rows = held[0].num_rows
        if rows:
            yield from _edges(_columns(held))

    names = ["key", "low", "high", "fp"]
    return placed.mapInArrow(run, "a bigint, b bigint")


def _columns(batches) -> list[np.ndarray]:
    return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in range(4)]


def _last_unit(columns) -> int:
    """The row at which the last unit begins."""
    same = np.ones(len(columns[0]), bool)
    for column in columns[:3]:
        same &= column == column[-1]
    return int(np.argmax(same))


def _edges(columns):
    key, low, high, fp = columns
    change = np.r_[False, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
    label = _link(np.ascontiguousarray(fp).view(np.uint64), np.cumsum(change))
    moved = np.flatnonzero(label != np.arange(len(label)))
    if len(moved):
        yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text, any others).

    component_id is the smallest doc_id reachable over links. Null and word-free texts have
    fingerprint zero and link like any other. Rows with a null id take part and get their
    component's smallest id, null where the component has none. Repeated rows each come back.
    """
    marked = staged(fingerprints(docs))
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = staged(rooted)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component; of rows that repeat that
    id, all that carry it. Rows without an id stay only if their component has no id at all."""
    found = near_duplicates(docs)
    keep = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select(F.col("doc_id").alias("_keep")).distinct()
    )
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_keep"]), "left_semi")
