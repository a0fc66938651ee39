"""A hashed maximum-entropy language model with a class-factored softmax.

A word's probability is that of its class times that of the word in its class. Both softmaxes have
hashed weights for the words before: the last word, the last two, and two skips. The most frequent
words have 31 classes of 32. All other words share the last class, a tree of softmaxes over 32 branches of
about equal frequency, down to the single word; the branch of words too rare for the shared dictionary
goes by their joined counts. Weights are learnt by gradient steps that every task takes over its own
texts and that are averaged, each row by how often it was touched. Scores are added up in numpy batches.
"""

from __future__ import annotations

import math
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pitchloom.llm.common import byte_values, remainder, word_counts, word_slices
from pitchloom.runtime import attach_row, staged

CLASSES, MEMBERS = 32, 32
HEAD = (CLASSES - 1) * MEMBERS
# Hash slots of the class weights and of the weights inside classes: powers of two.
CLASS_SLOTS, MEMBER_SLOTS = 1 << 14, 1 << 15
ROWS = CLASS_SLOTS + MEMBER_SLOTS
# Slots of the weights in the last class's tree, which lie behind the others, its levels (32^5 leaves), and how
# many of the contexts each level reads.
TAIL_SLOTS = 1 << 15
ALL_ROWS = ROWS + TAIL_SLOTS
TAIL_FEATURES = (3, 1, 1, 1, 1)
# Words whose counts are sent to all tasks, at most; the rest are joined.
DICTIONARY_WORDS = 400_000
# Step size and targets of a gradient step.
RATE, STEP = 0.2, 2048
# Tokens that are scored at once, and rows of weights in a block that is summed.
SCORE_TOKENS, BLOCK_ROWS = 2048, 1024
# Runs of equal rows that are summed one by one.
LONG_RUNS = 16
LN10 = math.log(10)
# The logit of a slot that stands for no word.
EMPTY = -1e4
_ONES = np.ones(MEMBERS, np.float32)


class Words:
    """The dictionary of a task: ids by falling count, and the counts. ``rare_size`` is the smoothed count of
    all words that are not in it, unseen ones among them."""

    def __init__(self, words: list[bytes], counts: np.ndarray, rare_size: float = 1.0):
        self.ids = {word: i for i, word in enumerate(words)}
        self.counts = counts
        # Other words come after the head's slots even where the head is not full.
        self.rare = max(len(words), HEAD)
        self.begin = self.rare + 1
        self.bias_class, self.bias_member = self._biases()
        self.levels, self.leaf = self._tree(np.append(self.counts[HEAD:] + 1.0, rare_size))

    def _biases(self):
        head = np.zeros(HEAD)
        some = self.counts[:HEAD]
        head[:len(some)] = some
        by_class = np.append(head.reshape(-1, MEMBERS).sum(axis=1), self.counts[HEAD:].sum() + 1)
        # Slots without a word, and classes of such slots only, get no probability.
        return tuple(np.where(n > 0, np.log(n + 0.5), EMPTY).astype(np.float32)
                     for n in (by_class, head.reshape(-1, MEMBERS)))

    @staticmethod
    def _tree(sizes: np.ndarray):
        """(levels, share of each word in its leaf) for the words of the last class, the rare ones last.

        A word's branch on each level is a digit, base 32, of the middle of its part of the whole frequency. A
        level is (node of each word, its branch there, biases by node and branch); a word that has
        been told from all others has node -1.
        """
        depth, bits = len(TAIL_FEATURES), MEMBERS.bit_length() - 1
        middle = (np.cumsum(sizes) - sizes / 2) / sizes.sum()
        code = np.minimum((middle * MEMBERS**depth).astype(np.int64), MEMBERS**depth - 1)
        levels = []
        for level in range(depth):
            _, node, words = np.unique(code >> bits * (depth - level), return_inverse=True, return_counts=True)
            crowded = words > 1
            if not crowded.any():
                break
            number = np.where(crowded, np.cumsum(crowded) - 1, -1)[node].astype(np.int32)
            branch = (code >> bits * (depth - level - 1) & (MEMBERS - 1)).astype(np.int8)
            some = number >= 0
            mass = np.bincount(number[some] * MEMBERS + branch[some], sizes[some], MEMBERS * int(crowded.sum()))
            bias = np.full(len(mass), EMPTY, np.float32)
            bias[mass > 0] = np.log(mass[mass > 0])
            levels.append((number, branch, bias.reshape(-1, MEMBERS)))
        _, leaf = np.unique(code, return_inverse=True)
        return levels, np.log(sizes / np.bincount(leaf, sizes)[leaf])

    def steps(self, ids: np.ndarray, hashes: np.ndarray):
        """(places, rows of weights, biases, branches) on the way down the last class's tree of its words, in
        one table for all levels that read as many contexts. A way ends where a word is told from all others."""
        found: dict = {}
        places = np.flatnonzero(ids >= HEAD)
        at = np.minimum(ids[places] - HEAD, len(self.leaf) - 1)
        for level, (node, branch, bias) in enumerate(self.levels):
            of = node[at]
            some = np.flatnonzero(of >= 0)
            if not len(some):
                break
            places, at, of = places[some], at[some], of[some]
            rows = tail_rows(hashes[places, :TAIL_FEATURES[level]], level, of)
            found.setdefault(rows.shape[1], []).append((places, rows, bias.take(of, axis=0), branch[at]))
        return [tuple(map(np.concatenate, zip(*levels))) for levels in found.values()]

    def encode(self, data: bytes) -> tuple[np.ndarray, list[bytes]]:
        """Ids of the lower-cased (A-Z) text's words and its end, and the words that are not known."""
        ids, rare, get = [], [], self.ids.get
        for words in word_slices(data.lower()):
            found = list(map(get, words, repeat(-1)))
            ids.extend(found)
            if -1 in found:
                rare.extend([word for word, i in zip(words, found) if i < 0])
        ids.append(get(b"", -1))
        if ids[-1] < 0:
            rare.append(b"")
        out = np.array(ids, np.int64)
        out[out < 0] = self.rare
        return out, rare


_HELD: dict = {}


def _words(shared) -> Words:
    """One dictionary for each worker process and broadcast."""
    key, *dictionary = shared.value
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Words(*dictionary)
    return _HELD[key]


def contexts(ids: np.ndarray, begin: int) -> np.ndarray:
    """[place, feature]: hashes of the last word, the last two, and the words two and three back."""
    padded = np.concatenate([np.full(3, begin, np.int64), ids]).astype(np.uint64)
    one, two, three = padded[2:-1], padded[1:-2], padded[:-3]
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    features = [one * a + np.uint64(1), (one * a + two) * b + np.uint64(2), two * a + np.uint64(3), three * a + np.uint64(4)]
    mixed = np.stack(features, axis=1) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))) * a


def class_rows(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) & (CLASS_SLOTS - 1)


def member_rows(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    mixed = (hashes[:, :3] + classes.astype(np.uint64)[:, None]) * np.uint64(0x94D049BB133111EB)
    return CLASS_SLOTS + ((mixed >> np.uint64(40)).astype(np.int64) & (MEMBER_SLOTS - 1))


def tail_rows(hashes: np.ndarray, level: int, nodes: np.ndarray) -> np.ndarray:
    """Rows among those of the tree."""
    own = nodes.astype(np.uint64) * np.uint64(8) + np.uint64(level + 1)
    mixed = (hashes + (own * np.uint64(0xC2B2AE3D27D4EB4F))[:, None]) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(40)).astype(np.int64) & (TAIL_SLOTS - 1)


def _powers(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and their sums by row; logits that would leave the range of the numbers are shifted in place."""
    with np.errstate(over="ignore", invalid="ignore"):
        powers = np.exp(logits)
        total = powers @ _ONES
    if not (total.min() > 1e-20 and total.max() < 1e30):
        logits -= logits.max(axis=1, keepdims=True)
        powers = np.exp(logits)
        total = powers @ _ONES
    return powers, total


def _log_chance(logits: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax at each row's wanted column; the logits are used up."""
    total = _powers(logits)[1]
    return logits.ravel().take(np.arange(0, logits.size, MEMBERS) + wanted) - np.log(total)


def _gather(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = weights.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        out += weights.take(rows[:, k], axis=0)
    return out


def _sums(values: np.ndarray, source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``source`` the sum of the rows of ``values`` it names. Runs are short but for a few: the
    first rows of all runs are added together, then the second ones, until few runs are left."""
    total = values.take(source[starts], axis=0)
    place, left = 1, np.flatnonzero(sizes > 1)
    while len(left) > LONG_RUNS:
        total[left] += values.take(source[starts[left] + place], axis=0)
        place += 1
        left = left[sizes[left] > place]
    for run in left.tolist():
        total[run] += values.take(source[starts[run] + place:starts[run] + sizes[run]], axis=0).sum(axis=0)
    return total


class Trainer:
    """Gradient steps (AdaGrad) over one task's texts."""

    def __init__(self, words: Words, start: np.ndarray | None):
        self.words = words
        self.everything = np.zeros((ALL_ROWS, MEMBERS), np.float32) if start is None else start.copy()
        squares, self.touched = np.full((ALL_ROWS, MEMBERS), 1e-2, np.float32), np.zeros(ALL_ROWS, np.float32)
        self.weights = self.everything[:ROWS]
        # Weights, sums of squared slopes and times touched, of classes and members and of the tree.
        self.front, self.tail = ((self.everything[s], squares[s], self.touched[s]) for s in (slice(ROWS), slice(ROWS, None)))
        self.held: list[tuple] = []
        self.n_held = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append((contexts(ids, self.words.begin), ids))
        self.n_held += len(ids)
        if self.n_held >= STEP:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        hashes, ids = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n_held = [], 0
        for at in range(0, len(ids), STEP):
            self._step(hashes[at:at + STEP], ids[at:at + STEP])

    def _step(self, hashes, ids):
        classes = np.minimum(ids // MEMBERS, CLASSES - 1)
        self._descend(self.front, class_rows(hashes), self.words.bias_class[None, :], classes)
        head = np.flatnonzero(classes < CLASSES - 1)
        if len(head):
            of = classes[head]
            self._descend(self.front, member_rows(hashes[head], of), self.words.bias_member.take(of, axis=0), ids[head] % MEMBERS)
        for _, rows, bias, branch in self.words.steps(ids, hashes):
            self._descend(self.tail, rows, bias, branch)

    @staticmethod
    def _descend(table, rows, bias, wanted):
        weights, all_squares, touched = table
        slope = _gather(weights, rows)
        slope += bias
        slope, total = _powers(slope)
        slope *= (1 / total)[:, None]
        slope.ravel()[np.arange(0, slope.size, MEMBERS) + wanted] -= 1
        # 16 bits hold every row number, and these are sorted by counting.
        flat = rows.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sizes = np.diff(starts, append=len(ordered))
        total = _sums(slope, order // rows.shape[1], starts, sizes)
        at = ordered[starts].astype(np.int64)
        squares = all_squares.take(at, axis=0)
        squares += total * total
        all_squares[at] = squares
        total /= np.sqrt(squares, out=squares)
        total *= RATE
        moved = weights.take(at, axis=0)
        moved -= total
        weights[at] = moved
        touched[at] += sizes


def train(texts: DataFrame, shared, start: np.ndarray | None = None) -> np.ndarray:
    """One round: every task's weights, averaged row by row by how often the task touched the row."""
    sent = texts.sparkSession.sparkContext.broadcast(start)

    def learn(batches):
        trainer = Trainer(_words(shared), sent.value)
        for batch in batches:
            for data in byte_values(batch.column(0)):
                trainer.add(trainer.words.encode(data)[0])
        trainer.flush()
        for block in range(ALL_ROWS // BLOCK_ROWS):
            part = slice(block * BLOCK_ROWS, (block + 1) * BLOCK_ROWS)
            rows = np.flatnonzero(trainer.touched[part])
            if len(rows):
                yield _blocks([(block, rows.astype(np.int16).tobytes(), trainer.touched[part][rows].tobytes(),
                                trainer.everything[part][rows].astype(np.float16).tobytes())], sums=False)

    def add(batches):
        # Sums grow in place: a task holds its blocks, however many tasks send to it.
        held: dict = {}
        for batch in batches:
            for block, rows, touched, weights in zip(*(c.to_pylist() for c in batch.columns)):
                total = held.setdefault(block, np.zeros((BLOCK_ROWS, MEMBERS + 1)))
                rows = np.frombuffer(rows, np.int16)
                times = np.frombuffer(touched, np.float32).astype(np.float64)
                total[rows, :MEMBERS] += np.frombuffer(weights, np.float16).reshape(-1, MEMBERS) * times[:, None]
                total[rows, MEMBERS] += times
        if held:
            yield _blocks([(block, total.tobytes()) for block, total in held.items()], sums=True)

    def _blocks(values, sums):
        columns = list(zip(*values))
        arrays = [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "sums"] if sums else ["block", "rows", "touched", "weights"])

    parts = texts.mapInArrow(learn, "block int, rows binary, touched binary, weights binary")
    summed = parts.repartition("block").mapInArrow(add, "block int, sums binary")
    weights = np.zeros((ALL_ROWS, MEMBERS), np.float32) if start is None else start.copy()
    for row in summed.toLocalIterator():
        total = np.frombuffer(row["sums"], np.float64).reshape(BLOCK_ROWS, MEMBERS + 1)
        seen = np.flatnonzero(total[:, MEMBERS])
        weights[row["block"] * BLOCK_ROWS + seen] = total[seen, :MEMBERS] / total[seen, MEMBERS:]
    return weights


def log10_head(words: Words, weights: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """log10 of the class's probability, for frequent words times the word's in its class."""
    classes = np.minimum(ids // MEMBERS, CLASSES - 1)
    out = np.empty(len(ids))
    for at in range(0, len(ids), SCORE_TOKENS):
        some = slice(at, at + SCORE_TOKENS)
        scores = _gather(weights, class_rows(hashes[some]))
        scores += words.bias_class
        out[some] = _log_chance(scores, classes[some])
        head = at + np.flatnonzero(classes[some] < CLASSES - 1)
        if len(head):
            of = classes[head]
            scores = _gather(weights, member_rows(hashes[head], of))
            scores += words.bias_member.take(of, axis=0)
            out[head] += _log_chance(scores, ids[head] % MEMBERS)
    return out / LN10


def log10_tail(words: Words, weights: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """log10 of the probability of each word of the last class in that class; rare words count as one."""
    out = np.zeros(len(ids))
    tail = weights[ROWS:]
    for at in range(0, len(ids), SCORE_TOKENS):
        some = slice(at, at + SCORE_TOKENS)
        for places, rows, bias, branch in words.steps(ids[some], hashes[some]):
            scores = _gather(tail, rows)
            scores += bias
            out[some] += np.bincount(places, _log_chance(scores, branch), len(ids[some]))
    in_tail = np.flatnonzero(ids >= HEAD)
    out[in_tail] += words.leaf[np.minimum(ids[in_tail] - HEAD, len(words.leaf) - 1)]
    return out / LN10


def dictionary(counts: DataFrame) -> tuple[list[bytes], np.ndarray, int]:
    """The most frequent words and their counts, and the count that a word needs to be among them.

    The needed count is the least that leaves at most DICTIONARY_WORDS words; ties stay together.
    """
    capped = F.least(F.col("n"), F.lit(1 << 16)).alias("n")
    sizes = sorted((r["n"], r["count"]) for r in counts.select(capped).groupBy("n").count().collect())
    least, total = (1 << 16) + 1, 0
    for n, words in reversed(sizes):
        total += words
        if total > DICTIONARY_WORDS:
            break
        least = n
    frame = counts.where(F.col("n") >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    return [bytes(w) for w in frame["word"]], frame["n"].to_numpy(np.int64), least


def score(docs: DataFrame, training: DataFrame, rounds: int = 1) -> DataFrame:
    """``docs`` (text and any others, which are carried) scored by a model of ``training`` (text).

    Adds n_tokens, n_known, train_tokens, base_score and score. Null texts count as empty and are one
    end token. Without training texts every word is unknown. Repeated rows each come back.
    """
    spark = docs.sparkSession
    counts = staged(word_counts(training, ends=True))
    words, numbers, least = dictionary(counts)
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("n").alias("V"))
    n_all, n_words = totals.first()
    rare_size = float(n_all - int(numbers.sum()) + n_words - len(words) + 1)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, words, numbers, rare_size))
    weights = None
    for _ in range(rounds):
        weights = train(training.select("text"), shared, weights)
    sent = spark.sparkContext.broadcast(weights)
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        known = _words(shared)
        log_counts = np.zeros(known.rare + 1)
        log_counts[:len(known.counts)] = np.log10(known.counts + 1.0)
        first, row = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                encoded = [known.encode(d) for d in byte_values(part.column(0))]
                lengths = np.array([len(ids) for ids, _ in encoded])
                starts = np.cumsum(lengths) - lengths
                ids = np.concatenate([ids for ids, _ in encoded])
                hashes = np.concatenate([contexts(i, known.begin) for i, _ in encoded])
                model = log10_head(known, sent.value, ids, hashes) + log10_tail(known, sent.value, ids, hashes)
                model[ids == known.rare] -= math.log10(rare_size)
                columns = [
                    pa.array(first + row + np.arange(len(lengths))), pa.array(lengths),
                    pa.array(np.add.reduceat((ids < known.rare).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(log_counts[ids], starts)), pa.array(np.add.reduceat(model, starts)),
                    pa.array([rare for _, rare in encoded], pa.list_(pa.binary())),
                ]
                row += len(lengths)
                yield pa.RecordBatch.from_arrays([*columns, *part.columns[1:]], names=[*names, *others])

    names = ["_row", "n_tokens", "_known", "_logs", "_model", "_rare"]
    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    schema = "_row bigint, n_tokens bigint, _known bigint, _logs double, _model double, _rare array<binary>" + carried
    scored = staged(docs.select("text", *others).mapInArrow(run, schema))
    rare = (
        scored.select("_row", F.explode("_rare").alias("word"))
        .join(counts.where(F.col("n") < least), "word")
        .groupBy("_row").agg(F.count("n").alias("_more"), F.sum(F.log10(F.col("n") + 1.0)).alias("_more_logs"))
    )
    more = F.coalesce("_more_logs", F.lit(0.0))
    found = scored.drop("_rare").join(rare, "_row", "left")
    return attach_row(found, totals).select(
        *others, "n_tokens", (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.col("N").cast("long").alias("train_tokens"),
        (F.col("_logs") + more - F.col("n_tokens") * F.log10(F.col("N") + F.col("V") + 1.0)).alias("base_score"),
        (F.col("_model") + more).alias("score"))


def scored_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, ...) of every row of ``docs``; rows with crc32 remainder 2 of 7 are held out."""
    held_out = remainder(F.col("doc_id"), 7) == 2
    training = docs.where(~held_out).select("text")
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), training)
