"""Multiclass gradient boosting with shared histograms.

Features are binned once, at quantiles of the training rows. A round grows one tree of depth three for
each class of the softmax. A level is one pass over the rows: every task adds up gradients, second
derivatives and counts by (fit, class, node, feature, bin) in one array of fixed size, and the sum of
these arrays chooses the best splits of the level. Several fits on subsets of the same rows share
each pass. Rows travel in blocks of some thousands, with one array for each feature, so a pass costs array
operations only. Scores of the rows are written out every few rounds; between, they follow from
the trees grown since, so no lineage builds up and a lost executor repeats a few rounds at most. Up to a
fixed number of rows a fit needs no passes: one task holds its rows and grows all its trees the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pitchloom.runtime import staged

DEPTH = 3
RATE = 0.06
L2 = 1.0
LEAST_ROWS = 20
LEAST_CURVATURE = 1e-3
BINS = 64
ROUNDS = 200
# Rounds after which the scores of the training rows are written out.
CUT_ROUNDS = 25
# Tasks of a training pass and rows aimed at in each: the driver adds up one array a task.
MOST_TASKS, TASK_ROWS = 64, 50_000
# Training rows up to which each fit is grown by one task, and rows added up at once there.
WHOLE_ROWS, BLOCK_ROWS = 400_000, 16_384
NO_SPLIT = 255


def _double_array(names) -> Column:
    return F.expr("array(" + ", ".join(f"CAST({name} AS DOUBLE)" for name in names) + ")")


def bin_edges(train: DataFrame, names, bins: int = BINS) -> list[list[float]]:
    """Rising thresholds of each feature: distinct quantiles below its largest value. Unknown values are
    left out here and go to the lowest bin later."""
    shares = [i / bins for i in range(1, bins)]
    row = train.agg(*(
        F.struct(F.percentile_approx(value, shares, 100 * bins), F.max(value)).alias(f"f{i}")
        for i, name in enumerate(names)
        for value in [F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))]
    )).first()
    return [sorted({float(v) for v in (found[0] or []) if v < found[1]}) for found in row]


def codes_of(values: np.ndarray, edges) -> np.ndarray:
    """Bin number of each value, by (feature, row): how many thresholds lie below it. Unknown values get bin 0."""
    out = np.zeros(values.shape[::-1], np.uint8)
    for k, cuts in enumerate(edges):
        column = values[:, k]
        out[k] = np.where(np.isnan(column), 0, np.searchsorted(np.array(cuts), column, side="left"))
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of an array column; null values are unknown."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


@dataclass
class Ensemble:
    """Trees of all fits: split feature and bin of 7 nodes and value of 8 leaves, by (round, fit, class)."""

    names: list[str]
    edges: list[list[float]]
    base: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def scores(self, codes: np.ndarray, fit: int, upto=(None,)) -> list[np.ndarray]:
        """Raw class scores of one fit after each of the given numbers of rounds (rising)."""
        score = np.repeat(self.base[fit][:, None], codes.shape[1], axis=1)
        out, done = [], 0
        for rounds in upto:
            rounds = len(self.feature) if rounds is None else rounds
            for step in range(done, rounds):
                for c in range(len(score)):
                    leaf = _nodes(codes, self.feature[step, fit, c], self.cut[step, fit, c], DEPTH)
                    score[c] += self.value[step, fit, c][leaf]
            done = max(done, rounds)
            out.append(score.T.copy())
        return out

    def predict(self, df: DataFrame, out: str = "probabilities", rounds: int | None = None, fit: int = 0) -> DataFrame:
        """``df`` with the class probabilities of one fit after so many rounds (all: None)."""
        staged_out = self.predict_stages(df, (rounds,), "_stages", fit)
        return staged_out.withColumn(out, F.col("_stages")[0]).drop("_stages")

    def predict_stages(self, df: DataFrame, upto, out: str = "stages", fit: int = 0) -> DataFrame:
        """``df`` with an array of class probabilities, one for each number of rounds, in one pass."""
        upto = tuple(upto)
        return self._arrays(df, out, len(upto), lambda model, codes: model.scores(codes, fit, upto))

    def predict_fits(self, df: DataFrame, out: str = "fits") -> DataFrame:
        """``df`` with an array of class probabilities, one for each fit, in one pass."""
        fits = len(self.base)
        return self._arrays(df, out, fits, lambda model, codes: [model.scores(codes, f)[0] for f in range(fits)])

    def _arrays(self, df: DataFrame, out: str, number: int, scores) -> DataFrame:
        model, classes = self, self.base.shape[1]

        @F.arrow_udf("array<array<double>>")
        def run(values: pa.Array) -> pa.Array:
            n = len(values)
            codes = codes_of(_matrix(values, len(model.names)), model.edges)
            chance = softmax(np.stack(scores(model, codes), axis=1))
            inner = pa.ListArray.from_arrays(
                pa.array(np.arange(0, n * number * classes + 1, classes, dtype=np.int32)), pa.array(chance.ravel()))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, n * number + 1, number, dtype=np.int32)), inner)

        return df.withColumn(out, run(_double_array(self.names)))


def softmax(score: np.ndarray, axis: int = -1) -> np.ndarray:
    power = np.exp(score - score.max(axis=axis, keepdims=True))
    return power / power.sum(axis=axis, keepdims=True)


def _nodes(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row after so many levels, counted from the left; ``codes`` by (feature, row).

    Every split of a level is asked of all rows at once, and the bits of a row's node pick its answer.
    """
    at = np.zeros(codes.shape[1], np.uint8)
    for level in range(levels):
        first = (1 << level) - 1
        answers = [codes[feature[node]] > cut[node] for node in range(first, 2 * first + 1)]
        for bit in range(level):
            right = (at >> bit & 1).astype(bool)
            answers = [(right & b) | (~right & a) for a, b in zip(answers[::2], answers[1::2])]
        at = 2 * at + answers[0]
    return at


def _histograms(codes, y, chance, feature, cut, level: int, bins: int) -> np.ndarray:
    """(class, node x feature x bin, 3): gradients, second derivatives and counts of rows by the nodes of a level.
    ``codes`` by (feature, row), ``chance`` by (class, row), splits so far by class."""
    width, nodes = len(codes), 1 << level
    total = np.zeros((len(chance), nodes * width * bins, 3))
    cells = codes + (np.arange(width) * bins)[:, None]
    for c, p in enumerate(chance):
        node = _nodes(codes, feature[c], cut[c], level)
        cell = (cells + node.astype(np.int64) * (width * bins)).ravel()
        for k, part in enumerate((p - (y == c), p * (1 - p), None)):
            weights = None if part is None else np.tile(part, width)
            total[c, :, k] = np.bincount(cell, weights, minlength=nodes * width * bins)
    return total


def _leaves(lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
    ends = np.stack([lefts, rights], axis=-2)
    ends = ends.reshape(*ends.shape[:-3], 1 << DEPTH, 3)
    return -RATE * ends[..., 0] / (ends[..., 1] + L2)


def _grow(codes: np.ndarray, y: np.ndarray, share: np.ndarray, base: np.ndarray, rounds: int, bins: int):
    """(split features, split bins, leaf values) by (round, class) of one fit whose rows are all here."""
    classes, width = len(base), len(codes)
    trees = (np.zeros((rounds, classes, 7), np.int64), np.full((rounds, classes, 7), NO_SPLIT, np.int64),
             np.zeros((rounds, classes, 8)))
    feature, cut, value = trees
    parts = [slice(at, at + BLOCK_ROWS) for at in range(0, len(y), BLOCK_ROWS)]
    score = np.repeat(base[:, None], len(y), axis=1)
    for step in range(rounds):
        chance = softmax(score, axis=0)
        for level in range(DEPTH):
            first = (1 << level) - 1
            sums = sum(_histograms(codes[:, p], y[p], chance[:, p], feature[step], cut[step], level, bins) for p in parts)
            places = slice(first, 2 * first + 1)
            feature[step][:, places], cut[step][:, places], lefts, rights = _best_splits(
                sums.reshape(classes, 1 << level, width, bins, 3))
        value[step] = _leaves(lefts, rights)
        # Classes that a fit has never seen stay where they are.
        value[step][share == 0] = 0.0
        for c in range(classes):
            score[c] += value[step, c][_nodes(codes, feature[step, c], cut[step, c], DEPTH)]
    return trees


def _best_splits(sums: np.ndarray):
    """For histograms (..., feature, bin, 3): (feature, bin, left sums, right sums); no gain: all left."""
    total = sums.sum(axis=-2)[..., :1, :]
    left = np.cumsum(sums, axis=-2)
    right = total[..., None, :] - left

    def worth(s):
        return s[..., 0] ** 2 / (s[..., 1] + L2)

    gain = worth(left) + worth(right) - worth(total)[..., None]
    allowed = (
        (left[..., 2] >= LEAST_ROWS) & (right[..., 2] >= LEAST_ROWS)
        & (left[..., 1] >= LEAST_CURVATURE) & (right[..., 1] >= LEAST_CURVATURE)
    )
    # Gains below rounding noise are none; of equal gains the first feature and bin is taken.
    gain = np.where(allowed, gain, 0.0)
    flat = gain.reshape(*gain.shape[:-2], -1)
    best = flat.argmax(axis=-1)
    top = np.take_along_axis(flat, best[..., None], axis=-1)[..., 0]
    bins = gain.shape[-1]
    feature, cut = best // bins, best % bins
    none = top <= 1e-9
    feature, cut = np.where(none, 0, feature), np.where(none, NO_SPLIT, cut)

    def at(s):
        picked = s.reshape(*s.shape[:-3], -1, 3)
        return np.take_along_axis(picked, best[..., None, None], axis=-2)[..., 0, :]

    whole = total[..., 0, :]
    lefts = np.where(none[..., None], whole, at(left))
    rights = np.where(none[..., None], 0.0, at(right))
    return feature, cut, lefts, rights


def fit_boosted(
    train: DataFrame, names, label: str = "outcome_index", classes: int = 3, rounds: int = ROUNDS,
    members: str | None = None, bins: int = BINS,
) -> Ensemble:
    """Boosted softmax trees on ``train``: rate 0.06, depth 3, L2 term 1, at least 20 rows a leaf.

    ``members`` names an array column with a 0/1 number for each of several fits (one fit without it);
    all fits share bins and passes. Classes that a fit never sees keep a score that gives them no
    weight. An empty fit raises ValueError. Nothing is random.
    """
    names = list(names)
    if train.isEmpty():
        raise ValueError("no training rows")
    edges = bin_edges(train, names, bins)
    width = len(names)
    chosen = F.col(members) if members else F.array(F.lit(1))

    def encode(batches):
        for batch in batches:
            codes = codes_of(_matrix(batch.column(0), width), edges)
            owner = batch.column(2)
            yield pa.RecordBatch.from_arrays([
                pa.array([row.tobytes() for row in codes.T], pa.binary()), batch.column(1),
                pa.array([np.array(o.as_py(), np.uint8).tobytes() for o in owner], pa.binary()),
            ], names=["codes", "y", "members"])

    coded = staged(
        train.select(_double_array(names).alias("x"), F.col(label).cast("int").alias("y"), chosen.alias("m"))
        .mapInArrow(encode, "codes binary, y int, members binary")
    )
    counts = coded.groupBy("y", "members").count().collect()
    # Distinct (class, membership) rows: as many as sets of subsets, not as rows.
    fits = len(bytes(counts[0]["members"]))
    seen = np.zeros((fits, classes))
    for row in counts:
        seen[:, row["y"]] += row["count"] * np.frombuffer(row["members"], np.uint8).astype(float)
    if (seen.sum(axis=1) == 0).any():
        raise ValueError("a fit has no training rows")
    share = seen / seen.sum(axis=1, keepdims=True)
    base = np.where(share > 0, np.log(np.maximum(share, 1e-300)), -50.0)
    n_rows = sum(row["count"] for row in counts)
    tasks = int(min(MOST_TASKS, max(1, -(-n_rows // TASK_ROWS))))

    model = Ensemble(
        names, edges, base, np.zeros((rounds, fits, classes, 7), np.int64),
        np.full((rounds, fits, classes, 7), NO_SPLIT, np.int64), np.zeros((rounds, fits, classes, 8)))

    def pack(batches):
        """One record for each batch of rows: codes by (feature, row), labels, memberships by (fit, row)."""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes, owner = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(n, -1).T for k in (0, 2))
            parts = (codes.tobytes(), batch.column(1).to_numpy().astype(np.int32).tobytes(), owner.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=["codes", "y", "members"])

    def load(batch, cut_at, upto):
        """(record, codes, labels, memberships, scores by (fit, class, row)) of each block of rows, with the
        trees since the last cut."""
        for record in range(batch.num_rows):
            parts = [np.frombuffer(column[record].as_buffer(), kind) for column, kind in zip(
                batch.columns, (np.uint8, np.int32, np.uint8, np.float64))]
            y = parts[1]
            codes, owner = parts[0].reshape(width, len(y)), parts[2].reshape(fits, len(y))
            if cut_at:
                score = parts[3].reshape(fits, classes, len(y)).copy()
            else:
                score = np.repeat(base[:, :, None], len(y), axis=2)
            for step in range(upto - cut_at):
                for f in range(fits):
                    for c in range(classes):
                        leaf = _nodes(codes, recent[0][step, f, c], recent[1][step, f, c], DEPTH)
                        score[f, c] += recent[2][step, f, c][leaf]
            yield record, codes, y, owner, score

    rows, cut_at, recent = coded.repartition(tasks).mapInArrow(pack, "codes binary, y binary, members binary"), 0, None
    rows = staged(rows)
    if n_rows <= WHOLE_ROWS:
        def deal(batches):
            """The rows of each fit, in the blocks they travel in."""
            for batch in batches:
                for codes, y, owner in zip(*(c.to_pylist() for c in batch.columns)):
                    y, owner = np.frombuffer(y, np.int32), np.frombuffer(owner, np.uint8).reshape(fits, -1).astype(bool)
                    codes = np.frombuffer(codes, np.uint8).reshape(width, len(y))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.arange(fits, dtype=np.int32)),
                        pa.array([codes[:, mine].tobytes() for mine in owner], pa.binary()),
                        pa.array([y[mine].tobytes() for mine in owner], pa.binary())], names=["fit", "codes", "y"])

        def whole(batches):
            held: dict = {}
            for batch in batches:
                for f, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                    held.setdefault(f, []).append(parts)
            for f, blocks in held.items():
                own = np.concatenate([np.frombuffer(codes, np.uint8).reshape(width, -1) for codes, _ in blocks], axis=1)
                labels = np.concatenate([np.frombuffer(y, np.int32) for _, y in blocks])
                trees = _grow(own, labels, share[f], base[f], rounds, bins)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f], pa.int32()), *(pa.array([t.tobytes()], pa.binary()) for t in trees)],
                    names=["fit", "feature", "cut", "value"])

        # As many blocks for each fit, so a range of the fits' numbers is one fit.
        grown = rows.mapInArrow(deal, "fit int, codes binary, y binary").repartitionByRange(fits, "fit").mapInArrow(
            whole, "fit int, feature binary, cut binary, value binary")
        for row in grown.collect():
            for out, name, kind in ((model.feature, "feature", np.int64), (model.cut, "cut", np.int64), (model.value, "value", float)):
                out[:, row["fit"]] = np.frombuffer(row[name], kind).reshape(rounds, classes, -1)
        return model
    rows = rows.coalesce(tasks)
    for step in range(rounds):
        if step and step % CUT_ROUNDS == 0:
            recent = (model.feature[cut_at:step], model.cut[cut_at:step], model.value[cut_at:step])

            def rescore(batches, since=cut_at, now=step):
                for batch in batches:
                    for record, *_, score in load(batch, since, now):
                        yield pa.RecordBatch.from_arrays(
                            [*(c.slice(record, 1) for c in batch.columns[:3]), pa.array([score.tobytes()], pa.binary())],
                            names=["codes", "y", "members", "score"])

            rows = staged(
                rows.mapInArrow(rescore, "codes binary, y binary, members binary, score binary")).coalesce(tasks)
            cut_at = step
        recent = (model.feature[cut_at:step], model.cut[cut_at:step], model.value[cut_at:step])
        sums = None
        for level in range(DEPTH):
            nodes, tree = 1 << level, (model.feature[step], model.cut[step])

            def histogram(batches, since=cut_at, now=step, level=level, nodes=nodes, tree=tree):
                total = np.zeros((fits, classes, nodes * width * bins, 3))
                for batch in batches:
                    for _, codes, y, owner, score in load(batch, since, now):
                        chance = softmax(score, axis=1)
                        for f in range(fits):
                            mine = np.flatnonzero(owner[f])
                            total[f] += _histograms(
                                codes[:, mine], y[mine], chance[f][:, mine], tree[0][f], tree[1][f], level, bins)
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

            found = rows.mapInArrow(histogram, "sums binary").collect()
            sums = sum(np.frombuffer(row["sums"]) for row in found).reshape(fits, classes, nodes, width, bins, 3)
            feature, cut, lefts, rights = _best_splits(sums)
            first = nodes - 1
            model.feature[step][:, :, first:first + nodes] = feature
            model.cut[step][:, :, first:first + nodes] = cut
        model.value[step] = _leaves(lefts, rights)
        # Classes that a fit has never seen stay where they are.
        model.value[step][share == 0] = 0.0
    return model
