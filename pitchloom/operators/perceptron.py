"""Perceptrons with one hidden layer, several feature sets in shared passes.

The training rows are standardised once and travel in blocks, one array for each feature. Every fit walks by
L-BFGS on the driver, which holds weights only; a pass over the rows adds up, at the current point of each fit that
is still walking, loss and slopes in one array of fixed size for each task. So nine fits cost the passes
of the one that takes most steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitchloom.operators.boosting import MOST_TASKS, _double_array, _matrix, softmax
from pitchloom.operators.similarity import vector_moments
from pitchloom.runtime import durable

# Rows below which a training pass takes no further task.
TASK_ROWS = 10_000
# Steps that a walk remembers; points it tries along one direction.
MEMORY, TRIES = 10, 20
DECREASE, CURVATURE = 1e-4, 0.9
# A walk ends when this many steps lower the loss by no more than this share of the first loss.
RECENT, TOLERANCE = 20, 1e-6


def descend(x: np.ndarray, steps: int):
    """L-BFGS as a generator: yields points, is sent (loss, slope) there, and returns the last point."""
    loss, slope = yield x
    falls, pairs = [loss], []
    for _ in range(steps):
        if np.linalg.norm(slope) <= max(TOLERANCE * abs(loss), 1e-8):
            break
        way = _direction(slope, pairs)
        steep = float(way @ slope)
        if steep >= 0:
            pairs, way = [], -slope
            steep = float(way @ slope)
        low, high = 0.0, np.inf
        rate = 1.0 if pairs else min(1.0, 1.0 / np.linalg.norm(slope))
        for _ in range(TRIES):
            there = x + rate * way
            value, fresh = yield there
            if not value <= loss + DECREASE * rate * steep:
                high = rate
            elif fresh @ way < CURVATURE * steep:
                low = rate
            else:
                break
            rate = 2 * rate if high == np.inf else (low + high) / 2
        else:
            if not pairs:
                break
            # No such point along this way: the next step begins afresh.
            pairs = []
            continue
        moved, bent = there - x, fresh - slope
        if moved @ bent > 1e-12 * (bent @ bent):
            pairs = [*pairs, (moved, bent)][-MEMORY:]
        x, loss, slope = there, value, fresh
        falls.append(loss)
        if len(falls) > RECENT and falls[-RECENT - 1] - loss <= TOLERANCE * abs(falls[0]):
            break
    return x


def _direction(slope: np.ndarray, pairs) -> np.ndarray:
    way, shares = -slope, []
    for moved, bent in reversed(pairs):
        share = (moved @ way) / (moved @ bent)
        shares.append(share)
        way = way - share * bent
    if pairs:
        moved, bent = pairs[-1]
        way = way * ((moved @ bent) / (bent @ bent))
    for (moved, bent), share in zip(pairs, reversed(shares)):
        way = way + (share - (bent @ way) / (moved @ bent)) * moved
    return way


def _layers(point: np.ndarray, width: int, hidden: int, classes: int):
    """Weights and offsets of both layers, as views of one flat array."""
    cuts = np.cumsum([hidden * width, hidden, classes * hidden])
    first, off, second, last = np.split(point, cuts)
    return first.reshape(hidden, width), off[:, None], second.reshape(classes, hidden), last[:, None]


def _forward(x: np.ndarray, layers):
    """(hidden values, class probabilities) by (unit, row) of rows that lie in columns."""
    first, off, second, last = layers
    inner = 1.0 / (1.0 + np.exp(-np.clip(first @ x + off, -30, 30)))
    return inner, softmax(second @ inner + last, axis=0)


def _loss_and_slope(x: np.ndarray, y: np.ndarray, layers) -> np.ndarray:
    """Sum of losses, then the slope of that sum by each weight."""
    second = layers[2]
    inner, chance = _forward(x, layers)
    rows = np.arange(len(y))
    loss = -np.log(np.maximum(chance[y, rows], 1e-30)).sum(dtype=np.float64)
    chance[y, rows] -= 1
    back = (second.T @ chance) * inner * (1 - inner)
    parts = (back @ x.T, back.sum(axis=1), chance @ inner.T, chance.sum(axis=1))
    return np.concatenate([[loss], *(p.ravel().astype(np.float64) for p in parts)])


@dataclass
class Perceptrons:
    """Fitted weights by feature set; ``names`` are all features, ``sets`` the places of each set's own."""

    names: list[str]
    sets: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    points: list[np.ndarray]
    hidden: int
    classes: int

    def scaled(self, values: np.ndarray) -> np.ndarray:
        """Standardised features by (feature, row); unknown values count as zero before that."""
        return (np.nan_to_num(values, nan=0.0) - self.mean).T / self.spread[:, None]

    def predict_fits(self, df: DataFrame, out: str = "fits") -> DataFrame:
        """``df`` with an array of class probabilities, one for each set, in one pass."""
        model, number, classes = self, len(self.sets), self.classes

        @F.arrow_udf("array<array<double>>")
        def run(values: pa.Array) -> pa.Array:
            n = len(values)
            x = model.scaled(_matrix(values, len(model.names)))
            chance = np.stack([
                _forward(x[own], _layers(point, len(own), model.hidden, classes))[1].T
                for own, point in zip(model.sets, model.points)], axis=1)
            inner = pa.ListArray.from_arrays(
                pa.array(np.arange(0, n * number * classes + 1, classes, dtype=np.int32)), pa.array(chance.ravel()))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, n * number + 1, number, dtype=np.int32)), inner)

        return df.withColumn(out, run(_double_array(self.names)))


def fit_perceptrons(
    train: DataFrame, sets, label: str, classes: int, hidden: int = 32, max_iter: int = 200, seed: int = 0,
) -> Perceptrons:
    """One perceptron for each list of feature names in ``sets``, all on the same rows: sigmoid units, softmax,
    mean log-loss without a penalty, at most ``max_iter`` steps."""
    names = sorted({name for own in sets for name in own})
    places = [np.array([names.index(name) for name in own]) for own in sets]
    raw = train.select(_double_array(names).alias("x"), F.col(label).cast("int").alias("y"))
    moments = vector_moments(raw, "x").first()
    n_rows = raw.count()
    if not n_rows:
        raise ValueError("no training rows")
    model = Perceptrons(
        names, places, np.array(moments["_mean"]), np.array(moments["_sd"]), [], hidden, classes)
    # One wave of tasks: starting a task costs more than thousands of rows, and blocks keep each one small.
    tasks = int(min(MOST_TASKS, train.sparkSession.sparkContext.defaultParallelism, -(-n_rows // TASK_ROWS)))

    def pack(batches):
        """One record for each batch of rows: standardised features by (feature, row), and labels."""
        for batch in batches:
            if batch.num_rows:
                x = model.scaled(_matrix(batch.column(0), len(names))).astype(np.float32)
                y = batch.column(1).to_numpy().astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["x", "y"])

    # A checkpoint keeps its number of parts, so that every pass uses all tasks.
    rows = durable(raw.repartition(tasks).mapInArrow(pack, "x binary, y binary"))
    walks, at = [], {}
    for number, own in enumerate(places):
        draw = np.random.default_rng([seed, number])
        start = np.concatenate([
            draw.normal(size=hidden * len(own)) / np.sqrt(len(own)), np.zeros(hidden),
            draw.normal(size=classes * hidden) / np.sqrt(hidden), np.zeros(classes)])
        walks.append(descend(start, max_iter))
        at[number] = next(walks[-1])
    done = {}
    while at:
        points = {number: point.astype(np.float32) for number, point in at.items()}

        def add(batches, points=points):
            total = None
            for batch in batches:
                for record in range(batch.num_rows):
                    x, y = (np.frombuffer(column[record].as_buffer(), kind) for column, kind in zip(
                        batch.columns, (np.float32, np.int32)))
                    x = x.reshape(len(names), len(y))
                    found = np.concatenate([
                        _loss_and_slope(x[places[k]], y, _layers(point, len(places[k]), hidden, classes))
                        for k, point in points.items()])
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        sums = sum(np.frombuffer(row["sums"]) for row in rows.mapInArrow(add, "sums binary").collect()) / n_rows
        parts = np.split(sums, np.cumsum([1 + len(point) for point in points.values()])[:-1])
        for number, part in zip(points, parts):
            try:
                at[number] = walks[number].send((part[0], part[1:]))
            except StopIteration as end:
                done[number] = end.value
                del at[number]
    model.points = [done[number] for number in range(len(places))]
    return model
