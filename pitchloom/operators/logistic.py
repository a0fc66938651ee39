"""Multinomial logistic models, several fits on subsets of the same rows in shared passes.

Every fit walks by Newton steps on the driver, which holds weights only: a pass over the rows adds up, at the current
point of each fit that is still walking, loss, slopes and curvature in one array of fixed size for each task.
The penalised loss has one optimum, so a walk ends there after a few passes, however many fits share them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitchloom.operators.boosting import MOST_TASKS, _double_array, _matrix, softmax
from pitchloom.operators.similarity import SMALL_SPREAD
from pitchloom.runtime import durable

# Rows below which a pass takes no further task.
TASK_ROWS = 10_000
# A walk ends when a whole step would lower the mean loss by less than this; smaller rises are rounding.
TOLERANCE = 1e-13


@dataclass
class Logistics:
    """Weights by (fit, class, feature and intercept) on features standardised with the moments of each fit."""

    names: list[str]
    mean: np.ndarray
    spread: np.ndarray
    seen: np.ndarray
    weights: np.ndarray

    def inputs(self, values: np.ndarray, fit: int) -> np.ndarray:
        scaled = (values - self.mean[fit]) / self.spread[fit]
        return np.concatenate([scaled, np.ones((len(values), 1))], axis=1)

    def chances(self, x: np.ndarray, weights: np.ndarray, fit: int) -> np.ndarray:
        """Class probabilities; a class that the fit never saw has 0."""
        return softmax(np.where(self.seen[fit] > 0, x @ weights.T, -np.inf))

    def predict_fits(self, df: DataFrame, out: str = "fits") -> DataFrame:
        """``df`` with an array of class probabilities, one for each fit, in one pass."""
        model, (number, classes) = self, self.seen.shape

        @F.arrow_udf("array<array<double>>")
        def run(values: pa.Array) -> pa.Array:
            n = len(values)
            x = np.nan_to_num(_matrix(values, len(model.names)), nan=0.0)
            chance = np.stack(
                [model.chances(model.inputs(x, f), model.weights[f], f) for f in range(number)], axis=1)
            inner = pa.ListArray.from_arrays(
                pa.array(np.arange(0, n * number * classes + 1, classes, dtype=np.int32)), pa.array(chance.ravel()))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, n * number + 1, number, dtype=np.int32)), inner)

        return df.withColumn(out, run(_double_array(self.names)))


def fit_logistics(
    train: DataFrame, names, members: str, label: str = "outcome_index", classes: int = 3, strength: float = 1.0,
    max_iter: int = 200,
) -> Logistics:
    """One model for each place of the 0/1 array column ``members``: mean log-loss and an L2 term of 1 / (strength
    times rows) on the weights, none on intercepts. Unknown values count as zero. An empty fit raises ValueError."""
    names, width = list(names), len(names)
    raw = train.select(
        _double_array(names).alias("x"), F.col(label).cast("int").alias("y"), F.col(members).alias("m"))
    n_rows = raw.count()
    if not n_rows:
        raise ValueError("no training rows")
    fits = len(raw.first()["m"])
    tasks = int(min(MOST_TASKS, train.sparkSession.sparkContext.defaultParallelism, -(-n_rows // TASK_ROWS)))

    def pack(batches):
        """One record for each batch of rows: features by (row, feature), labels, memberships by (row, fit)."""
        for batch in batches:
            if batch.num_rows:
                x = np.nan_to_num(_matrix(batch.column(0), width), nan=0.0)
                owner = batch.column(2).flatten().to_numpy().astype(np.uint8)
                parts = (x.tobytes(), batch.column(1).to_numpy().astype(np.int32).tobytes(), owner.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=["x", "y", "m"])

    # A checkpoint keeps its number of parts, so that every pass uses all tasks.
    rows = durable(raw.repartition(tasks).mapInArrow(pack, "x binary, y binary, m binary"))

    def totals(of) -> np.ndarray:
        """The sum over all blocks of rows of the flat array that ``of`` makes of (features, labels, memberships)."""

        def add(batches):
            total = None
            for batch in batches:
                for record in range(batch.num_rows):
                    x, y, owner = (np.frombuffer(column[record].as_buffer(), kind) for column, kind in zip(
                        batch.columns, (np.float64, np.int32, np.uint8)))
                    found = of(x.reshape(len(y), width), y, owner.reshape(len(y), fits).astype(bool))
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        return sum(np.frombuffer(row["sums"]) for row in rows.mapInArrow(add, "sums binary").collect())

    first = totals(lambda x, y, owner: np.concatenate(
        [(owner.T.astype(float) @ np.eye(classes)[y]).ravel(), (owner.T.astype(float) @ x).ravel()]))
    seen, sums = np.split(first, [fits * classes])
    seen = seen.reshape(fits, classes)
    n = seen.sum(axis=1)
    if (n == 0).any():
        raise ValueError("a fit has no training rows")
    mean = sums.reshape(fits, width) / n[:, None]
    square = totals(lambda x, y, owner: np.concatenate(
        [((x[owner[:, f]] - mean[f]) ** 2).sum(axis=0) for f in range(fits)])).reshape(fits, width)
    spread = np.sqrt(square / n[:, None])
    model = Logistics(
        names, mean, np.where(spread < SMALL_SPREAD, 1.0, spread), seen, np.zeros((fits, classes, width + 1)))
    model.weights[:, :, width] = np.where(seen > 0, np.log(np.maximum(seen, 1) / n[:, None]), 0.0)
    size = classes * (width + 1)
    # The intercepts of all classes can move together; the curvature gets a trace of a penalty there.
    penalty = np.tile(np.append(np.ones(width), 0.0), classes)[None] / (strength * n[:, None])
    trace = np.tile(np.append(np.zeros(width), 1e-9), classes)
    lowest, step, walking = np.full(fits, np.inf), np.zeros((fits, size)), list(range(fits))
    point = model.weights.reshape(fits, size)
    for _ in range(max_iter):
        tried = point + step

        def slopes(x, y, owner, tried=tried, walking=tuple(walking)):
            found = []
            for f in walking:
                mine = owner[:, f]
                own, of = model.inputs(x[mine], f), y[mine]
                chance = model.chances(own, tried[f].reshape(classes, -1), f)
                off = chance - np.eye(classes)[of]
                curve = np.empty((classes, width + 1, classes, width + 1))
                for c in range(classes):
                    for d in range(c, classes):
                        bend = chance[:, c] * ((c == d) - chance[:, d])
                        curve[c, :, d] = curve[d, :, c] = (own * bend[:, None]).T @ own
                loss = -np.log(np.maximum(chance[np.arange(len(of)), of], 1e-300)).sum()
                found += [[loss], (off.T @ own).ravel(), curve.ravel()]
            return np.concatenate(found)

        parts = totals(slopes).reshape(len(walking), -1)
        still = []
        for f, part in zip(walking, parts / n[walking, None]):
            loss = part[0] + 0.5 * (penalty[f] * tried[f] ** 2).sum()
            if loss > lowest[f] + TOLERANCE:
                # Too far along this way.
                step[f] /= 2
                if np.abs(step[f]).max() > 1e-12:
                    still.append(f)
                continue
            point[f], lowest[f] = tried[f], loss
            slope = part[1:1 + size] + penalty[f] * tried[f]
            curve = part[1 + size:].reshape(size, size) + np.diag(penalty[f] + trace)
            step[f] = -np.linalg.lstsq(curve, slope, rcond=1e-13)[0]
            if -slope @ step[f] > TOLERANCE:
                still.append(f)
        walking = still
        if not walking:
            break
    model.weights = point.reshape(fits, classes, width + 1)
    return model
