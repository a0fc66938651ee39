"""K-means for several numbers of clusters and starts at once, and exact silhouettes.

The centroids of all runs are stacked, so one pass over the rows moves every run that has not settled: a
task adds up vectors and counts for each centroid in one array of fixed size. Silhouettes use whole
Euclidean distances between all blocks of rows; a block's task keeps one sum for each of its rows and cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitchloom.operators.similarity import standardise
from pitchloom.runtime import blocks_for, durable, every_pair, staged

STARTS = 10
# A run has settled when the squared moves of its centroids are at most this share of the mean variance.
TOLERANCE = 1e-4
# Rows, chosen by a hash, among which first centroids are looked for.
SEED_ROWS = 4_096
# Tasks of a pass at most, and rows below which it takes no further one.
MOST_TASKS, TASK_ROWS = 64, 10_000
BLOCK_ROWS = 8_192
# Rows whose distances are taken at once in a pass.
PASS_ROWS = 2_048


@dataclass
class Clusterings:
    """The best run of each number of clusters: centroids, cost and steps taken."""

    centroids: dict[int, np.ndarray]
    cost: dict[int, float]
    steps: dict[int, int]

    def assign(self, df: DataFrame, column: str, out: str = "clusters") -> DataFrame:
        """``df`` with an array of cluster numbers, one for each k in rising order."""
        stacks = [self.centroids[k] for k in sorted(self.centroids)]

        @F.pandas_udf("array<int>")
        def nearest(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=object)
            rows = np.stack([np.asarray(v, np.float64) for v in values])
            found = np.stack([_distances(rows, c).argmin(axis=1) for c in stacks], axis=1)
            return pd.Series(list(found.astype(np.int32)))

        return df.withColumn(out, nearest(column))


def _distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances."""
    flat = (rows**2).sum(axis=1)[:, None] - 2 * rows @ centroids.T + (centroids**2).sum(axis=1)
    return np.maximum(flat, 0.0)


def _whole_distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances to full precision: where the short way loses digits they are taken again from differences."""
    size, far = (rows**2).sum(axis=1)[:, None], (others**2).sum(axis=1)
    square = rows @ (-2 * others.T)
    square += size
    square += far
    # Rows that are close to another one are few.
    close = np.flatnonzero(square.min(axis=1) < 1e-4 * (size[:, 0] + far.max()))
    a, b = np.nonzero(square[close] < 1e-4 * (size[close] + far))
    a = close[a]
    for start in range(0, len(a), 50_000):
        i, j = a[start:start + 50_000], b[start:start + 50_000]
        square[i, j] = ((rows[i] - others[j]) ** 2).sum(axis=1)
    return np.sqrt(square, out=square)


def _first_centroids(sample: np.ndarray, k: int, rng) -> np.ndarray:
    """Rows of the sample, each drawn with a chance that grows with its squared distance to those before."""
    chosen = [sample[rng.integers(len(sample))]]
    left = _distances(sample, chosen[0][None])[:, 0]
    while len(chosen) < k:
        total = left.sum()
        at = rng.choice(len(sample), p=left / total) if total > 0 else rng.integers(len(sample))
        chosen.append(sample[at])
        left = np.minimum(left, _distances(sample, sample[at][None])[:, 0])
    return np.stack(chosen)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def fit_runs(rows: DataFrame, column: str, k_values, starts: int = STARTS, seed: int = 0,
             tolerance: float = TOLERANCE) -> Clusterings:
    """Best of several starts for each k on the vectors in ``column`` (no unknown values).

    Every run ends when it has settled, however many steps that takes: each lowers the cost of the run, and
    with a tolerance of 0 the last one leaves every row where it is. A centroid that loses all rows stays. First
    centroids come from at most ``SEED_ROWS`` rows; all rows move them. Fewer rows than k repeat some.
    """
    vectors = staged(rows.select(F.col(column).cast("array<double>").alias("x")))
    n = vectors.count()
    if not n:
        raise ValueError("no rows to cluster")
    # One wave of tasks: starting a task costs more than thousands of rows.
    tasks = int(min(MOST_TASKS, rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))
    vectors = staged(vectors.repartition(tasks, F.xxhash64("x"))).coalesce(tasks)
    sample = np.array([r["x"] for r in vectors.orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(SEED_ROWS).collect()])
    runs = [
        {"k": k, "c": _first_centroids(sample, k, np.random.default_rng([seed, start, k])), "cost": np.inf, "steps": 0}
        for k in k_values for start in range(starts)
    ]
    spread = float(sample.var(axis=0).mean())

    def pack(batches):
        """One record for some thousands of rows."""
        for batch in batches:
            for at in range(0, batch.num_rows, PASS_ROWS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_matrix(batch.column(0).slice(at, PASS_ROWS)).tobytes()], pa.binary())], names=["x"])

    # A checkpoint keeps its number of parts, so that every pass uses all tasks.
    packed = durable(vectors.mapInArrow(pack, "x binary"))
    active, step = list(range(len(runs))), -1
    while active:
        step += 1
        stacks = [runs[r]["c"] for r in active]
        ends = np.cumsum([0] + [len(c) for c in stacks])

        def move(batches, stacks=stacks, ends=ends):
            every = np.concatenate(stacks)
            width, size = every.shape[1], (every**2).sum(axis=1)
            sums, counts, cost = np.zeros(every.shape), np.zeros(ends[-1]), np.zeros(len(stacks))
            for batch in batches:
                for value in batch.column(0):
                    x = np.frombuffer(value.as_buffer()).reshape(-1, width)
                    # Products with the centroids of all runs at once, and their sums likewise.
                    apart = x @ (-2 * every.T)
                    apart += size
                    member, lines, own_size = np.zeros(apart.shape), np.arange(len(x)), (x * x).sum(axis=1)
                    for i, (begin, end) in enumerate(zip(ends, ends[1:])):
                        own = begin + apart[:, begin:end].argmin(axis=1)
                        cost[i] += np.maximum(apart[lines, own] + own_size, 0.0).sum()
                        member[lines, own] = 1.0
                    sums += member.T @ x
                    counts += member.sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a.tobytes()], pa.binary()) for a in (sums, counts, cost)], names=["sums", "counts", "cost"])

        # One array of fixed size from each of at most MOST_TASKS tasks.
        found = packed.mapInArrow(move, "sums binary, counts binary, cost binary").collect()
        sums, counts, cost = (sum(np.frombuffer(r[name]) for r in found) for name in ("sums", "counts", "cost"))
        sums = sums.reshape(ends[-1], -1)
        still = []
        for i, r in enumerate(active):
            run, some = runs[r], slice(ends[i], ends[i + 1])
            run["cost"], run["steps"] = float(cost[i]), step
            filled = counts[some] > 0
            new = np.where(filled[:, None], sums[some] / np.maximum(counts[some], 1)[:, None], run["c"])
            moved = float(((new - run["c"]) ** 2).sum())
            run["c"] = new
            if moved > tolerance * spread:
                still.append(r)
        active = still
    best = {}
    for run in runs:
        if run["k"] not in best or run["cost"] < best[run["k"]]["cost"]:
            best[run["k"]] = run
    return Clusterings(*({k: run[name] for k, run in best.items()} for name in ("c", "cost", "steps")))


def fit_clusterings(df: DataFrame, column: str, k_values, seed: int = 0, starts: int = STARTS,
                    train: DataFrame | None = None, tolerance: float = TOLERANCE) -> tuple[DataFrame, Clusterings]:
    """(every row with its standardised vector ``scaled`` and ``clusters``, the fits): moments and
    centroids come from the training rows only."""
    fit_on = df if train is None else train
    scaled = standardise(df, column, "scaled", fit_on=fit_on)
    fitted = fit_runs(standardise(fit_on, column, "scaled", fit_on=fit_on), "scaled", k_values, starts, seed, tolerance)
    return fitted.assign(scaled, "scaled"), fitted


def silhouettes(rows: DataFrame, vector: str, clusters: str, sizes: list[int]) -> DataFrame:
    """(place, silhouette): mean silhouette of each of the clusterings in an array column.

    ``sizes`` gives the number of clusters of each. Exact over all rows: a task keeps a block of rows with their sums
    of distances to each cluster and reads all rows, block by block, from a checkpoint; it leaves one sum for each
    clustering. A row alone in its cluster has 0; a clustering with fewer than two filled clusters null.
    """
    ends = np.cumsum([0, *sizes]).tolist()
    numbered = rows.select(F.col(vector).cast("array<double>").alias("x"), F.col(clusters).alias("l"))

    def pack(batches):
        """One record for each task: vectors by row, clusters by (row, clustering)."""
        vectors, labels = [], []
        for batch in batches:
            if batch.num_rows:
                vectors.append(_matrix(batch.column(0)))
                labels.append(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1))
        if vectors:
            parts = (np.concatenate(vectors).tobytes(), np.concatenate(labels).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=["x", "l"])

    number = blocks_for(rows.sparkSession, rows.count(), BLOCK_ROWS)
    blocks = durable(numbered.repartition(number).mapInArrow(pack, "x binary, l binary").withColumn(
        "block", F.spark_partition_id()))
    # Rows of each cluster: one short array from each block.
    counts = np.zeros(ends[-1])

    def labels_of(value):
        return np.frombuffer(value.as_buffer(), np.int32).reshape(-1, len(sizes))

    def member(label):
        out = np.zeros((len(label), ends[-1]))
        for place, at in enumerate(ends[:-1]):
            out[np.arange(len(label)), at + label[:, place]] = 1.0
        return out

    def count(batches):
        total = np.zeros(ends[-1])
        for batch in batches:
            for value in batch.column(0):
                total += member(labels_of(value)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])

    for row in blocks.select("l").mapInArrow(count, "n binary").coalesce(1).toLocalIterator():
        counts += np.frombuffer(row["n"])
    filled = [int((counts[at:end] > 0).sum()) for at, end in zip(ends, ends[1:])]

    def sums(batches):
        held: dict = {}
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for at in range(batch.num_rows):
                block = columns["block"][at].as_py()
                if block not in held:
                    label = labels_of(columns["l"][at])
                    x = np.frombuffer(columns["x"][at].as_buffer(), np.float64).reshape(len(label), -1)
                    held[block] = (x, label, np.zeros((len(label), ends[-1])))
                x, _, d = held[block]
                there = labels_of(columns["l_there"][at])
                y = np.frombuffer(columns["x_there"][at].as_buffer(), np.float64).reshape(len(there), -1)
                near = member(there)
                for far in range(0, len(y), 2048):
                    for start in range(0, len(x), 256):
                        d[start:start + 256] += _whole_distances(x[start:start + 256], y[far:far + 2048]) @ near[far:far + 2048]
        for _, label, d in held.values():
            for place, (at, end) in enumerate(zip(ends, ends[1:])):
                if filled[place] > 1:
                    yield _silhouette_sum(place, d[:, at:end], label[:, place], counts[at:end])

    def _silhouette_sum(place, d, own, n):
        rows = np.arange(len(own))
        inner = d[rows, own] / np.maximum(n[own] - 1, 1)
        means = np.where(n > 0, d / np.maximum(n, 1), np.inf)
        means[rows, own] = np.inf
        outer = means.min(axis=1)
        most = np.maximum(inner, outer)
        value = np.where((n[own] > 1) & (most > 0), (outer - inner) / np.where(most > 0, most, 1.0), 0.0)
        return pa.RecordBatch.from_arrays(
            [pa.array([place], pa.int32()), pa.array([float(value.sum())]), pa.array([len(own)], pa.int64())],
            names=["place", "total", "n"])

    found = every_pair(blocks).mapInArrow(sums, "place int, total double, n long")
    places = rows.sparkSession.createDataFrame([(place,) for place, n in enumerate(filled) if n], "place int")
    return places.join(
        found.groupBy("place").agg((F.sum("total") / F.sum("n")).alias("silhouette")), "place", "left").select(
        "place", "silhouette")
