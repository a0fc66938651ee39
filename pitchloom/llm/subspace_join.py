"""Near-duplicate vectors by a pigeonhole join over low-dimensional subspaces.

Unit vectors at cosine c are at squared distance 2 - 2c. They are rotated at random and cut into
blocks; a pair within the distance is within its share of the squared distance in one block at least,
shares being proportional to dimensions. Each block is range-joined on a grid over its first
dimensions: a vector is listed in every cell that a box of half the block's distance around it meets,
so near vectors share a cell. Inside a cell, matrix products find the pairs within the block's budget,
and the union of these candidates is verified on the whole vectors in double precision.

Vectors move once: those of a label are dealt into bundles, and a task that holds two bundles lists
both in the cells of every block, so neither lists of cells nor whole vectors are shuffled by cell.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pitchloom.llm.common import components, union_labels
from pitchloom.runtime import blocks_for, durable, every_pair, staged

LEAST_COSINE = 0.98
BLOCKS = 4
# Dimensions of the grid in each block, and a cell's width in block distances.
GRID, CELL_WIDTH = 3, 2.5
# Vectors of a label in a bundle at most, and of a cell compared with the others at once.
BUNDLE, PART = 8_192, 1024
# Above rounding, so that no pair is lost at a block's border.
SLACK = 1e-9


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """A random rotation that depends on the number of dimensions only."""
    return np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]


@lru_cache(maxsize=8)
def blocks_of(dims: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dims, min(BLOCKS, dims) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def _budget(dims: int, block: tuple[int, int], least_cosine: float) -> float:
    return (2 - 2 * least_cosine) * (block[1] - block[0]) / dims


def _lowest(turned: np.ndarray, block, reach: float) -> np.ndarray:
    """The first cell in each grid dimension that a vector is listed in; missing dimensions are 0."""
    begin, end = block
    cells = np.zeros((len(turned), GRID), np.int64)
    some = min(GRID, end - begin)
    cells[:, :some] = np.floor((turned[:, begin:begin + some] - reach / 2) / (CELL_WIDTH * reach))
    return cells


def _listed(turned: np.ndarray, block, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(cells, rows): every cell that the box around a vector meets."""
    low, high = _lowest(turned, block, reach), _lowest(turned + reach, block, reach)
    cells, rows = [], []
    for step in product((0, 1), repeat=GRID):
        cell = low + np.array(step)
        at = np.flatnonzero((cell <= high).all(axis=1))
        cells.append(cell[at])
        rows.append(at)
    return np.concatenate(cells), np.concatenate(rows)


def _linked(x: np.ndarray, y: np.ndarray, same: bool, least_cosine: float):
    """Pairs (i, j) of rows of the turned vectors ``x`` and ``y`` that link, each once and in pieces; in one
    bundle (``same``) with i < j. A pair counts in the first block that has it, in the lowest cell of both."""
    dims = x.shape[1]
    spans = blocks_of(dims)
    for number, block in enumerate(spans):
        begin, end = block
        budget = _budget(dims, block, least_cosine) + SLACK
        reach = np.sqrt(_budget(dims, block, least_cosine)) + SLACK
        low_x, low_y = _lowest(x, block, reach), _lowest(y, block, reach)
        (cells_x, rows_x), (cells_y, rows_y) = _listed(x, block, reach), _listed(y, block, reach)
        _, of = np.unique(np.concatenate([cells_x, cells_y]), axis=0, return_inverse=True)
        of_x, of_y = of[:len(rows_x)], of[len(rows_x):]
        order_x, order_y = np.argsort(of_x, kind="stable"), np.argsort(of_y, kind="stable")
        ends = np.arange(int(of.max(initial=-1)) + 2)
        cuts_x, cuts_y = (np.searchsorted(o[r], ends) for o, r in ((of_x, order_x), (of_y, order_y)))
        for cell in np.flatnonzero((np.diff(cuts_x) > 0) & (np.diff(cuts_y) > 0)):
            places = order_x[cuts_x[cell]:cuts_x[cell + 1]]
            here, there = rows_x[places], rows_y[order_y[cuts_y[cell]:cuts_y[cell + 1]]]
            own, far = x[here, begin:end], y[there, begin:end]
            far_size = (far * far).sum(axis=1)
            for at in range(0, len(here), PART):
                part = own[at:at + PART]
                apart = (part * part).sum(axis=1)[:, None] + far_size - 2 * (part @ far.T)
                i, j = np.nonzero(apart <= budget + SLACK)
                i, j = here[at:at + PART][i], there[j]
                if same:
                    i, j = i[i < j], j[i < j]
                lowest = np.maximum(low_x[i], low_y[j]) == cells_x[places[0]]
                i, j = i[lowest.all(axis=1)], j[lowest.all(axis=1)]
                for some in range(0, len(i), 65_536):
                    yield _verified(x, y, i[some:some + 65_536], j[some:some + 65_536], number, least_cosine)


def _verified(x, y, i, j, number: int, least_cosine: float):
    dims = x.shape[1]
    inside = [((x[i, a:b] - y[j, a:b]) ** 2).sum(axis=1) <= _budget(dims, (a, b), least_cosine) + SLACK
              for a, b in blocks_of(dims)[:number + 1]]
    some = inside[-1] & ~np.any(inside[:-1], axis=0) if number else inside[-1]
    some &= (x[i] * y[j]).sum(axis=1) >= least_cosine
    return i[some], j[some]


def bundles(distinct: DataFrame, number: int) -> DataFrame:
    """(label, dims, bundle, nodes, copies, x): the vectors of ``distinct`` (node, label, embedding, copies) in bundles
    of one label and length, as they are stored."""
    kind = "f4" if distinct.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"

    def run(batches):
        held: dict = {}
        task, sent = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            nodes, labels, vectors, copies = (batch.column(i) for i in range(4))
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum([0, *pc.list_value_length(vectors).to_pylist()])
            for at, (node, label, n) in enumerate(zip(nodes.to_pylist(), labels.to_pylist(), copies.to_pylist())):
                key = label, int(ends[at + 1] - ends[at])
                rows = held.setdefault(key, [])
                rows.append((node, n, flat[ends[at]:ends[at + 1]].tobytes()))
                if len(rows) == BUNDLE:
                    yield record(key, held.pop(key), task + sent)
                    sent += 1
        for key, rows in held.items():
            yield record(key, rows, task + sent)
            sent += 1

    def record(key, rows, bundle):
        nodes, copies, vectors = zip(*rows)
        parts = [np.array(part, np.int64).tobytes() for part in (nodes, copies)] + [b"".join(vectors)]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], pa.int64()) for v in (*key, bundle)] + [pa.array([p], pa.binary()) for p in parts],
            names=["label", "dims", "bundle", "nodes", "copies", "x"])

    # Labels in one range after the other, so that a task has few of them and their bundles are full.
    dealt = distinct.select("node", F.col("label").cast("long").alias("label"), "embedding", "copies").repartitionByRange(
        number, "label", F.size("embedding"), F.xxhash64("node"))
    return dealt.mapInArrow(
        run, "label bigint, dims bigint, bundle bigint, nodes binary, copies binary, x binary").withColumn("kind", F.lit(kind))


def verified(packed: DataFrame, least_cosine: float) -> DataFrame:
    """(node, links, root): in a pair of bundles, the copies a vector links to, and its linked set's vector."""
    pairs = every_pair(packed).where(
        "label <= label_there AND label >= label_there AND dims <= dims_there AND dims >= dims_there AND bundle <= bundle_there")

    def turned(record, suffix):
        kind, dims = record["kind"].as_py(), record["dims"].as_py()
        x = np.frombuffer(record["x" + suffix].as_buffer(), kind).reshape(-1, dims).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        nodes, copies = (np.frombuffer(record[c + suffix].as_buffer(), np.int64) for c in ("nodes", "copies"))
        return x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(dims), nodes, copies

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                record = {name: batch.column(k)[at] for k, name in enumerate(batch.schema.names)}
                same = record["bundle"].as_py() == record["bundle_there"].as_py()
                x, nodes, copies = turned(record, "")
                y, far_nodes, far_copies = (x, nodes, copies) if same else turned(record, "_there")
                # Rows of both bundles in one line; in one bundle the two lines are one.
                off = 0 if same else len(x)
                node = nodes if same else np.concatenate([nodes, far_nodes])
                label, links = np.arange(len(node)), np.zeros(len(node), np.int64)
                for i, j in _linked(x, y, same, least_cosine):
                    np.add.at(links, i, far_copies[j])
                    np.add.at(links, off + j, copies[i])
                    union_labels(label, i, off + j)
                hit = np.flatnonzero(links)
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[hit]), pa.array(links[hit]), pa.array(node[label[hit]])],
                        names=["node", "links", "root"])

    return pairs.mapInArrow(run, "node bigint, links bigint, root bigint")


def near_vectors(rows: DataFrame, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows`` (vec_id, embedding, label, ...).

    Only vectors of equal, not null labels and equal length link. Null, empty and zero vectors, and
    those that hold nulls or values that are not finite, link with nothing. Equal vectors are
    compared once and count as often as they come; repeated rows are such copies. Rows with a null
    id take part and get their component's smallest id.
    """
    # A component that is null makes the first test null or false; NaN is above every number.
    finite = F.expr("forall(embedding, x -> x is not null and abs(x) < double('inf'))")
    good = F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = rows.select("vec_id", "embedding", "label").withColumn("_good", F.coalesce(good, F.lit(False)))
    valid = rows.where("_good").drop("_good")
    distinct = staged(
        valid.groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    number = blocks_for(rows.sparkSession, distinct.count(), BUNDLE)
    found = staged(verified(durable(bundles(distinct, number)), least_cosine))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = (
        distinct.select("node", "least", "copies").join(links, "node", "left").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "root").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "component_id")
    # Vectors go along with the first of these joins only.
    named = valid.join(distinct.select("label", "embedding", "node"), ["label", "embedding"]).select("vec_id", "node")
    linked = named.join(nodes, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("not _good").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
