"""Measures of networks inside a task, as flat arrays over several networks at once.

A unit is a network with a block of its nodes as sources. Cells are (source, node) pairs of a unit and
entries (source, edge) pairs; the arrays of several units lie end to end. Measures:

``betweenness``, ``closeness``
    sums over sources along shortest directed paths. Costs are relaxed from the cells that got
    shorter in the round before; path counts then follow the tight edges level by level, credits go
    back in the opposite order, and each tight edge is used once each way.
``paths``
    smallest id reachable and sum of distances, ignoring direction, on pass counts.
``clustering``
    weighted triangle share of each source.
``pagerank``
    damped rank of the whole network, iterated until no rank changes, null without weights.
``eigenvector``
    leading left eigenvector of the weights; see ``leading_vector``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEASURES = ("betweenness", "closeness", "eigenvector", "pagerank", "clustering", "paths")
# Cells and entries of the units that are solved together (8 bytes each in about ten arrays).
BLOCK_CELLS = 2_000_000
# Rows that wait to be solved together.
READY_ROWS = 50_000
DAMPING = 0.85
RANK_STEPS = 500
RANK_CHANGE = 1e-13
# Two costs are equal within this much, and within this share of them: zero-weight lanes cost 1e12.
TIE, TIE_SHARE = 1e-9, 1e-14
# Classes whose growth differs by less than this share grow alike.
SAME_GROWTH = 1e-9
KRYLOV = 32
CYCLES = 300
RESIDUAL = 1e-12
SETTLED = 1e-8


# --- walks -------------------------------------------------------------------------------


def _ragged(starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Positions of all entries of the cells ``which``, where cell c has starts[c] to starts[c + 1]."""
    first = starts[which]
    sizes = starts[which + 1] - first
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _by_tail(n_cells: int, tail: np.ndarray, *others: np.ndarray):
    order = np.argsort(tail, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=n_cells))])
    return starts, tail[order], *(other[order] for other in others)


def shortest(n_cells: int, origin: np.ndarray, starts, tail, head, cost) -> np.ndarray:
    """Cost from each source to the cells of its unit; entries are grouped by their tail."""
    distance = np.full(n_cells, np.inf)
    distance[origin] = 0.0
    fresh = np.unique(origin)
    while len(fresh):
        at = _ragged(starts, fresh)
        to, via = head[at], distance[tail[at]] + cost[at]
        better = via < distance[to]
        to, via = to[better], via[better]
        np.minimum.at(distance, to, via)
        fresh = np.unique(to)
    return distance


def path_credit(n_cells: int, origin: np.ndarray, distance, tail, head, cost) -> np.ndarray:
    """For each cell the share of its source's shortest paths that run through it."""
    via = distance[tail] + cost
    with np.errstate(invalid="ignore"):
        tight = (
            np.isfinite(via) & (np.abs(via - distance[head]) <= TIE + TIE_SHARE * distance[head])
            & (distance[tail] < distance[head])
        )
    starts, tail, head = _by_tail(n_cells, tail[tight], head[tight])
    waiting = np.bincount(head, minlength=n_cells)
    ways = np.zeros(n_cells)
    ways[origin] = 1.0
    levels, level = [], np.unique(origin)
    while len(level):
        at = _ragged(starts, level)
        levels.append(at)
        np.add.at(ways, head[at], ways[tail[at]])
        np.subtract.at(waiting, head[at], 1)
        reached = np.unique(head[at])
        level = reached[waiting[reached] == 0]
    credit = np.zeros(n_cells)
    for at in reversed(levels):
        np.add.at(credit, tail[at], ways[tail[at]] / ways[head[at]] * (1.0 + credit[head[at]]))
    credit[origin] = 0.0
    return credit


# --- eigenvector -------------------------------------------------------------------------


def strong_classes(n: int, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Number of each node's strongly connected class (depth-first, without recursion)."""
    starts, _, out = _by_tail(n, source, target)
    starts, out = starts.tolist(), out.tolist()
    number, low, label = [0] * n, [0] * n, [-1] * n
    stack, seen, classes = [], 0, 0
    for root in range(n):
        if number[root]:
            continue
        todo = [(root, starts[root])]
        seen += 1
        number[root] = low[root] = seen
        stack.append(root)
        while todo:
            node, at = todo.pop()
            if at < starts[node + 1]:
                todo.append((node, at + 1))
                other = out[at]
                if not number[other]:
                    seen += 1
                    number[other] = low[other] = seen
                    stack.append(other)
                    todo.append((other, starts[other]))
                elif label[other] < 0:
                    low[node] = min(low[node], number[other])
                continue
            if low[node] == number[node]:
                while True:
                    member = stack.pop()
                    label[member] = classes
                    if member == node:
                        break
                classes += 1
            if todo:
                parent = todo[-1][0]
                low[parent] = min(low[parent], low[node])
    return np.array(label)


def growth(n: int, source, target, weight, start: np.ndarray):
    """(value, vector, settled) of the eigenvalue of largest real part that ``start`` can see.

    Restarted Krylov subspaces with orthogonal bases; the residual decides when to stop.
    """
    def push(x):
        return np.bincount(target, x[source] * weight, minlength=n)

    x, value, left = start / np.linalg.norm(start), 0.0, np.inf
    for _ in range(CYCLES):
        size = min(n, KRYLOV)
        basis, small = np.zeros((size + 1, n)), np.zeros((size + 1, size))
        basis[0] = x
        used = size
        for k in range(size):
            y = push(basis[k])
            before = np.linalg.norm(y)
            for _ in range(2):
                part = basis[:k + 1] @ y
                small[:k + 1, k] += part
                y = y - part @ basis[:k + 1]
            length = np.linalg.norm(y)
            if length <= 1e-12 * before or not before:
                used = k + 1
                break
            small[k + 1, k] = length
            basis[k + 1] = y / length
        values, vectors = np.linalg.eig(small[:used, :used])
        best = int(np.argmax(values.real))
        value = float(values[best].real)
        x = vectors[:, best].real @ basis[:used]
        x = x / np.linalg.norm(x) * (1.0 if x.sum() >= 0 else -1.0)
        left = np.linalg.norm(push(x) - value * x)
        if left <= RESIDUAL * max(value, 1e-300):
            break
    return value, x, left <= SETTLED * max(value, 1e-300)


def _reachable(n: int, source, target, begin: np.ndarray) -> np.ndarray:
    starts, _, out = _by_tail(n, source, target)
    seen = begin.copy()
    fresh = np.flatnonzero(seen)
    while len(fresh):
        ahead = np.unique(out[_ragged(starts, fresh)])
        fresh = ahead[~seen[ahead]]
        seen[fresh] = True
    return seen


def leading_vector(n: int, source, target, weight) -> np.ndarray:
    """Left eigenvector of the largest eigenvalue, of unit length, no value below zero.

    Passes circulate in strongly connected classes. The class that grows fastest leads; of several
    that grow alike those count that reach no other of them (only these carry an eigenvector), and of these the one
    with the smallest id. The vector lives on this class and on all it reaches. A network without
    a circle has none (NaN), nor has one whose iteration does not settle.
    """
    none = np.full(n, np.nan)
    some = weight > 0
    source, target, weight = source[some], target[some], weight[some]
    if not len(source):
        return none
    label = strong_classes(n, source, target)
    inside = label[source] == label[target]
    circling = np.unique(label[source[inside]])
    if not len(circling):
        return none

    def part(member, begin):
        index = np.cumsum(member) - 1
        kept = member[source] & member[target]
        return growth(int(member.sum()), index[source[kept]], index[target[kept]], weight[kept], begin[member])

    rate = {}
    for one in circling.tolist():
        value, _, settled = part(label == one, np.ones(n))
        if not settled:
            return none
        rate[one] = value
    top = max(rate.values())
    leading = [one for one, value in rate.items() if value >= top * (1 - SAME_GROWTH)]
    leads = np.isin(label, leading)
    for node in np.flatnonzero(leads):
        begin = label == label[node]
        ahead = _reachable(n, source, target, begin)
        if (ahead & leads & ~begin).any():
            continue
        _, vector, settled = part(ahead, begin.astype(float))
        if not settled:
            return none
        whole = np.zeros(n)
        whole[ahead] = np.abs(vector)
        return whole
    return none


# --- units -------------------------------------------------------------------------------


class _Units:
    """Arrays of several units laid end to end."""

    def __init__(self, units):
        self.units = units
        self.nodes_at = np.cumsum([0] + [u["n"] for u in units])
        self.n_nodes = int(self.nodes_at[-1])
        self.cells_at = np.cumsum([0] + [u["n"] * len(u["sources"]) for u in units])
        self.n_cells = int(self.cells_at[-1])
        join = lambda name: np.concatenate([u[name] for u in units])
        self.weight, self.cost, self.count_cost = join("w"), join("d"), join("c")
        self.source = np.concatenate([u["a"] + at for u, at in zip(units, self.nodes_at)])
        self.target = np.concatenate([u["b"] + at for u, at in zip(units, self.nodes_at)])
        self.edges_at = np.cumsum([0] + [len(u["w"]) for u in units])
        self.unit_of_node = np.repeat(np.arange(len(units)), np.diff(self.nodes_at))
        self.cell_node = np.concatenate([
            np.tile(np.arange(u["n"]) + at, len(u["sources"])) for u, at in zip(units, self.nodes_at)])
        self.origin_node = np.concatenate([u["sources"] + at for u, at in zip(units, self.nodes_at)])
        self.origin = np.concatenate([
            at + np.arange(len(u["sources"])) * u["n"] + u["sources"] for u, at in zip(units, self.cells_at)])
        self.cell_source = np.repeat(np.arange(len(self.origin)), np.concatenate([
            np.full(len(u["sources"]), u["n"]) for u in units]))

    def entries(self, tails, heads, costs, at):
        """(tail cell, head cell, cost) of edges between global nodes, for every source of their unit."""
        found = []
        for k, u in enumerate(self.units):
            some = slice(at[k], at[k + 1])
            rows = (self.cells_at[k] - self.nodes_at[k] + np.arange(len(u["sources"])) * u["n"])[:, None]
            found.append(((rows + tails[some]).ravel(), (rows + heads[some]).ravel(),
                          np.tile(costs[some], len(u["sources"]))))
        return [np.concatenate(column) for column in zip(*found)]

    def pairs(self):
        """(low, high, weight, count cost, first pair of each unit): of two opposite edges the one from
        the higher node is kept."""
        low, high = np.minimum(self.source, self.target), np.maximum(self.source, self.target)
        order = np.lexsort((self.source, high, low))
        order = order[low[order] != high[order]]
        low, high = low[order], high[order]
        last = np.append((low[1:] != low[:-1]) | (high[1:] != high[:-1]), True)[:len(low)]
        kept = order[last]
        low, high = low[last], high[last]
        return low, high, self.weight[kept], self.count_cost[kept], np.searchsorted(low, self.nodes_at)


def _rank(g: _Units) -> np.ndarray:
    n = np.diff(g.nodes_at)[g.unit_of_node].astype(float)
    out = np.bincount(g.source, g.weight, minlength=g.n_nodes)
    total = np.bincount(g.unit_of_node, out, minlength=len(g.units))
    share = np.divide(g.weight, out[g.source], out=np.zeros(len(g.weight)), where=out[g.source] > 0)
    rank, idle = 1.0 / n, out == 0
    for _ in range(RANK_STEPS):
        got = np.bincount(g.target, rank[g.source] * share, minlength=g.n_nodes)
        lost = np.bincount(g.unit_of_node, rank * idle, minlength=len(g.units))[g.unit_of_node]
        new = DAMPING * (got + lost / n) + (1 - DAMPING) / n
        moved = np.abs(new - rank).max() if len(rank) else 0.0
        rank = new
        if moved <= RANK_CHANGE:
            break
    return np.where(total[g.unit_of_node] > 0, rank, np.nan)


def _triangles(g: _Units, pairs) -> np.ndarray:
    low, high, weight, _, at = pairs
    share = np.full(g.n_nodes, np.nan)
    for k, u in enumerate(g.units):
        some = slice(at[k], at[k + 1])
        a, b, w = low[some] - g.nodes_at[k], high[some] - g.nodes_at[k], weight[some]
        top = w.max() if len(w) else 0.0
        scaled = np.cbrt(w / top) if top > 0 else np.zeros(len(w))
        row = np.full(u["n"], -1)
        row[u["sources"]] = np.arange(len(u["sources"]))
        near = np.zeros((len(u["sources"]), u["n"]))
        mine = row[a] >= 0
        near[row[a[mine]], b[mine]] = scaled[mine]
        mine = row[b] >= 0
        near[row[b[mine]], a[mine]] = scaled[mine]
        closed = 2.0 * ((near[:, a] * near[:, b]) @ scaled)
        degree = (np.bincount(a, minlength=u["n"]) + np.bincount(b, minlength=u["n"]))[u["sources"]].astype(float)
        share[u["sources"] + g.nodes_at[k]] = np.divide(
            closed, degree * (degree - 1), out=np.zeros(len(closed)), where=degree > 1)
    return share


def _solve(units, measures) -> dict[str, np.ndarray]:
    """Columns over all nodes of all units; NaN where another block knows the value."""
    g = _Units(units)
    nothing = np.full(g.n_nodes, np.nan)
    found = {name: nothing for name in (
        "credit", "reach", "far", "eigenvector", "pagerank", "clustering", "component", "path_total")}
    found["n"] = np.diff(g.nodes_at)[g.unit_of_node].astype(float)
    first = np.array([u["block"] == 0 for u in units])[g.unit_of_node]
    if "betweenness" in measures or "closeness" in measures:
        tail, head, cost = g.entries(g.source, g.target, g.cost, g.edges_at)
        starts, tail, head, cost = _by_tail(g.n_cells, tail, head, cost)
        distance = shortest(g.n_cells, g.origin, starts, tail, head, cost)
        if "betweenness" in measures:
            credit = path_credit(g.n_cells, g.origin, distance, tail, head, cost)
            found["credit"] = np.bincount(g.cell_node, credit, minlength=g.n_nodes)
        near = np.isfinite(distance)
        near[g.origin] = False
        found["reach"] = np.bincount(g.cell_node[near], minlength=g.n_nodes).astype(float)
        found["far"] = np.bincount(g.cell_node[near], distance[near], minlength=g.n_nodes)
    pairs = g.pairs() if "clustering" in measures or "paths" in measures else None
    if "paths" in measures:
        low, high, _, cost, at = pairs
        both = [np.concatenate([low[at[k]:at[k + 1]], high[at[k]:at[k + 1]]]) for k in range(len(units))]
        back = [np.concatenate([high[at[k]:at[k + 1]], low[at[k]:at[k + 1]]]) for k in range(len(units))]
        twice = [np.tile(cost[at[k]:at[k + 1]], 2) for k in range(len(units))]
        tail, head, cost = g.entries(*(np.concatenate(x) for x in (both, back, twice)), 2 * at)
        starts, tail, head, cost = _by_tail(g.n_cells, tail, head, cost)
        distance = shortest(g.n_cells, g.origin, starts, tail, head, cost)
        near = np.isfinite(distance)
        total = np.bincount(g.cell_source[near], distance[near], minlength=len(g.origin))
        least = np.full(len(g.origin), g.n_nodes)
        np.minimum.at(least, g.cell_source[near], g.cell_node[near])
        ids = np.concatenate([u["ids"] for u in units])
        found["path_total"], found["component"] = nothing.copy(), np.ma.masked_all(g.n_nodes, np.int64)
        found["path_total"][g.origin_node] = total
        found["component"][g.origin_node] = ids[least]
    if "clustering" in measures:
        found["clustering"] = _triangles(g, pairs)
    if "pagerank" in measures:
        found["pagerank"] = np.where(first, _rank(g), np.nan)
    if "eigenvector" in measures:
        found["eigenvector"] = np.concatenate([
            leading_vector(u["n"], u["a"], u["b"], u["w"]) if u["block"] == 0 else np.full(u["n"], np.nan)
            for u in units])
    return found


# --- streams -----------------------------------------------------------------------------


def _changes(table: pa.Table, columns) -> np.ndarray:
    """Rows that differ from the row before in one of the columns; nulls are equal to each other."""
    differs = np.zeros(max(0, len(table) - 1), bool)
    for name in columns:
        column = table[name].combine_chunks()
        here, before = column.slice(1), column.slice(0, len(column) - 1)
        other = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
        gone = column.is_null().to_numpy(zero_copy_only=False)
        differs |= other | (gone[1:] != gone[:-1])
    return np.flatnonzero(differs) + 1


def _unit(rows: pa.Table, at: int) -> dict:
    column = {name: rows[name].to_numpy() for name in ("_kind", "_a", "_block", "_blocks")}
    n = int(np.count_nonzero(column["_kind"] == 0))
    lanes = rows.slice(n)
    ids, ends = column["_a"][:n], [column["_a"][n:], lanes["_b"].to_numpy()]
    places = [np.searchsorted(ids, end) for end in ends]
    for place, end in zip(places, ends):
        if len(end) and (n == 0 or (ids[np.minimum(place, n - 1)] != end).any()):
            raise ValueError("an edge ends at a player that its network does not list")
    block, blocks = int(column["_block"][0]), int(column["_blocks"][0])
    return {
        "row": at, "n": n, "ids": ids, "a": places[0], "b": places[1].astype(np.int64), "block": block,
        "sources": np.arange(block, n, blocks), **{k: lanes[f"_{k}"].to_numpy() for k in "wdc"}}


def solve_stream(keys, measures, cells: int):
    """A function for mapInArrow over node and edge rows in the order of keys, block, kind and ids."""
    keys = list(keys)
    unit_columns = [*keys, "_block"]

    def solved(tables):
        rows = pa.concat_tables(tables).combine_chunks()
        cuts = [0, *_changes(rows, unit_columns).tolist(), len(rows)]
        units, work = [], 0
        for start, end in zip(cuts[:-1], cuts[1:]):
            unit = _unit(rows.slice(start, end - start), start)
            if not unit["n"]:
                continue
            size = len(unit["sources"]) * (unit["n"] + len(unit["w"]))
            if units and work + size > cells:
                yield emit(rows, units)
                units, work = [], 0
            units.append(unit)
            work += size
        if units:
            yield emit(rows, units)

    def emit(rows, units):
        found = _solve(units, measures)
        owners = np.repeat([u["row"] for u in units], [u["n"] for u in units])
        arrays = rows.select(keys).take(pa.array(owners)).combine_chunks().columns
        arrays = [column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column for column in arrays]
        arrays.append(pa.array(np.concatenate([u["ids"] for u in units]), pa.int64()))
        for name in ("credit", "reach", "far", "n", "eigenvector", "pagerank", "clustering", "component", "path_total"):
            value = found[name]
            if name in ("n", "component"):
                if isinstance(value, np.ma.MaskedArray):
                    gone, value = np.ma.getmaskarray(value), value.filled(0)
                else:
                    gone = np.isnan(value)
                    value = np.where(gone, 0, value).astype(np.int64)
                arrays.append(pa.array(value, pa.int64(), mask=gone))
            else:
                arrays.append(pa.array(value, pa.float64(), mask=np.isnan(value)))
        return pa.RecordBatch.from_arrays(arrays, names=[
            *keys, "player_id", "credit", "reach", "far", "n", "eigenvector", "pagerank", "clustering",
            "component", "path_total"])

    def run(batches):
        ready, ready_rows, open_parts = [], 0, []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            # The last row of the open unit tells whether the batch goes on with it.
            before = [open_parts[-1].slice(len(open_parts[-1]) - 1)] if open_parts else []
            cuts = _changes(pa.concat_tables([*before, table]), unit_columns) - len(before)
            if not len(cuts):
                open_parts.append(table)
                continue
            last = int(cuts[-1])
            ready += [*open_parts, table.slice(0, last)]
            ready_rows += last + sum(map(len, open_parts))
            open_parts = [table.slice(last)]
            if ready_rows > READY_ROWS:
                yield from solved(ready)
                ready, ready_rows = [], 0
        if ready or open_parts:
            yield from solved([*ready, *open_parts])

    return run
