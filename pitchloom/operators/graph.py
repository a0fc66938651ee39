"""Graph measures over many passing networks at once.

Each network is dealt to tasks in blocks of sources: the edges of a network go once to each of its
blocks, and a block's shortest paths, path counts and credits are arrays over (source, node) and
(source, edge), several small networks side by side. A network whose arrays fit one block has one, a
larger one as many as it needs, so a task holds one network's edges and a bounded number of cells.
Blocks emit sums for each node, which are added up; there is no table of pairs of nodes, and the
results do not depend on the block size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitchloom import schema as S
from pitchloom.functions.expressions import safe_ratio
from pitchloom.operators.network_blocks import BLOCK_CELLS, MEASURES, solve_stream
from pitchloom.runtime import staged

SCORES = ("betweenness", "closeness", "eigenvector", "pagerank", "clustering")


def edge_distance(edges: DataFrame, weight_column: str = "weight") -> DataFrame:
    """Volume to cost: 1 / weight, and a very long way for a worthless lane."""
    if weight_column not in edges.columns:
        raise KeyError(f"{weight_column!r} is not a column of the edge table: {edges.columns}")
    volume = F.col(weight_column).cast("double")
    return edges.withColumn(
        "distance", F.when(volume > 0, 1.0 / volume).otherwise(F.lit(S.ZERO_WEIGHT_DISTANCE))
    )


def degree_strength(
    nodes: DataFrame, edges: DataFrame, keys=S.NETWORK_KEYS, weight_column: str = "weight"
) -> DataFrame:
    """Edge counts and weight sums in both directions; isolated nodes get zeros."""
    keys = list(keys)
    # Both directions in one aggregation: each edge is seen from either end.
    ends = edges.select(
        *keys, F.col(weight_column).cast("double").alias("_w"),
        F.explode(
            F.array(
                F.struct(F.col("source").alias("player_id"), F.lit(1).alias("out")),
                F.struct(F.col("target").alias("player_id"), F.lit(0).alias("out")),
            )
        ).alias("_end"),
    ).select(*keys, "_w", "_end.*")
    totals = ends.groupBy(*keys, "player_id").agg(
        F.sum(1 - F.col("out")).alias("degree_in"),
        F.sum("out").alias("degree_out"),
        F.sum(F.when(F.col("out") == 0, F.col("_w")).otherwise(0.0)).alias("strength_in"),
        F.sum(F.when(F.col("out") == 1, F.col("_w")).otherwise(0.0)).alias("strength_out"),
    )
    joined = nodes.select(*keys, "player_id").join(totals, [*keys, "player_id"], "left")
    return joined.fillna(
        0, ["degree_in", "degree_out", "strength_in", "strength_out"]
    ).withColumn("degree_total", F.col("degree_in") + F.col("degree_out"))


# --- measures over source blocks ---------------------------------------------------------


def node_measures(
    nodes: DataFrame, edges: DataFrame, keys=S.NETWORK_KEYS, weight_column: str = "weight",
    measures=MEASURES, cells: int = BLOCK_CELLS,
) -> DataFrame:
    """(keys, player_id, asked measures) for every node; see ``network_blocks`` for each measure.

    ``paths`` asks for ``component``, the smallest id that is reachable ignoring direction, and
    ``path_total``, the sum of undirected distances to all of that component. A block holds about
    ``cells`` (source, node) and (source, edge) entries, or one source of a network with more.
    """
    keys = list(keys)
    nodes = nodes.select(*keys, "player_id")
    priced = edge_distance(edges, weight_column)
    lanes = priced.select(
        *keys, F.lit(1).alias("_kind"), F.col("source").alias("_a"), F.col("target").alias("_b"),
        F.col(weight_column).cast("double").alias("_w"), F.col("distance").alias("_d"),
        F.when(F.col("weight") > 0, 1.0 / F.col("weight").cast("double"))
        .otherwise(F.lit(S.ZERO_WEIGHT_DISTANCE)).alias("_c"),
    )
    points = nodes.select(
        *keys, F.lit(0).alias("_kind"), F.col("player_id").alias("_a"), F.lit(None).cast("long").alias("_b"),
        *(F.lit(None).cast("double").alias(name) for name in ("_w", "_d", "_c")),
    )
    rows = points.unionByName(lanes)
    sizes = rows.groupBy(*keys).agg(
        F.sum(F.when(F.col("_kind") == 0, 1).otherwise(0)).alias("_n"), F.count(F.lit(1)).alias("_all"))
    sources = F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("_all")))
    several = sizes.select(
        *keys, F.ceil(F.col("_n") / sources).cast("int").alias("_blocks")).where("_blocks > 1")
    split = not several.isEmpty()
    if split:
        # Null-safe, as a key of a network may be null.
        rows = rows.alias("r").join(
            several.alias("s"), _same(keys, "r", "s"), "left"
        ).select("r.*", F.coalesce("s._blocks", F.lit(1)).alias("_blocks"))
        rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    else:
        rows = rows.withColumns({"_blocks": F.lit(1), "_block": F.lit(0)})
    # A fixed number of parts: solving is the heavy part, so its stage must not shrink to the few
    # tasks that its small input bytes suggest.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *keys, "_block").sortWithinPartitions(*keys, "_block", "_kind", "_a", "_b")
    key_fields = ", ".join(f"{k} {nodes.schema[k].dataType.simpleString()}" for k in keys)
    columns = "credit double, reach double, far double, n bigint, eigenvector double, pagerank double, "
    columns += "clustering double, component bigint, path_total double"
    solve = solve_stream(keys, tuple(measures), cells)
    found = dealt.mapInArrow(solve, f"{key_fields}, player_id bigint, {columns}")
    if split:
        # Sums over blocks; what a node's own block alone knows is null in the others.
        own = ("n", "eigenvector", "pagerank", "clustering", "component", "path_total")
        found = found.groupBy(*keys, "player_id").agg(
            *(F.sum(name).alias(name) for name in ("credit", "reach", "far")),
            *(F.max(name).alias(name) for name in own))
    n = F.col("n").cast("double")
    scale = F.when(n > 2, 1.0 / ((n - 1) * (n - 2))).otherwise(1.0)
    near = F.col("reach") / F.col("far") * F.col("reach") / F.nullif(n - 1, F.lit(0.0))
    made = {
        "betweenness": F.col("credit") * scale,
        "closeness": F.when(F.col("far") > 0, F.coalesce(near, F.lit(0.0))).otherwise(0.0),
        "eigenvector": F.col("eigenvector"), "pagerank": F.col("pagerank"), "clustering": F.col("clustering"),
    }
    asked = [made[name].alias(name) for name in SCORES if name in measures]
    walks = ["component", "path_total"] if "paths" in measures else []
    return found.select(*keys, "player_id", *asked, *walks)


def _same(keys, left: str, right: str) -> Column:
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return same


# --- joins on the edge table -------------------------------------------------------------


def undirected_edges(edges: DataFrame, keys, weight_column: str = "weight") -> DataFrame:
    """One row per unordered pair; of two opposite lanes the one from the higher id is kept."""
    return edges.groupBy(
        *keys, F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high")
    ).agg(F.max_by(F.col(weight_column).cast("double"), "source").alias("weight"))


def clustering(nodes: DataFrame, edges: DataFrame, keys, weight_column: str = "weight") -> DataFrame:
    """Weighted triangle coefficient.

    Edges point from the lower to the higher (degree, id) end, so a hub starts few wedges.
    """
    keys = list(keys)
    pairs = undirected_edges(edges, keys, weight_column)
    ends = pairs.select(
        *keys, F.explode(F.array("low", "high")).alias("player_id")
    ).groupBy(*keys, "player_id").agg(F.count(F.lit(1)).alias("_deg"))
    top = pairs.groupBy(*keys).agg(F.max("weight").alias("_top"))

    def degree_of(column, name):
        return ends.select(*keys, F.col("player_id").alias(column), F.col("_deg").alias(name))

    sized = (
        pairs.join(degree_of("low", "_dl"), [*keys, "low"])
        .join(degree_of("high", "_dh"), [*keys, "high"])
        .join(top, keys)
        .withColumn("_s", F.cbrt(safe_ratio("weight", "_top")))
    )
    rising = F.struct("_dl", "low") < F.struct("_dh", "high")
    pointed = sized.select(
        *keys,
        F.when(rising, F.col("low")).otherwise(F.col("high")).alias("a"),
        F.when(rising, F.col("high")).otherwise(F.col("low")).alias("b"),
        "_s",
    )
    triangles = (
        pointed.select(*keys, "a", "b", F.col("_s").alias("_ab"))
        .join(pointed.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"), F.col("_s").alias("_bc")), [*keys, "b"])
        .join(pointed.select(*keys, "a", F.col("b").alias("c"), F.col("_s").alias("_ac")), [*keys, "a", "c"])
        .select(
            *keys, F.explode(F.array("a", "b", "c")).alias("player_id"),
            (F.col("_ab") * F.col("_bc") * F.col("_ac")).alias("_t"),
        )
        .groupBy(*keys, "player_id").agg(F.sum("_t").alias("_t"))
    )
    return (
        nodes.select(*keys, "player_id")
        .join(ends, [*keys, "player_id"], "left").join(triangles, [*keys, "player_id"], "left")
        .select(
            *keys, "player_id",
            safe_ratio(2 * F.coalesce("_t", F.lit(0.0)), F.col("_deg") * (F.col("_deg") - 1)).alias("clustering"),
        )
    )


def components(nodes: DataFrame, edges: DataFrame, keys=S.NETWORK_KEYS) -> DataFrame:
    """(keys, player_id, component): the smallest id reachable ignoring direction.

    Alternating star contraction: every node points its larger neighbours, then its smaller ones, at
    the smallest of them, until nothing changes. Rounds grow with the logarithm of the longest
    path, edges never grow in number, and each round is written out.
    """
    keys = list(keys)
    low, high = F.least("source", "target"), F.greatest("source", "target")
    links = staged(
        edges.select(*keys, high.alias("u"), low.alias("v")).where("u > v").distinct())
    mark = _fingerprint(links)
    while True:
        ways = links.unionByName(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        outer = ways.where("v > u").join(least, [*keys, "u"]).select(
            *keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = outer.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        inner = outer.join(least, [*keys, "u"]).select(*keys, F.inline(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        links = staged(inner.where("u > v").distinct())
        before, mark = mark, _fingerprint(links)
        if mark == before:
            break
    roots = links.select(*keys, F.col("u").alias("player_id"), F.col("v").alias("component"))
    return nodes.select(*keys, "player_id").join(roots, [*keys, "player_id"], "left").withColumn(
        "component", F.coalesce("component", "player_id"))


def _fingerprint(links: DataFrame) -> tuple:
    """Row count and an order-free sum of row hashes: one row, whatever the table's size."""
    return tuple(links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64(*links.columns).cast("decimal(20,0)"))).first())


def _path_lengths(measured: DataFrame, keys) -> DataFrame:
    """(keys, avg_path) of networks with an edge: mean distance in the largest component, on a tie in
    the one with the smallest id."""
    sizes = measured.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("_size"), F.sum("path_total").alias("_total"))
    largest = sizes.groupBy(*keys).agg(
        F.max(F.struct("_size", (-F.col("component")).alias("_c"), "_total")).alias("_m"))
    size = F.col("_m._size")
    return largest.where(size > 1).select(*keys, (F.col("_m._total") / (size * (size - 1))).alias("avg_path"))


def average_path_length(nodes: DataFrame, edges: DataFrame, keys=S.NETWORK_KEYS, cells: int = BLOCK_CELLS) -> DataFrame:
    """Mean undirected distance, on pass counts, inside the largest component of each network."""
    return _path_lengths(node_measures(nodes, edges, keys, "weight", ("paths",), cells), list(keys))


# --- tables ------------------------------------------------------------------------------


def density(sizes: DataFrame) -> Column:
    return F.col("n_edges") / F.nullif(
        (F.col("n_nodes") * (F.col("n_nodes") - 1)).cast("double"), F.lit(0.0)
    )


def structure(nodes: DataFrame, edges: DataFrame, keys=S.NETWORK_KEYS) -> DataFrame:
    """Counts, density and degree centralisation per network; undefined cases are null."""
    keys = list(keys)
    degrees = degree_strength(nodes, edges, keys)
    stats = degrees.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("degree_out").alias("n_edges"),
        F.max("degree_total").alias("_top"), F.sum("degree_total").alias("_sum"),
        F.sum("strength_out").alias("team_total_passes"),
    )
    room = (F.col("n_nodes") - 1) * (F.col("n_nodes") - 2)
    return stats.select(
        *keys,
        density(stats).alias("team_density"),
        F.when(
            F.col("n_nodes") > 2, (F.col("n_nodes") * F.col("_top") - F.col("_sum")) / room
        ).alias("team_centralization"),
        F.col("n_nodes").alias("team_n_nodes"), F.col("n_edges").alias("team_n_edges"),
        "team_total_passes",
    )


def network_scores(
    nodes: DataFrame, edges: DataFrame, keys=S.NETWORK_KEYS, weight_column: str = "weight",
    measures=SCORES, cells: int = BLOCK_CELLS,
) -> DataFrame:
    """Path, spectral and triangle measures of every player; only those asked for are worked out."""
    return node_measures(nodes, edges, keys, weight_column, measures, cells)


def centrality_table(
    nodes: DataFrame, edges: DataFrame, keys=S.NETWORK_KEYS, weight_column: str = "weight",
    cells: int = BLOCK_CELLS,
):
    """(player table, team table). The team table always describes pass counts."""
    keys = list(keys)
    players = degree_strength(nodes, edges, keys, weight_column).join(
        network_scores(nodes, edges, keys, weight_column, SCORES, cells), [*keys, "player_id"]
    )
    return players, team_table(nodes, edges, keys, cells)


def team_table(
    nodes: DataFrame, edges: DataFrame, keys=S.NETWORK_KEYS, cells: int = BLOCK_CELLS
) -> DataFrame:
    """Structure and mean path length of every network, on pass counts."""
    keys = list(keys)
    paths = average_path_length(nodes, edges, keys, cells)
    return structure(nodes, edges, keys).join(paths, keys, "left").withColumnRenamed(
        "avg_path", "team_avg_path_length")


def both_weightings(
    nodes: DataFrame, edges: DataFrame, keys=S.NETWORK_KEYS, cells: int = BLOCK_CELLS
) -> DataFrame:
    """Pass-count metrics beside the weight-sensitive metrics on threat-weighted lanes."""
    keys = list(keys)
    plain = degree_strength(nodes, edges, keys).join(
        network_scores(nodes, edges, keys, "weight", SCORES, cells), [*keys, "player_id"])
    threat = degree_strength(nodes, edges, keys, "xt_weight").join(
        network_scores(nodes, edges, keys, "xt_weight", SCORES, cells), [*keys, "player_id"])
    renamed = threat.select(
        *keys, "player_id", *[F.col(m).alias(f"{m}_xt") for m in S.WEIGHT_SENSITIVE_METRICS]
    )
    return plain.join(renamed, [*keys, "player_id"], "left")
