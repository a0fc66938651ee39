"""Node features of passing networks, neighbour means and per-match window sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitchloom import schema as S
from pitchloom.functions import expressions as X


class FeatureError(ValueError):
    """Keys are missing or null, or a joined table has more than one row per player."""


def _check_keys(nodes: DataFrame, edges: DataFrame, keys) -> None:
    missing = [k for k in keys if k not in nodes.columns or k not in edges.columns]
    if missing:
        raise FeatureError(f"keys {missing} are not in both the node and the edge table")


def require_filled_keys(nodes: DataFrame, keys) -> None:
    """Stop when a key is null: full-match tables carry an empty window column."""
    hole = F.lit(False)
    for key in keys:
        hole = hole | F.col(key).isNull()
    if not nodes.where(hole).isEmpty():
        raise FeatureError(f"keys {list(keys)} contain nulls")


def node_features(
    nodes: DataFrame, edges: DataFrame, keys=S.NETWORK_KEYS, node_threat: DataFrame | None = None,
    check: bool = True,
) -> DataFrame:
    """Volume shares, pass direction and, where the inputs allow, threat shares.

    ``keys`` decide the network: pass the window keys for windowed tables, or a window would
    see the whole match.
    """
    keys = list(keys)
    _check_keys(nodes, edges, keys)
    if check:
        require_filled_keys(nodes, keys)
    with_threat = "xt_weight" in edges.columns
    w = F.col("weight").cast("double")
    progressive = F.when(F.col("mean_dx") > S.PROGRESSIVE_DX, w).otherwise(0.0)

    def end(column, tag, extra):
        return edges.groupBy(*keys, F.col(column).alias("player_id")).agg(
            F.sum(w).alias(f"strength_{tag}"), F.count(F.lit(1)).alias(f"degree_{tag}"),
            F.sum(w * F.col("mean_dx")).alias(f"_dx_{tag}"), *extra,
        )

    made_extra = [
        F.sum(w * F.col("mean_length")).alias("_length"), F.sum(progressive).alias("_progressive"),
    ]
    threat_out = [F.sum("xt_weight").alias("xt_strength_out")] if with_threat else []
    threat_in = [F.sum("xt_weight").alias("xt_strength_in")] if with_threat else []
    frame = nodes.join(end("source", "out", made_extra + threat_out), [*keys, "player_id"], "left")
    frame = frame.join(end("target", "in", threat_in), [*keys, "player_id"], "left")
    volumes = ["strength_out", "degree_out", "strength_in", "degree_in"]
    if with_threat:
        volumes += ["xt_strength_out", "xt_strength_in"]
    frame = frame.fillna(0, volumes)
    totals = frame.groupBy(*keys).agg(
        *[F.sum(c).alias(f"_team_{c}") for c in [*volumes, "touches"]],
        F.count(F.lit(1)).alias("_team_nodes"),
    )
    frame = frame.join(totals, keys)
    mates = F.greatest(F.col("_team_nodes") - 1, F.lit(1))
    columns = {
        "degree_out_norm": X.safe_ratio("degree_out", mates),
        "degree_in_norm": X.safe_ratio("degree_in", mates),
        "strength_out_norm": X.safe_ratio("strength_out", "_team_strength_out"),
        "strength_in_norm": X.safe_ratio("strength_in", "_team_strength_in"),
        "edge_share_out": X.safe_ratio("degree_out", "_team_degree_out"),
        "edge_share_in": X.safe_ratio("degree_in", "_team_degree_in"),
        "pass_completion_rate": X.safe_ratio("passes_completed", "passes_attempted"),
        "touches": X.safe_ratio("touches", "_team_touches"),
        "progression_made": X.safe_ratio("_dx_out", "strength_out"),
        "progression_received": X.safe_ratio("_dx_in", "strength_in"),
        "pass_length_made": X.safe_ratio("_length", "strength_out"),
        "progressive_share": X.safe_ratio("_progressive", "strength_out"),
    }
    if with_threat:
        columns["xt_strength_out_norm"] = X.safe_ratio("xt_strength_out", "_team_xt_strength_out")
        columns["xt_strength_in_norm"] = X.safe_ratio("xt_strength_in", "_team_xt_strength_in")
    frame = frame.withColumns(columns)
    frame = frame.drop(*[c for c in frame.columns if c.startswith("_")])
    if node_threat is None:
        return frame
    return attach_node_threat(frame, node_threat, keys, check)


def attach_node_threat(
    frame: DataFrame, node_threat: DataFrame, keys=S.NETWORK_KEYS, check: bool = True
) -> DataFrame:
    """Join per-player threat; absent players are zero, duplicate keys are refused."""
    on = [*keys, "player_id"]
    absent = [k for k in on if k not in node_threat.columns]
    if absent:
        raise FeatureError(f"node threat table has no {absent}")
    wanted = [
        c for c in ("xt_generated", "shot_involvement", "shot_conversion")
        if c in node_threat.columns
    ]
    table = node_threat.select(*on, *wanted)
    if check and not table.groupBy(*on).count().where("count > 1").isEmpty():
        raise FeatureError("node threat table has several rows for one player of a network")
    return frame.join(table, on, "left").fillna(0.0, wanted)


def window_features(nodes: DataFrame, edges: DataFrame, check: bool = True) -> DataFrame:
    """The same features inside each window only."""
    return node_features(nodes, edges, S.WINDOW_KEYS, check=check)


def role_features(features: DataFrame, directory: DataFrame) -> DataFrame:
    """Labelled players only, with coarse role, role index and fine position."""
    labels = directory.where(F.col("coarse_role").isNotNull()).select(
        "season", "provider", "player_id", "coarse_role", "fine_position",
        X.index_in("coarse_role", S.COARSE_ROLES).alias("role_index"),
    )
    return features.join(labels, ["season", "provider", "player_id"])


def neighbour_means(
    features: DataFrame, edges: DataFrame, names, keys=S.NETWORK_KEYS, hops: int = 2
) -> DataFrame:
    """Mean of the passers' features, one or more hops back, beside a player's own."""
    keys, names = list(keys), list(names)
    on = [*keys, "player_id"]
    out = features.select(*on, *names)
    current = {n: n for n in names}
    for hop in range(1, hops + 1):
        sent = out.select(
            *keys, F.col("player_id").alias("source"), *[F.col(c).alias(f"_{n}") for n, c in current.items()]
        )
        heard = (
            edges.select(*keys, "source", F.col("target").alias("player_id"))
            .join(sent, [*keys, "source"])
            .groupBy(*on)
            .agg(*[F.avg(f"_{n}").alias(f"{n}_hop{hop}") for n in names])
        )
        fresh = [f"{n}_hop{hop}" for n in names]
        out = out.join(heard, on, "left").fillna(0.0, fresh)
        current = dict(zip(names, fresh))
    return out


def pooled_networks(features: DataFrame, names, keys=S.WINDOW_KEYS) -> DataFrame:
    """Mean node vector of each network."""
    return features.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])


def match_sequences(state: DataFrame, pooled: DataFrame, outcomes: DataFrame, names) -> DataFrame:
    """Per match, 16 ordered steps: home vector, away vector, state vector.

    A window without a network contributes a zero vector. A match has 16 rows at most.
    """
    names = list(names)
    vector = F.array(*[F.col(n).cast("double") for n in names])
    zero = F.array_repeat(F.lit(0.0), len(names))
    side = pooled.select("game_id", "team_id", "window_index", vector.alias("_v"))
    grid = state.join(
        outcomes.select("game_id", "home_team_id", "away_team_id"), "game_id"
    )
    for name in ("home", "away"):
        grid = grid.join(
            side.select(
                "game_id", F.col("team_id").alias(f"{name}_team_id"), "window_index",
                F.col("_v").alias(f"_{name}"),
            ),
            ["game_id", f"{name}_team_id", "window_index"], "left",
        ).withColumn(f"_{name}", F.coalesce(f"_{name}", zero))
    step = F.struct(
        "window_index", F.col("_home").alias("home"), F.col("_away").alias("away"),
        F.array(*[F.col(c).cast("double") for c in S.B1_FEATURES]).alias("state"),
    )
    return grid.groupBy("game_id", "outcome_index").agg(
        F.sort_array(F.collect_list(step)).alias("steps")
    )
