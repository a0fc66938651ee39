"""Passing networks as flat node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitchloom import schema as S
from pitchloom.functions import expressions as X


def lane_passes(actions: DataFrame) -> DataFrame:
    """Passes that draw an edge: completed, confidently received, both ends known."""
    return actions.where(
        X.is_completed_pass()
        & F.coalesce(F.col("recipient_confident"), F.lit(False))
        & F.col("recipient_id").isNotNull()
        & F.col("player_id").isNotNull()
    )


def node_table(actions: DataFrame, keys=S.NETWORK_KEYS) -> DataFrame:
    """Mean place, spread and volumes per player of a network."""
    return (
        actions.where(F.col("player_id").isNotNull())
        .groupBy(*keys, "player_id")
        .agg(
            F.avg("start_x").alias("mean_x"),
            F.avg("start_y").alias("mean_y"),
            F.coalesce(F.stddev_samp("start_x"), F.lit(0.0)).alias("spread_x"),
            F.coalesce(F.stddev_samp("start_y"), F.lit(0.0)).alias("spread_y"),
            X.tally(X.is_comparable()).alias("touches"),
            F.count("action_id").alias("actions_all_types"),
            X.tally(X.is_pass_like()).alias("passes_attempted"),
            X.tally(X.is_completed_pass()).alias("passes_completed"),
        )
    )


def edge_table(actions: DataFrame, keys=S.NETWORK_KEYS) -> DataFrame:
    """Directed lanes with pass count, mean length and mean forward gain; no self-passes."""
    return (
        lane_passes(actions)
        .groupBy(*keys, F.col("player_id").alias("source"), F.col("recipient_id").alias("target"))
        .agg(
            F.count("action_id").alias("weight"),
            F.avg(X.step_length()).alias("mean_length"),
            F.avg(X.dx()).alias("mean_dx"),
        )
        .where(F.col("source") != F.col("target"))
    )


def eligible_players(
    actions: DataFrame, keys=S.NETWORK_KEYS, min_minutes: float = S.MIN_MINUTES
) -> DataFrame:
    """Players whose first and last action in the network are far enough apart."""
    minute = X.action_minute()
    return (
        actions.where(F.col("player_id").isNotNull())
        .groupBy(*keys, "player_id")
        .agg((F.max(minute) - F.min(minute)).alias("_span"))
        .where(F.col("_span") >= min_minutes)
        .drop("_span")
    )


def match_networks(actions: DataFrame, min_minutes: float = S.MIN_MINUTES):
    """(nodes, edges) of every team and match; an edge needs both ends among the nodes."""
    keys = list(S.NETWORK_KEYS)
    nodes, edges = node_table(actions, keys), edge_table(actions, keys)
    if min_minutes <= 0:
        return nodes, edges
    eligible = eligible_players(actions, keys, min_minutes)
    nodes = nodes.join(eligible, [*keys, "player_id"], "left_semi")
    for end in ("source", "target"):
        edges = edges.join(
            eligible.withColumnRenamed("player_id", end), [*keys, end], "left_semi"
        )
    return nodes, edges


def assign_windows(actions: DataFrame) -> DataFrame:
    """Copy each action into its (at most three) sliding windows. Arithmetic, no range join."""
    minute = X.action_minute()
    inside = actions.where((minute >= 0) & (minute < S.MATCH_MINUTES))
    return inside.withColumn(
        "window_index",
        F.explode(
            F.sequence(X.first_window(minute).cast("long"), X.last_window(minute).cast("long"))
        ),
    )


def windowed_networks(actions: DataFrame):
    """(nodes, edges) per 15-minute window every 5 minutes, without the minutes filter."""
    placed = assign_windows(actions)
    return node_table(placed, S.WINDOW_KEYS), edge_table(placed, S.WINDOW_KEYS)


def window_bounds(spark) -> DataFrame:
    return spark.range(S.WINDOW_COUNT).select(
        F.col("id").alias("window_index"),
        (F.col("id") * S.STRIDE_MINUTES).alias("low"),
        (F.col("id") * S.STRIDE_MINUTES + S.WINDOW_MINUTES).alias("high"),
    )


def season_network(nodes: DataFrame, edges: DataFrame):
    """One network per club and season: means of means, sums of counts."""
    keys = ["season", "provider", "team_id"]
    season_nodes = nodes.groupBy(*keys, "player_id").agg(
        *[F.avg(c).alias(c) for c in ("mean_x", "mean_y", "spread_x", "spread_y")],
        *[
            F.sum(c).alias(c)
            for c in ("touches", "actions_all_types", "passes_attempted", "passes_completed")
        ],
    )
    season_edges = edges.groupBy(*keys, "source", "target").agg(
        F.sum("weight").alias("weight"),
        F.avg("mean_length").alias("mean_length"),
        F.avg("mean_dx").alias("mean_dx"),
    )
    return season_nodes, season_edges


def network_sizes(nodes: DataFrame, edges: DataFrame, keys=S.NETWORK_KEYS) -> DataFrame:
    """Node and edge count of every network that has nodes."""
    keys = list(keys)
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(m, keys, "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def network_size_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Networks, rows and mean sizes per season."""
    return (
        network_sizes(nodes, edges)
        .groupBy("season")
        .agg(
            F.count(F.lit(1)).alias("networks"),
            F.sum("n_nodes").alias("node_rows"),
            F.sum("n_edges").alias("edge_rows"),
            F.avg("n_nodes").alias("mean_nodes"),
            F.avg("n_edges").alias("mean_edges"),
        )
    )
