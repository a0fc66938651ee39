"""Composite reports: review sheets, chain actions, fixture labels, corpus summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitchloom.functions.hashing import mix
from pitchloom.operators.identity import club_labels
from pitchloom.sources.store import stratified_sample


def fixture_labels(games: DataFrame, teams: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(game_id, fixture): matchweek, both clubs, date and score."""
    out = games
    for side in ("home", "away"):
        named = club_labels(
            out.withColumn("team_id", F.col(f"{side}_team_id")), teams, aliases
        )
        out = named.withColumnRenamed("club", f"{side}_club").drop("team_id")
    score = F.coalesce(
        F.concat_ws("-", F.col("home_score").cast("string"), F.col("away_score").cast("string")),
        F.lit(""),
    )
    label = F.format_string(
        "MW%d %s v %s (%s) %s", F.col("game_day").cast("int"), "home_club", "away_club",
        F.date_format("game_date", "yyyy-MM-dd"), score,
    )
    return out.select("game_id", F.trim(label).alias("fixture"))


def review_sheet(
    labelled: DataFrame, profiles: DataFrame, fixtures: DataFrame, teams: DataFrame,
    per_cluster: int = 6, seed: int = 0,
) -> DataFrame:
    """A few test-fold chains of each cluster for a human verdict; all folds if no test rows."""
    test = labelled.where(F.col("fold") == "test")
    pool = labelled if test.isEmpty() else test
    picked = stratified_sample(pool, ["cluster"], ["game_id", "possession_id"], per_cluster, seed)
    sheet = (
        picked.join(profiles.select("cluster", "label", "shot_rate"), "cluster")
        .join(fixtures, "game_id", "left")
    )
    return club_labels(sheet, teams).select(
        "cluster", "label", "shot_rate", "game_id", "possession_id", "fixture", "club",
        "start_minute", "n_actions", "ends_in_shot",
        F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("comment"),
    ).orderBy("cluster", "start_minute", "game_id", "possession_id")


def chain_actions(actions: DataFrame, chains: DataFrame) -> DataFrame:
    """Ordered actions of the listed chains, by the chain's own team only."""
    keys = ["game_id", "possession_id", "team_id"]
    return actions.join(chains.select(*keys).distinct(), keys, "left_semi").orderBy(
        "game_id", "possession_id", "period_id", "time_seconds", "action_id"
    )


def browse_cluster(
    labelled: DataFrame, cluster: int, only_shots: bool = False, n: int = 6, seed: int = 0
) -> DataFrame:
    """A seeded handful of chains of one cluster."""
    rows = labelled.where(F.col("cluster") == cluster)
    if only_shots:
        rows = rows.where("ends_in_shot")
    return rows.orderBy(mix("game_id", "possession_id", seed=seed), "game_id", "possession_id").limit(n)


def corpus_summary(games: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Matches, node rows and edge rows per season."""
    def count(df, name):
        return df.groupBy("season").agg(F.count(F.lit(1)).alias(name))

    return (
        count(games, "games").join(count(nodes, "nodes"), "season", "full_outer")
        .join(count(edges, "edges"), "season", "full_outer")
        .fillna(0, ["games", "nodes", "edges"])
    )


def club_lookup(nodes: DataFrame, teams: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Every (provider, season, team) with its display name, sorted."""
    rows = nodes.select("provider", "season", "team_id").distinct()
    return club_labels(rows, teams, aliases).orderBy("provider", "season", "club", "team_id")
