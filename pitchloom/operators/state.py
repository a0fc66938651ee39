"""Leakage-safe match state at fixed checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pitchloom import schema as S
from pitchloom.functions import expressions as X
from pitchloom.operators.ordering import prefix_totals
from pitchloom.operators.sequence import derive_goals


def checkpoints(spark) -> DataFrame:
    """The closing minute of each sliding window."""
    return spark.range(S.WINDOW_COUNT).select(
        F.col("id").alias("window_index"),
        (F.col("id") * S.STRIDE_MINUTES + S.WINDOW_MINUTES).alias("checkpoint_minute"),
    )


def match_outcomes(games: DataFrame) -> DataFrame:
    """Scored matches with the three-way label seen from the home side."""
    return (
        games.where(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
        .withColumn("outcome", X.match_outcome())
        .withColumn("outcome_index", X.index_in("outcome", S.OUTCOMES))
        .select(
            "game_id", "season", "provider", "game_day", "home_team_id", "away_team_id",
            "home_score", "away_score", "outcome", "outcome_index",
        )
    )


def outcome_balance(outcomes: DataFrame) -> DataFrame:
    """Class shares per season."""
    per = outcomes.groupBy("season").pivot("outcome", list(S.OUTCOMES)).agg(F.count(F.lit(1)))
    n = sum(F.coalesce(F.col(c), F.lit(0)) for c in S.OUTCOMES)
    return per.select(
        "season", n.alias("matches"),
        *[X.safe_ratio(F.coalesce(F.col(c), F.lit(0)), n).alias(f"share_{c}") for c in S.OUTCOMES],
    )


_SUMS = ("shots", "passes", "passes_ok", "comparable_actions", "actions", "sum_x", "xt")


def _every_window():
    return F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(S.WINDOW_COUNT - 1).cast("long"))
    ).alias("window_index")


def _upto(window_keys):
    return (
        Window.partitionBy(*window_keys).orderBy("window_index")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def cumulative_stats(actions: DataFrame) -> DataFrame:
    """Team totals over everything at or before each checkpoint.

    Actions are summed once per (match, team, first checkpoint), then accumulated over the
    16-row grid. No inequality join, and a hot match shrinks before the window.
    """
    keys = ["game_id", "team_id"]
    threat = F.coalesce(F.col("xt_value"), F.lit(0.0)) if "xt_value" in actions.columns else F.lit(0.0)
    minute = X.action_minute()
    per = (
        actions.where((minute <= S.MATCH_MINUTES) & F.col("team_id").isNotNull())
        .withColumn("window_index", X.first_checkpoint(minute).cast("long"))
        .groupBy(*keys, "window_index")
        .agg(
            X.tally(X.is_shot()).alias("shots"), X.tally(X.is_pass_like()).alias("passes"),
            X.tally(X.is_completed_pass()).alias("passes_ok"),
            X.tally(X.is_comparable()).alias("comparable_actions"),
            F.count("start_x").alias("actions"), F.sum("start_x").alias("sum_x"),
            F.sum(threat).alias("xt"),
        )
    )
    grid = per.select(*keys).distinct().select(*keys, _every_window())
    full = grid.join(per, [*keys, "window_index"], "left").fillna(0, list(_SUMS))
    running = full.select(
        *keys, "window_index", *[F.sum(c).over(_upto(keys)).alias(c) for c in _SUMS]
    ).where(F.col("actions") > 0)
    return running.select(
        *keys, "window_index", "shots", "passes", "comparable_actions", "xt",
        X.safe_ratio("passes_ok", "passes").alias("pass_completion"),
        (F.col("sum_x") / F.nullif(F.col("actions"), F.lit(0))).alias("mean_x"),
    )


def running_goals(actions: DataFrame) -> DataFrame:
    """Goals per scoring team and the first checkpoint that sees them."""
    return (
        derive_goals(actions)
        .where(F.col("minute") <= S.MATCH_MINUTES)
        .groupBy(
            "game_id", F.col("scoring_team_id").alias("team_id"),
            X.first_checkpoint("minute").cast("long").alias("window_index"),
        )
        .agg(F.count(F.lit(1)).alias("goals"))
    )


def closing_window_network(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Density and out-degree centralisation of the window that has just closed."""
    keys = ["game_id", "team_id", "window_index"]
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = (
        edges.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("_d"))
        .groupBy(*keys)
        .agg(F.sum("_d").alias("_m"), F.max("_d").alias("_top"), F.avg("_d").alias("_mean"))
    )
    return n.join(out, keys, "full_outer").select(
        *keys,
        X.safe_ratio(F.coalesce("_m", F.lit(0)), F.col("_n") * (F.col("_n") - 1)).alias("network_density"),
        X.safe_ratio(F.col("_top") - F.col("_mean"), "_top").alias("network_centralization"),
    )


def rolling_form(outcomes: DataFrame) -> DataFrame:
    """Points and goal difference per game over strictly earlier matchdays of the season.

    Results collapse to one row per team and matchday first, so even a team that holds most
    of the table is reduced to its number of matchdays before the running sum.
    """
    long = outcomes.select(
        "game_id", "season", "provider", "game_day",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.col(f"{side}_team_id").alias("team_id"), F.lit(side == "home").alias("is_home"),
                        (F.col(f"{side}_score") - F.col(f"{other}_score")).alias("goal_difference"),
                    )
                    for side, other in (("home", "away"), ("away", "home"))
                ]
            )
        ).alias("_side"),
    ).select("game_id", "season", "provider", "game_day", "_side.*")
    long = long.withColumns(
        {
            "points": F.when(F.col("goal_difference") > 0, 3).when(F.col("goal_difference") == 0, 1).otherwise(0),
            "_one": F.lit(1),
        }
    )
    keys = ["season", "provider", "team_id"]
    before = prefix_totals(
        long, keys, "game_day", {"_p": "points", "_g": "goal_difference", "_n": "_one"}
    )
    joined = long.join(before, [*keys, "game_day"])
    played = F.col("_n") > 0
    return joined.select(
        "game_id", "season", "provider", "team_id", "is_home",
        F.when(played, F.col("_p") / F.nullif(F.col("_n"), F.lit(0))).otherwise(1.0).alias("form_ppg"),
        F.when(played, F.col("_g") / F.nullif(F.col("_n"), F.lit(0))).otherwise(0.0).alias("form_gd"),
    )


def state_table(
    actions: DataFrame, outcomes: DataFrame, window_nodes: DataFrame | None = None,
    window_edges: DataFrame | None = None,
) -> DataFrame:
    """One row per scored match and checkpoint: score, ladder features, label.

    The per-team measures meet in one long table keyed (match, team, checkpoint), which is
    folded to home and away columns by a single aggregation instead of one join per side.
    """
    spark = actions.sparkSession
    grid = outcomes.select("game_id", "home_team_id", "away_team_id", _every_window())
    sides = grid.select(
        "game_id", "window_index",
        F.explode(
            F.array(
                F.struct(F.col("home_team_id").alias("team_id"), F.lit("home").alias("side")),
                F.struct(F.col("away_team_id").alias("team_id"), F.lit("away").alias("side")),
            )
        ).alias("_s"),
    ).select("game_id", "window_index", "_s.*")
    on = ["game_id", "team_id", "window_index"]
    table = sides.join(cumulative_stats(actions), on, "left").join(running_goals(actions), on, "left")
    if window_nodes is not None and window_edges is not None:
        table = table.join(closing_window_network(window_nodes, window_edges), on, "left")
    else:
        table = table.withColumns(
            {"network_density": F.lit(0.0), "network_centralization": F.lit(0.0)}
        )
    table = table.withColumn(
        "goals",
        F.sum(F.coalesce("goals", F.lit(0))).over(_upto(["game_id", "team_id", "side"])),
    )
    defaults = {
        "goals": 0.0, "shots": 0.0, "passes": 0.0, "pass_completion": 0.0,
        "comparable_actions": 0.0, "xt": 0.0, "mean_x": 52.5, "network_density": 0.0,
        "network_centralization": 0.0,
    }
    folded = table.groupBy("game_id", "window_index").agg(
        *[
            F.coalesce(
                F.max(F.when(F.col("side") == side, F.col(name))).cast("double"), F.lit(value)
            ).alias(f"{name}_{side}")
            for side in ("home", "away")
            for name, value in defaults.items()
        ]
    )
    form = rolling_form(outcomes).groupBy("game_id").agg(
        *[
            F.max(F.when(F.col("is_home") == (side == "home"), F.col(c))).alias(f"{c}_{side}")
            for side in ("home", "away") for c in ("form_ppg", "form_gd")
        ]
    )
    labels = outcomes.select("game_id", "season", "provider", "outcome_index")
    joined = (
        folded.join(labels, "game_id").join(form, "game_id", "left")
        .join(F.broadcast(checkpoints(spark)), "window_index")  # 16 rows
    )
    both = F.col("comparable_actions_home") + F.col("comparable_actions_away")
    joined = joined.withColumns(
        {
            "goal_diff": F.col("goals_home") - F.col("goals_away"),
            "minutes_remaining": S.MATCH_MINUTES - F.col("checkpoint_minute"),
            "possession_share_home": F.when(both > 0, F.col("comparable_actions_home") / F.nullif(both, F.lit(0.0))).otherwise(0.5),
            "xt_diff": F.col("xt_home") - F.col("xt_away"),
            "form_ppg_home": F.coalesce("form_ppg_home", F.lit(1.0)),
            "form_ppg_away": F.coalesce("form_ppg_away", F.lit(1.0)),
            "form_gd_home": F.coalesce("form_gd_home", F.lit(0.0)),
            "form_gd_away": F.coalesce("form_gd_away", F.lit(0.0)),
        }
    ).withColumn(
        "goal_diff_x_minutes_remaining", F.col("goal_diff") * F.col("minutes_remaining")
    )
    return joined.select(
        "game_id", "season", "provider", "window_index", "checkpoint_minute", "outcome_index",
        "goals_home", "goals_away", *S.B2_FEATURES,
    )


def match_timeline(predictions: DataFrame, game_id: int) -> DataFrame:
    """One match's predicted probabilities by checkpoint, one row per outcome."""
    return (
        predictions.where(F.col("game_id") == game_id)
        .select(
            "game_id", "checkpoint_minute",
            F.posexplode("probabilities").alias("outcome_index", "probability"),
        )
        .withColumn(
            "outcome", F.element_at(F.array(*[F.lit(o) for o in S.OUTCOMES]), F.col("outcome_index") + 1)
        )
        .select("game_id", "checkpoint_minute", "outcome", "probability")
        .orderBy("checkpoint_minute", "outcome")
    )
