"""How comparable two providers are: volumes, coverage, action mix, distribution shift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pitchloom import schema as S
from pitchloom.functions import expressions as X
from pitchloom.operators.ordering import block_running, dense_position
from pitchloom.runtime import BLOCK_ROWS, durable


def basic_counts(actions: DataFrame) -> DataFrame:
    """Matches, actions, per-match rates and completion per season and provider."""
    games = F.count_distinct("game_id")
    return actions.groupBy("season", "provider").agg(
        games.alias("games"), F.count(F.lit(1)).alias("actions"),
        (F.count(F.lit(1)) / games).alias("actions_per_game"),
        (X.tally(X.is_pass_like()) / games).alias("passes_per_game"),
        X.safe_ratio(X.tally(X.is_completed_pass()), X.tally(X.is_pass_like())).alias("pass_completion"),
        (X.tally(F.col("type_name") == "dribble") / games).alias("dribbles_per_game"),
    )


def recipient_coverage(actions: DataFrame) -> DataFrame:
    """Completed passes and how many of them found a receiver."""
    return actions.where(X.is_completed_pass()).groupBy("season", "provider").agg(
        F.count(F.lit(1)).alias("completed_passes"),
        X.tally(F.col("recipient_confident")).alias("resolved"),
        X.share(F.col("recipient_confident")).alias("resolved_pct"),
    )


def action_mix(actions: DataFrame, left: str, right: str, column: str = "provider") -> DataFrame:
    """Per-match rate of each action type on both sides, their ratio and the verdict."""
    rows = actions.where(F.col(column).isin(left, right))
    games = rows.groupBy(column).agg(F.count_distinct("game_id").alias("_g"))
    counts = rows.groupBy("type_name", column).agg(F.count(F.lit(1)).alias("_c"))
    rates = counts.join(games, column).groupBy("type_name").pivot(column, [left, right]).agg(
        F.max(F.col("_c") / F.col("_g"))
    )
    wide = rates.select(
        "type_name", F.col(left).alias("per_game_left"), F.col(right).alias("per_game_right")
    ).withColumn("rate_ratio", F.col("per_game_left") / F.nullif(F.col("per_game_right"), F.lit(0.0)))
    return wide.withColumn(
        "provider_comparable", F.coalesce(F.round("rate_ratio", 2).between(0.75, 1.33), F.lit(False))
    )


def aggregate_rates(mix: DataFrame) -> DataFrame:
    """Summed rates and their ratio for pass-like and for comparable types."""
    families = {"pass_like": X.is_pass_like(), "comparable": X.is_comparable()}

    def one(name, condition):
        left = F.sum(F.when(condition, F.col("per_game_left")))
        right = F.sum(F.when(condition, F.col("per_game_right")))
        return mix.agg(
            F.lit(name).alias("family"), left.alias("left_rate"), right.alias("right_rate"),
            (left / F.nullif(right, F.lit(0.0))).alias("ratio"),
        )

    return reduce(DataFrame.unionByName, [one(n, c) for n, c in families.items()])


def shift_values(actions: DataFrame, left: str, right: str, column: str = "provider") -> DataFrame:
    """(feature, side, value) of the four modelling features; nulls do not count."""
    both = actions.where(F.col(column).isin(left, right))
    passing = X.is_pass_like()
    return both.select(
        (F.col(column) == left).alias("is_left"),
        F.explode(
            F.array(
                F.struct(F.lit("start_x").alias("feature"), F.col("start_x").alias("value")),
                F.struct(F.lit("start_y").alias("feature"), F.col("start_y").alias("value")),
                F.struct(F.lit("pass_length").alias("feature"), F.when(passing, X.step_length()).alias("value")),
                F.struct(F.lit("pass_dx").alias("feature"), F.when(passing, X.dx()).alias("value")),
            )
        ).alias("_f"),
    ).select("is_left", "_f.*").where(F.col("value").isNotNull())


def ks_statistic(values: DataFrame, digits: int = 9, block: int = BLOCK_ROWS) -> DataFrame:
    """Exact two-sample Kolmogorov-Smirnov distance and both means, per feature.

    Values collapse to (feature, value, counts) first, so a value held by a third of all rows
    is one row. Cumulative counts then run over equal-sized blocks of the distinct values.
    """
    counted = durable(
        values.groupBy("feature", F.round("value", digits).alias("value")).agg(
            F.count_if("is_left").alias("l"), F.count_if(~F.col("is_left")).alias("r")
        )
    )
    sizes = counted.groupBy("feature").agg(
        F.sum("l").alias("_nl"), F.sum("r").alias("_nr"),
        (F.sum(F.col("l") * F.col("value")) / F.nullif(F.sum("l"), F.lit(0))).alias("mean_left"),
        (F.sum(F.col("r") * F.col("value")) / F.nullif(F.sum("r"), F.lit(0))).alias("mean_right"),
    )
    running = block_running(
        dense_position(counted, ["feature"], ["value"]), ["feature"],
        {"_cl": (F.col("l"), "sum"), "_cr": (F.col("r"), "sum")}, block,
    )
    gap = F.abs(
        F.col("_cl") / F.nullif(F.col("_nl"), F.lit(0)) - F.col("_cr") / F.nullif(F.col("_nr"), F.lit(0))
    )
    # Four features: the sizes are four rows.
    return running.join(F.broadcast(sizes), "feature").groupBy("feature").agg(
        F.max(gap).alias("ks_statistic"), F.max("mean_left").alias("mean_left"),
        F.max("mean_right").alias("mean_right"),
    )


def distribution_shift(actions: DataFrame, left: str, right: str, column: str = "provider") -> DataFrame:
    return ks_statistic(shift_values(actions, left, right, column))


def chain_length_stats(chains: DataFrame) -> DataFrame:
    """Count, mean and median chain length per season."""
    return chains.groupBy("season").agg(
        F.count(F.lit(1)).alias("n_chains"), F.avg("n_actions").alias("mean_length"),
        F.expr("percentile(n_actions, 0.5)").alias("median_length"),
    )
