"""Expected threat: value of pitch cells fitted on training matches, and what it rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, functions as F

from pitchloom import schema as S
from pitchloom.functions import expressions as X
from pitchloom.operators.network import lane_passes
from pitchloom.runtime import durable, staged


class ThreatError(ValueError):
    """The fold is empty, or an edge table does not line up with its actions."""


def _axis(column: str, size: float, cells: int) -> Column:
    # Without the guard least and greatest would skip a null and give the last cell.
    known = F.col(column).isNotNull() & ~F.isnan(column)
    return F.when(known, F.greatest(
        F.lit(0), F.least(F.lit(cells - 1), F.floor(F.col(column) / F.lit(size) * F.lit(cells)))
    ).cast("long"))


def cell_of(x: str, y: str, length: int = S.GRID_LENGTH, width: int = S.GRID_WIDTH) -> Column:
    return _axis(x, S.PITCH_LENGTH, length) + length * _axis(y, S.PITCH_WIDTH, width)


def is_move() -> Column:
    return F.col("type_name").isin(*S.THREAT_MOVE_TYPES)


def fit_surface(
    train: DataFrame, length: int = S.GRID_LENGTH, width: int = S.GRID_WIDTH,
    tolerance: float = 1e-5, max_steps: int = 500,
) -> DataFrame:
    """(cell, xt) for every cell of the grid.

    Spark reduces the actions to counts per (cell, next cell): at most grid squared rows,
    whatever the number of actions. Value iteration runs on that fixed-size table.
    """
    cells = length * width
    shot = F.col("type_name") == "shot"
    counted = (
        train.where(is_move() | shot)
        .select(
            cell_of("start_x", "start_y", length, width).alias("a"),
            F.when(
                is_move() & X.is_success(), cell_of("end_x", "end_y", length, width)
            ).alias("b"),
            is_move().cast("long").alias("moves"),
            shot.cast("long").alias("shots"),
            (shot & X.is_success()).cast("long").alias("goals"),
        )
        .where(F.col("a").isNotNull())
        .groupBy("a", "b")
        .agg(*[F.sum(c).alias(c) for c in ("moves", "shots", "goals")])
    )

    def iterate(pdf: pd.DataFrame) -> pd.DataFrame:
        totals = pdf.groupby("a")[["moves", "shots", "goals"]].sum().reindex(range(cells), fill_value=0)
        moves, shots, goals = (totals[c].to_numpy(float) for c in ("moves", "shots", "goals"))
        landed = pdf[pdf["b"].notna()]
        step = np.zeros((cells, cells))
        a, b = landed["a"].to_numpy(int), landed["b"].to_numpy(int)
        step[a, b] = landed["moves"].to_numpy(float) / moves[a]
        score = np.divide(goals, shots, out=np.zeros(cells), where=shots > 0)
        every = moves + shots
        shoot = np.divide(shots, every, out=np.zeros(cells), where=every > 0)
        move = np.divide(moves, every, out=np.zeros(cells), where=every > 0)
        value = np.zeros(cells)
        for _ in range(max_steps):
            fresh = score * shoot + move * (step @ value)
            settled = np.abs(fresh - value).max() <= tolerance
            value = fresh
            if settled:
                break
        return pd.DataFrame({"cell": np.arange(cells), "xt": value})

    # Fitting is eager, as with any model: the surface is read by every later plan.
    return durable(
        counted.groupBy(F.lit(0).alias("_one")).applyInPandas(
            lambda pdf: iterate(pdf), schema="cell long, xt double"
        )
    )


def rate_actions(
    actions: DataFrame, surface: DataFrame, length: int = S.GRID_LENGTH, width: int = S.GRID_WIDTH
) -> DataFrame:
    """Add ``xt_value``: gain of each successful move, null for everything else.

    ``length`` and ``width`` are those of the grid that the surface was fitted on.
    """
    origin = surface.select(F.col("cell").alias("_a"), F.col("xt").alias("_xa"))
    target = surface.select(F.col("cell").alias("_b"), F.col("xt").alias("_xb"))
    # The surface has exactly one row per grid cell, so both sides broadcast at any scale.
    return (
        actions.withColumns(
            {
                "_a": cell_of("start_x", "start_y", length, width),
                "_b": cell_of("end_x", "end_y", length, width),
            }
        )
        .join(F.broadcast(origin), "_a", "left")
        .join(F.broadcast(target), "_b", "left")
        .withColumn("xt_value", F.when(is_move() & X.is_success(), F.col("_xb") - F.col("_xa")))
        .drop("_a", "_b", "_xa", "_xb")
    )


def fit_xthreat(actions: DataFrame, train_games: DataFrame, **grid) -> DataFrame:
    """Fit on the training matches only, then rate every action."""
    train = actions.join(train_games.select("game_id").distinct(), "game_id", "left_semi")
    if train.isEmpty():
        raise ThreatError("no action belongs to a training match; assign the split first")
    sides = {k: v for k, v in grid.items() if k in ("length", "width")}
    return rate_actions(actions, fit_surface(train, **grid), **sides)


def _gain() -> Column:
    return F.greatest(F.coalesce(F.col("xt_value"), F.lit(0.0)), F.lit(0.0))


def player_threat(rated: DataFrame, keys=S.NETWORK_KEYS) -> DataFrame:
    """Share of the group's positive threat; 0 where the group has none."""
    keys = list(keys)
    own = (
        rated.where(F.col("player_id").isNotNull())
        .groupBy(*keys, "player_id").agg(F.sum(_gain()).alias("_own"))
    )
    total = own.groupBy(*keys).agg(F.sum("_own").alias("_all"))
    return own.join(total, keys).select(
        *keys, "player_id", X.safe_ratio("_own", "_all").alias("xt_generated")
    )


def threat_lanes(rated: DataFrame, keys=S.NETWORK_KEYS) -> DataFrame:
    """Positive threat and pass count per lane, on the same passes as the edge table."""
    return (
        lane_passes(rated)
        .groupBy(*keys, F.col("player_id").alias("source"), F.col("recipient_id").alias("target"))
        .agg(F.sum(_gain()).alias("xt_weight"), F.count("action_id").alias("weight"))
        .where(F.col("source") != F.col("target"))
    )


def attach_threat(
    edges: DataFrame, rated: DataFrame, keys=S.NETWORK_KEYS, check: bool = True
) -> DataFrame:
    """Stored edges plus ``xt_weight``; refuses a join that does not line up.

    With ``check`` the rows are counted while the result is written out, so the check costs no pass of its
    own and what was checked is what is returned.
    """
    on = [*keys, "source", "target"]
    lanes = threat_lanes(rated, keys).withColumnRenamed("weight", "_recount")
    if not check:
        return edges.join(lanes, on, "left").drop("_recount")
    given, seen = Observation(), Observation()
    joined = staged(
        edges.observe(given, F.count(F.lit(1)).alias("rows")).join(lanes, on, "left").observe(
            seen, F.count(F.lit(1)).alias("rows"), X.tally(F.col("_recount").isNull()).alias("unmatched"),
            X.tally(F.col("_recount") != F.col("weight")).alias("uneven"))
    )
    before, stats = given.get["rows"], seen.get
    if stats["rows"] != before:
        raise ThreatError(f"threat join changed the row count from {before} to {stats['rows']}")
    if stats["unmatched"] or stats["uneven"]:
        raise ThreatError(
            f"{stats['unmatched']} edges without a lane, {stats['uneven']} with another count"
        )
    return joined.drop("_recount")
