"""Chronological folds and the guards around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitchloom import schema as S
from pitchloom.functions import expressions as X


class LeakageError(AssertionError):
    """A match sits in two folds, or a validation-only column reached a feature table."""


WEEK_COLUMNS = ("game_day", "match_week", "matchweek")
# Last training and validation week of each split kind.
WEEK_BOUNDS = {"matchweek": (26, 33), "within_season": (26, 32)}


def week_column(games: DataFrame) -> str:
    for name in WEEK_COLUMNS:
        if name in games.columns:
            return name
    raise KeyError(f"none of {WEEK_COLUMNS} in {games.columns}")


def temporal_split(
    games: DataFrame, kind: str = "matchweek", season: str | None = None,
    test_season: str | None = None, train_max_week: int = 30,
) -> DataFrame:
    """(game_id, fold). A week that is not a number leaves the match unused.

    ``matchweek`` and ``within_season`` split every season (or the named one) by week;
    ``cross_season`` trains on one season and tests on another.
    """
    week = F.expr(f"try_cast({week_column(games)} AS int)")
    if kind in WEEK_BOUNDS:
        last_train, last_val = WEEK_BOUNDS[kind]
        rows = games if season is None else games.where(F.col("season") == season)
        fold = (
            F.when(week <= last_train, "train").when(week <= last_val, "val").when(week > last_val, "test")
        )
    elif kind == "cross_season":
        if season is None or test_season is None:
            raise ValueError("a cross-season split needs a training and a test season")
        rows = games.where(F.col("season").isin(season, test_season))
        fold = F.when(F.col("season") == test_season, "test").when(
            week <= train_max_week, "train"
        ).when(week > train_max_week, "val")
    else:
        raise ValueError(f"split kind {kind!r} is not supported")
    return rows.select("game_id", F.coalesce(fold, F.lit("unused")).alias("fold"))


def assign_fold(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Label rows with the fold of their match; matches outside the split are unused."""
    return rows.join(split, "game_id", "left").withColumn(
        "fold", F.coalesce("fold", F.lit("unused"))
    )


def fold_conflicts(rows: DataFrame) -> DataFrame:
    """Matches that appear in more than one used fold."""
    return (
        rows.where(F.col("fold") != "unused").groupBy("game_id")
        .agg(F.min("fold").alias("first_fold"), F.max("fold").alias("last_fold"))
        .where(F.col("first_fold") != F.col("last_fold"))
    )


def assert_disjoint(rows: DataFrame) -> None:
    """Raise when any match is on both sides; also catches a random split over rows."""
    shown = fold_conflicts(rows).limit(5).collect()
    if shown:
        raise LeakageError(f"matches in more than one fold, e.g. {[r['game_id'] for r in shown]}")


def assert_no_enrichment(df: DataFrame, context: str = "frame") -> None:
    """Raise when a validation-only column is present. Looks at the schema only."""
    found = sorted(set(S.ENRICHMENT_ONLY_COLUMNS) & set(df.columns))
    if found:
        raise LeakageError(f"{context} carries validation-only columns {found}")


def fold_report(rows: DataFrame) -> DataFrame:
    """Rows, matches and role balance per fold."""
    columns = [F.count(F.lit(1)).alias("rows"), F.count_distinct("game_id").alias("games")]
    if "coarse_role" in rows.columns:
        known = F.nullif(F.count("coarse_role"), F.lit(0))
        columns += [
            F.coalesce(100.0 * X.tally(F.col("coarse_role") == r) / known, F.lit(0.0)).alias(f"pct_{r}")
            for r in S.COARSE_ROLES
        ]
    return rows.groupBy("fold").agg(*columns)
