"""Roles, clubs and players across data providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitchloom import schema as S
from pitchloom.functions import expressions as X
from pitchloom.functions.text import normalise_name, surname, unescape_name


class UnknownPosition(KeyError):
    """A position outside the mapping; never bucketed silently."""


def role_mapping(spark: SparkSession) -> DataFrame:
    """Both providers' position labels and their coarse role (29 rows)."""
    rows = [("fine", p, r) for p, r in S.FINE_POSITION_ROLES.items()]
    rows += [("code", c, r) for c, r in S.ROLE_CODE_ROLES.items()]
    return spark.createDataFrame(rows, "vocabulary string, label string, coarse_role string")


def coarse_role(df: DataFrame, column: str, vocabulary: str, strict: bool = True) -> DataFrame:
    """Add ``coarse_role``. Strict raises on an unmapped label, lenient leaves it null."""
    mapping = role_mapping(df.sparkSession).where(F.col("vocabulary") == vocabulary)
    if strict:
        gaps = [r[0] for r in unmapped_labels(df, column, vocabulary).limit(5).collect()]
        if gaps:
            raise UnknownPosition(f"unmapped labels, e.g. {gaps}")
    # The mapping is a fixed table of 29 rows.
    lookup = F.broadcast(mapping.select(F.col("label").alias(column), "coarse_role"))
    return df.join(lookup, column, "left")


def unmapped_labels(df: DataFrame, column: str, vocabulary: str) -> DataFrame:
    """Labels seen in the data that the mapping does not know."""
    mapping = role_mapping(df.sparkSession).where(F.col("vocabulary") == vocabulary)
    return (
        df.where(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct()
        .join(F.broadcast(mapping), "label", "left_anti")
    )


def role_index(column="coarse_role") -> Column:
    return X.index_in(column, S.COARSE_ROLES)


def player_directory(lineup: DataFrame, appeared: DataFrame | None = None) -> DataFrame:
    """Per (season, provider, player): coarse role from whichever label the provider has."""
    rows = coarse_role(lineup, "fine_position", "fine", strict=False).withColumnRenamed(
        "coarse_role", "_fine_role"
    )
    rows = coarse_role(rows, "role_code", "code", strict=False)
    directory = rows.select(
        "season", "provider", "player_id", F.coalesce("_fine_role", "coarse_role").alias("coarse_role"),
        "fine_position",
    ).distinct()
    return directory if appeared is None else restrict_to_appeared(directory, appeared)


def restrict_to_appeared(directory: DataFrame, actions: DataFrame) -> DataFrame:
    """Only players with an action in that season and provider."""
    on = ["season", "provider", "player_id"]
    return directory.join(actions.select(*on).distinct(), on, "left_semi")


def union_directories(*tables: DataFrame) -> DataFrame:
    """Providers' directories stacked by column name."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def nominal_positions(lineups: DataFrame) -> DataFrame:
    """Most-played position, total minutes, matches and name of each player.

    Equal minutes go to the position that sorts first.
    """
    per = lineups.groupBy("player_id", "position").agg(F.sum("minutes_played").alias("_m"))
    # max over (minutes, position) with the position compared backwards: take the smallest.
    top = per.where(F.col("position").isNotNull()).groupBy("player_id").agg(
        F.min_by("position", F.struct((-F.col("_m")).alias("m"), "position")).alias("position")
    )
    totals = lineups.groupBy("player_id").agg(
        F.min_by("player_name", "game_id").alias("player_name"),
        F.sum("minutes_played").alias("minutes_total"),
        F.count_distinct("game_id").alias("matches"),
    )
    return totals.join(top, "player_id", "left")


def static_directory(players: DataFrame) -> DataFrame:
    """Directory of a provider without match positions: unescaped name, mapped role code."""
    named = players.select(
        F.col("wyId").cast("long").alias("player_id"),
        unescape_name(F.col("shortName")).alias("player_name"),
        F.col("role.code2").alias("role_code"),
    )
    return coarse_role(named, "role_code", "code", strict=False).select(
        "player_id", "player_name", "coarse_role", F.lit(None).cast("string").alias("fine_position")
    )


def club_labels(frame: DataFrame, teams: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Display name: the teams table, else the alias table, else 'team <id>'."""
    on = ["provider", "team_id"]
    out = frame.join(teams.select(*on, F.col("team_name").alias("_name")), on, "left")
    names = [F.col("_name")]
    if aliases is not None:
        out = out.join(aliases.select(*on, F.col("display_name").alias("_alias")), on, "left")
        names.append(F.col("_alias"))
    fallback = F.concat(F.lit("team "), F.col("team_id").cast("string"))
    return out.withColumn("club", F.coalesce(*names, fallback)).drop("_name", "_alias")


def club_bridge(aliases: DataFrame, left: str, right: str) -> DataFrame:
    """Club key with both providers' team ids; only clubs known to both."""
    def side(provider):
        return aliases.where(F.col("provider") == provider).select(
            "club_key", F.col("team_id").alias(f"team_id_{provider}")
        )

    return side(left).join(side(right), "club_key")


def match_players(
    left: DataFrame, right: DataFrame, left_name: str = "player_name", right_name: str = "player_name"
) -> DataFrame:
    """Pairs by full normalised name, then by a surname that is unique on both sides.

    Full names that several players share give every pair, as an equi join does. Names that
    normalise to nothing (no Latin letter) never match.
    """
    def prepare(df, name, tag):
        full = normalise_name(F.col(name))
        return df.select(
            F.col("player_id").alias(f"player_id_{tag}"), F.col(name).alias("_raw")
        ).distinct().select(f"player_id_{tag}", normalise_name(F.col("_raw")).alias("_full"))

    a, b = prepare(left, left_name, "left"), prepare(right, right_name, "right")
    exact = a.where(F.col("_full") != "").join(b, "_full").select(
        "player_id_left", "player_id_right", F.lit("full_name").alias("match_rule")
    )

    def rest(df, tag):
        rows = df.join(exact, f"player_id_{tag}", "left_anti").withColumn("_last", surname(F.col("_full")))
        return (
            rows.where(F.col("_last") != "").groupBy("_last")
            .agg(F.count(F.lit(1)).alias("_n"), F.min(f"player_id_{tag}").alias(f"player_id_{tag}"))
            .where(F.col("_n") == 1).drop("_n")
        )

    by_surname = rest(a, "left").join(rest(b, "right"), "_last").select(
        "player_id_left", "player_id_right", F.lit("surname").alias("match_rule")
    )
    return exact.unionByName(by_surname)
