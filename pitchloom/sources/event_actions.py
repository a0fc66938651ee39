"""Canonical action table derived from a generic event stream.

The stream (event_id, ts, user_id, event_type, value, props) carries no football. A match is
a run of 200 consecutive event ids, so matches stay small at any scale and their number grows
with the stream; a season is 38 matches; clubs and players belong to a cohort of four seasons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitchloom import schema as S

MATCH_EVENTS = 200
HALF_EVENTS = 100
SECONDS_PER_EVENT = 30.0
SEASON_MATCHES = 38
COHORT_SEASONS = 4
CLUBS = 6
SQUAD = 11

# How (event type, k) becomes an action type: upper bounds of k, exclusive.
TYPE_BANDS = {
    "click": ((90, "pass"), (100, "cross")),
    "view": ((40, "dribble"), (70, "take_on"), (100, "pass")),
    "purchase": ((30, "shot"), (35, "shot_penalty"), (40, "shot_freekick"), (100, "pass")),
    "signup": ((40, "throw_in"), (50, "corner_crossed"), (60, "freekick_short"), (100, "pass")),
    "error": (
        (35, "clearance"), (60, "interception"), (70, "tackle"), (80, "bad_touch"),
        (90, "foul"), (100, "keeper_save"),
    ),
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The projections below are SQL text: one parse in the JVM instead of hundreds of small calls.


def _band_type() -> str:
    """CASE text for the action type."""
    parts = []
    for event_type, bands in TYPE_BANDS.items():
        inner = " ".join(f"WHEN k < {bound} THEN '{name}'" for bound, name in bands)
        parts.append(f"WHEN event_type = '{event_type}' THEN CASE {inner} ELSE 'non_action' END")
    return "CASE " + " ".join(parts) + " ELSE 'non_action' END"


def _position_in(names, column: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"CAST(array_position(array({listed}), {column}) - 1 AS int)"


def season_columns(df: DataFrame) -> DataFrame:
    """Season, provider, matchday and the two clubs of a match, from its id."""
    season = f"(game_id div {SEASON_MATCHES})"
    cohort = f"({season} div {COHORT_SEASONS})"
    home = f"(game_id % {CLUBS})"
    away = f"(({home} + 1 + (game_id div {CLUBS}) % {CLUBS - 1}) % {CLUBS})"
    return df.selectExpr(
        "*",
        f"CAST(2000 + {season} AS string) AS season",
        f"CASE WHEN {season} % 2 = 0 THEN 'alpha' ELSE 'beta' END AS provider",
        f"CAST(game_id % {SEASON_MATCHES} + 1 AS int) AS game_day",
        f"{cohort} * 10 + {home} + 1 AS home_team_id",
        f"{cohort} * 10 + {away} + 1 AS away_team_id",
    )


def actions_from_events(events: DataFrame) -> DataFrame:
    """Narrow projection only: no shuffle, columns prune down to what a query uses."""
    df = season_columns(
        events.selectExpr(
            "event_id", "user_id", "event_type", "value",
            "CAST(get_json_object(props, '$.k') AS int) AS k",
            f"event_id div {MATCH_EVENTS} AS game_id", f"event_id % {MATCH_EVENTS} AS _at",
        )
    )
    df = df.selectExpr(
        "*",
        "CASE WHEN (_at div 5 + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) % 2 = 0 "
        "THEN home_team_id ELSE away_team_id END AS team_id",
        f"(user_id div 2) % {SQUAD} AS _slot",
        f"{_band_type()} AS type_name",
        f"(user_id div 2) % {SQUAD} * 7D + (event_id * 37 % 350) / 10D AS start_x",
    )
    df = df.selectExpr(
        "*",
        "CASE WHEN startswith(type_name, 'shot') THEN IF(value < 10, 'success', 'fail') "
        "WHEN type_name = 'bad_touch' AND value >= 80 THEN 'owngoal' "
        "WHEN value < 80 THEN 'success' ELSE 'fail' END AS result_name",
    )
    return df.selectExpr(
        "game_id",
        "concat('e', CAST(event_id AS string)) AS original_event_id",
        f"CAST(IF(_at < {HALF_EVENTS}, 1, 2) AS bigint) AS period_id",
        f"_at % {HALF_EVENTS} * {SECONDS_PER_EVENT}D AS time_seconds",
        "team_id",
        "CASE WHEN event_id % 97 <> 0 THEN team_id * 100 + _slot END AS player_id",
        "start_x",
        "k * 0.68D AS start_y",
        "greatest(0D, least(105D, start_x + ((event_id * 53 + 17) % 400) / 10D - 15D)) AS end_x",
        "(k * 7 + 13) % 100 * 0.68D AS end_y",
        f"{_position_in(S.ACTION_TYPES, 'type_name')} AS type_id",
        f"{_position_in(S.RESULT_TYPES, 'result_name')} AS result_id",
        "CAST(event_id % 3 AS int) AS bodypart_id",
        "event_id AS action_id", "type_name", "result_name", "season", "provider",
    )


def read_actions(spark: SparkSession, folder: str) -> DataFrame:
    return actions_from_events(read_table(spark, folder, "events"))


def read_games(spark: SparkSession, folder: str) -> DataFrame:
    """One row per match. Scores are missing for every eleventh match."""
    games = (
        read_table(spark, folder, "events")
        .groupBy(F.expr(f"event_id div {MATCH_EVENTS}").alias("game_id"))
        .agg(F.min("ts").alias("game_date"))
    )
    known = F.col("game_id") % 11 != 0
    return season_columns(games).withColumns(
        {
            "home_score": F.when(known, F.col("game_id") * 7 % 4).cast("int"),
            "away_score": F.when(known, F.col("game_id") * 5 % 3).cast("int"),
        }
    )


def read_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Validation-only columns per event: a recipient and a possession counter."""
    df = read_table(spark, folder, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "user_id",
        F.expr(f"event_id div {MATCH_EVENTS}").alias("game_id"),
    )
    df = season_columns(df)
    return df.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("original_event_id"),
        F.when(
            F.col("event_id") % 3 != 0,
            F.when(F.col("k") % 2 == 0, F.col("home_team_id")).otherwise(F.col("away_team_id"))
            * 100 + F.col("k") % SQUAD,
        ).alias("true_recipient_id"),
        F.when(F.col("event_id") % 19 != 0, F.expr("event_id div 4")).alias("statsbomb_possession"),
    )


FINE_BY_SLOT = (
    "Goalkeeper", "Right Back", "Right Center Back", "Left Center Back", "Left Back",
    "Center Defensive Midfield", "Right Midfield", "Left Midfield", "Right Wing",
    "Center Forward", "Left Wing",
)
CODE_BY_SLOT = ("GK", "DF", "DF", "DF", "DF", "MD", "MD", "MD", "FW", "FW", "FW")


def read_lineup(spark: SparkSession, folder: str) -> DataFrame:
    """(season, provider, player) with the position each provider would publish."""
    seen = (
        read_actions(spark, folder)
        .where(F.col("player_id").isNotNull())
        .select("season", "provider", "team_id", "player_id")
        .distinct()
    )
    slot = (F.col("player_id") % 100).cast("int") + 1
    fine = F.element_at(F.array(*[F.lit(p) for p in FINE_BY_SLOT]), slot)
    code = F.element_at(F.array(*[F.lit(p) for p in CODE_BY_SLOT]), slot)
    return seen.select(
        "season", "provider", "team_id", "player_id",
        F.when(F.col("provider") == "alpha", fine).alias("fine_position"),
        F.when(F.col("provider") == "beta", code).alias("role_code"),
    )
