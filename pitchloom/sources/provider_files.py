"""Raw provider JSON: event truth, lineup spells, match scores, corrupt-file quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_NAMED = "struct<id:bigint,name:string>"
EVENT_DDL = (
    f"id string, possession bigint, pass struct<recipient:{_NAMED}>, "
    f"shot struct<statsbomb_xg:double>, under_pressure boolean, play_pattern {_NAMED}, position {_NAMED}"
)
LINEUP_DDL = (
    "team_id bigint, team_name string, lineup array<struct<player_id:bigint,player_name:string,"
    "player_nickname:string,positions:array<struct<position:string,`from`:string,`to`:string,start_reason:string>>>>"
)
MATCH_DDL = (
    "wyId bigint, teamsData map<string,struct<side:string,score:int,teamId:bigint>>"
)
CORRUPT = "_corrupt_record"


class OrientationError(ValueError):
    """Index and raw file disagree on which team is at home."""


def read_documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Multi-line JSON files with the match id taken from the file name.

    Files that do not parse keep their text in ``_corrupt_record``.
    """
    rows = (
        spark.read.schema(f"{ddl}, {CORRUPT} string").option("multiLine", True)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    )
    return rows.select(
        "*", F.col("_metadata.file_path").alias("file_path"),
        F.expr("try_cast(regexp_extract(_metadata.file_name, '([0-9]+)[.]json$', 1) AS bigint)").alias("game_id"),
    )


def parse_documents(texts: DataFrame, column: str, ddl: str) -> DataFrame:
    """The same for JSON text held in a column, one object per row."""
    parsed = F.from_json(
        column, f"{ddl}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    others = [c for c in texts.columns if c != column]
    return texts.select(*others, F.col(column).alias("text"), parsed.alias("_d")).select(*others, "text", "_d.*")


def quarantine(parsed: DataFrame):
    """(good rows, corrupt rows)."""
    bad = F.col(CORRUPT).isNotNull()
    return parsed.where(~bad).drop(CORRUPT), parsed.where(bad)


def event_truth(events: DataFrame) -> DataFrame:
    """Validation-only columns of each event."""
    return events.select(
        "game_id", F.col("id").alias("original_event_id"),
        F.col("pass.recipient.id").alias("true_recipient_id"),
        F.col("possession").alias("statsbomb_possession"), F.col("shot.statsbomb_xg").alias("statsbomb_xg"),
        F.coalesce("under_pressure", F.lit(False)).alias("under_pressure"),
        F.col("play_pattern.name").alias("play_pattern"), F.col("position.name").alias("position_name_24"),
        F.col("position.id").alias("position_id_24"),
    )


def clock_minutes(stamp: str) -> Column:
    """'mm:ss' or 'hh:mm:ss' to minutes; null for anything else."""
    parts = f"split({stamp}, ':')"

    def number(i):
        return f"try_cast(get({parts}, {i}) AS double)"

    return F.expr(
        f"CASE size({parts}) WHEN 3 THEN {number(0)} * 60 + {number(1)} + {number(2)} / 60 "
        f"WHEN 2 THEN {number(0)} + {number(1)} / 60 END"
    )


def lineup_spells(lineups: DataFrame) -> DataFrame:
    """Per match and player: longest position spell, total minutes, started flag.

    An open spell ends at 90, a spell never lasts less than 0, the first of equally long
    spells counts.
    """
    players = lineups.select(
        "game_id", "team_id", "team_name", F.explode("lineup").alias("p")
    ).select(
        "game_id", "team_id", "team_name", F.col("p.player_id").alias("player_id"),
        F.coalesce(F.when(F.col("p.player_nickname") != "", F.col("p.player_nickname")), F.col("p.player_name")).alias("player_name"),
        F.coalesce(
            F.expr("get(p.positions, 0).start_reason = 'Starting XI'"), F.lit(False)
        ).alias("started"),
        F.posexplode_outer("p.positions").alias("_n", "s"),
    )
    start = F.coalesce(clock_minutes("s.`from`"), F.lit(0.0))
    end = F.coalesce(clock_minutes("s.`to`"), F.lit(90.0))
    minutes = F.when(F.col("s").isNotNull(), F.greatest(end - start, F.lit(0.0)))
    return players.withColumn("_m", minutes).groupBy("game_id", "team_id", "player_id").agg(
        F.first("team_name", True).alias("team_name"), F.first("player_name", True).alias("player_name"),
        F.max_by("s.position", F.when(F.col("_m").isNotNull(), F.struct("_m", -F.col("_n")))).alias("position_name_24"),
        F.coalesce(F.sum("_m"), F.lit(0.0)).alias("minutes_played"), F.bool_or("started").alias("started"),
    )


def match_scores(matches: DataFrame) -> DataFrame:
    """Home and away score and team of each match with both sides present."""
    teams = matches.select(
        F.col("wyId").alias("game_id"), F.explode(F.map_values("teamsData")).alias("t")
    ).select("game_id", "t.*")

    def pick(side, column):
        return F.max(F.when(F.col("side") == side, F.col(column)))

    return teams.groupBy("game_id").agg(
        pick("home", "score").alias("home_score_fill"), pick("away", "score").alias("away_score_fill"),
        pick("home", "teamId").alias("home_team_check"), pick("away", "teamId").alias("away_team_check"),
    ).where(F.col("home_team_check").isNotNull() & F.col("away_team_check").isNotNull())


def backfill_scores(games: DataFrame, scores: DataFrame, provider: str, check: bool = True) -> DataFrame:
    """Scores of one provider from its raw file; refuses when home and away are swapped."""
    joined = games.join(scores, "game_id", "left")
    matched = (F.col("provider") == provider) & F.col("home_score_fill").isNotNull()
    if check:
        wrong = joined.where(matched & (F.col("home_team_id") != F.col("home_team_check"))).count()
        if wrong:
            raise OrientationError(f"{wrong} matches disagree on the home team")
    return joined.withColumns(
        {
            f"{side}_score": F.when(matched, F.col(f"{side}_score_fill")).otherwise(F.col(f"{side}_score"))
            for side in ("home", "away")
        }
    ).select(*games.columns)
