import pytest
from pyspark.sql import functions as F

import frames
from pitchloom import schema as S
from pitchloom.operators import chains as C, sequence as Q, splits as SP, state as ST, threat as TH

HOME, AWAY = 100, 200


def game_rows():
    rows = []
    for minute in range(1, 90, 2):
        rows.append((minute, dict(team_id=HOME, player_id=1, start_x=40 + minute / 3, end_x=45 + minute / 3)))
    for minute, team, result in ((10, HOME, "success"), (50, AWAY, "success"), (80, HOME, "success"), (30, AWAY, "fail")):
        rows.append((minute, dict(team_id=team, player_id=2, type_name="shot", result_name=result, start_x=95.0, end_x=105.0)))
    out = []
    for i, (minute, row) in enumerate(sorted(rows, key=lambda r: r[0])):
        period = 1 if minute <= 45 else 2
        row.update(game_id=7, action_id=i, period_id=period, time_seconds=(minute - (0 if period == 1 else 45)) * 60.0)
        out.append(row)
    return out


GAME_DDL = (
    "game_id long, season string, provider string, game_day int, home_team_id long, away_team_id long, "
    "home_score int, away_score int"
)


def outcomes(spark, rows=((7, "s", "p", 5, HOME, AWAY, 2, 1),)):
    return ST.match_outcomes(spark.createDataFrame(list(rows), GAME_DDL))


def test_goals_and_labels(spark):
    goals = Q.derive_goals(frames.actions(spark, game_rows())).orderBy("minute").collect()
    assert [(g["minute"], g["scoring_team_id"]) for g in goals] == [(10, HOME), (50, AWAY), (80, HOME)]
    games = [(1, "s", "p", 1, 1, 2, 2, 0), (2, "s", "p", 1, 1, 2, 1, 1), (3, "s", "p", 1, 1, 2, 0, 3), (4, "s", "p", 1, 1, 2, None, 1)]
    got = {r["game_id"]: r["outcome_index"] for r in outcomes(spark, games).collect()}
    assert got == {1: 0, 2: 1, 3: 2}


def test_state_table_never_looks_ahead(spark):
    actions = frames.actions(spark, game_rows())
    columns = ["goals_home", "goals_away", *S.B2_FEATURES]
    full = {r["window_index"]: r for r in ST.state_table(actions, outcomes(spark)).collect()}
    assert len(full) == 16
    assert [full[w]["goal_diff"] for w in (0, 7, 13)] == [1, 0, 1]
    minute = F.col("time_seconds") / 60 + F.when(F.col("period_id") == 2, 45).otherwise(0)
    for window in (0, 7, 15):
        early = actions.where(minute <= 15 + 5 * window)
        row = ST.state_table(early, outcomes(spark)).where(F.col("window_index") == window).first()
        assert [row[c] for c in columns] == pytest.approx([full[window][c] for c in columns])


def test_checkpoint_bound_is_inclusive(spark):
    rows = [dict(time_seconds=900.0), dict(time_seconds=900.1)]
    got = {r["window_index"]: r["passes"] for r in ST.cumulative_stats(frames.actions(spark, rows)).collect()}
    assert got[0] == 1 and got[1] == 2 and got[15] == 2


def test_form_excludes_the_current_match(spark):
    games = [(1, "s", "p", 1, 1, 2, 3, 0), (2, "s", "p", 2, 2, 1, 1, 1), (3, "s", "p", 3, 1, 2, 0, 1)]
    got = {(r["game_id"], r["team_id"]): (r["form_ppg"], r["form_gd"]) for r in ST.rolling_form(outcomes(spark, games)).collect()}
    assert got[(1, 1)] == (1.0, 0.0) and got[(2, 1)] == (3.0, 3.0)
    assert got[(3, 1)] == (2.0, 1.5) and got[(3, 2)] == (0.5, -1.5)


def chain_rows():
    rows = []
    for i, x in enumerate((20, 32, 44, 56, 68)):
        rows.append(dict(possession_id=0, start_x=float(x), end_x=x + 8.0, time_seconds=10.0 + i))
    rows.append(dict(possession_id=0, start_x=60.0, end_x=68.0, time_seconds=13.5, type_name="dribble"))
    rows.append(dict(possession_id=0, start_x=90.0, end_x=98.0, time_seconds=16.0, type_name="shot"))
    for i, y in enumerate((20, 25, 30)):
        rows.append(dict(possession_id=1, team_id=2, start_x=50.0, end_x=58.0, start_y=float(y), end_y=float(y), time_seconds=30.0 + i))
    for i in (0, 1):
        rows.append(dict(possession_id=2, time_seconds=50.0 + i))
    return rows


def chained(spark):
    rows = chain_rows()
    owner = spark.createDataFrame([(i, r["possession_id"]) for i, r in enumerate(rows)], "action_id long, possession_id long")
    return frames.actions(spark, rows).join(owner, "action_id")


def test_chain_table(spark):
    actions = chained(spark)
    table = C.chain_table(actions)
    got = {r["possession_id"]: r for r in table.collect()}
    assert set(got) == {0, 1} and got[0]["n_actions"] == 6
    assert got[0]["ends_in_shot"] and not got[1]["ends_in_shot"]
    assert got[0]["start_x"] == 20 and got[0]["end_x"] == 98 and got[0]["duration_seconds"] == pytest.approx(6)
    assert got[0]["start_zone"] == "defensive" and got[0]["end_zone"] == "final" and got[1]["width_used"] == 10
    tokens = {r["possession_id"]: r for r in C.chain_sequences(actions, table).collect()}
    assert tokens[0]["length"] == 6 and len(tokens[0]["tokens"]) == S.CHAIN_TOKENS * C.TOKEN_WIDTH
    assert tokens[0]["tokens"][6 * C.TOKEN_WIDTH :] == [0.0] * (6 * C.TOKEN_WIDTH)
    assert tokens[0]["tokens"][C.TOKEN_VOCABULARY.index("pass")] == 1.0


def test_involvement_and_conversion(spark):
    rows = [dict(player_id=10, possession_id=p) for p in range(5)] + [dict(player_id=20, possession_id=0, type_name="shot")]
    owner = spark.createDataFrame([(i, r["possession_id"]) for i, r in enumerate(rows)], "action_id long, possession_id long")
    actions = frames.actions(spark, rows).join(owner, "action_id")
    got = {r["player_id"]: r for r in C.shot_chain_involvement(actions).collect()}
    assert got[10]["shot_involvement"] == 1 and got[10]["shot_conversion"] == pytest.approx(0.2)
    assert got[20]["shot_involvement"] == 1 and got[20]["shot_conversion"] == 1
    assert C.shot_chain_involvement(actions.where("type_name <> 'shot'")).isEmpty()


def test_threat_shares_and_guards(spark):
    rows = [dict(player_id=p, xt=x) for p, x in ((10, 0.1), (10, 0.1), (20, 0.2), (30, 0.0), (30, -0.4))]
    values = spark.createDataFrame([(i, r["xt"]) for i, r in enumerate(rows)], "action_id long, xt_value double")
    rated = frames.actions(spark, rows).join(values, "action_id")
    got = {r["player_id"]: r["xt_generated"] for r in TH.player_threat(rated).collect()}
    assert got == pytest.approx({10: 0.5, 20: 0.5, 30: 0.0})
    with pytest.raises(TH.ThreatError):
        TH.fit_xthreat(frames.actions(spark, rows), spark.createDataFrame([(99,)], "game_id long"))
    lanes = Q.infer_recipients(rated)
    from pitchloom.operators import network as N

    edges = N.edge_table(lanes)
    assert TH.attach_threat(edges, lanes).count() == edges.count()
    with pytest.raises(TH.ThreatError):
        TH.attach_threat(edges.withColumn("weight", F.col("weight") + 1), lanes)


def test_threat_surface_by_hand(spark):
    """Two cells: half of the actions in the far cell are shots, half of the shots score."""
    far = dict(start_x=104.0, start_y=34.0, end_x=104.0, end_y=34.0)
    rows = [
        dict(far, type_name="shot"), dict(far, type_name="shot", result_name="fail"),
        dict(far, type_name="pass", result_name="fail"), dict(far, type_name="pass", result_name="fail"),
        dict(start_x=1.0, start_y=34.0, end_x=104.0, end_y=34.0),
        dict(start_x=1.0, start_y=34.0, end_x=104.0, end_y=34.0, result_name="fail"),
    ]
    actions = frames.actions(spark, rows)
    surface = TH.fit_surface(actions)
    assert surface.count() == S.GRID_LENGTH * S.GRID_WIDTH
    rated = {r["action_id"]: r["xt_value"] for r in TH.rate_actions(actions, surface).collect()}
    assert rated[4] == pytest.approx(0.25 - 0.125)
    assert rated[0] is None and rated[5] is None


def season(spark, games=380):
    rows = [(1000 + i, "s", "p", str(i // 10 + 1)) for i in range(games)] + [(1, "s", "p", "final")]
    return spark.createDataFrame(rows, "game_id long, season string, provider string, game_day string")


def test_matchweek_split(spark):
    split = SP.temporal_split(season(spark), "matchweek")
    got = {r["fold"]: r["count"] for r in split.groupBy("fold").count().collect()}
    assert got == {"train": 260, "val": 70, "test": 50, "unused": 1}
    SP.assert_disjoint(split)
    with pytest.raises(ValueError):
        SP.temporal_split(season(spark), "random")
    with pytest.raises(KeyError):
        SP.temporal_split(season(spark).drop("game_day"), "matchweek")


def test_fold_guards(spark):
    rows = spark.createDataFrame([(1, "train"), (1, "test"), (2, "unused"), (2, "train")], "game_id long, fold string")
    with pytest.raises(SP.LeakageError):
        SP.assert_disjoint(rows)
    SP.assert_disjoint(rows.where("game_id = 2"))
    with pytest.raises(SP.LeakageError):
        SP.assert_no_enrichment(spark.createDataFrame([(1, 0.5)], "game_id long, statsbomb_xg double"))
