"""Small hand-made tables for the tests."""

from __future__ import annotations

import random

ACTION_DDL = (
    "game_id long, period_id long, time_seconds double, team_id long, player_id long, action_id long, "
    "type_name string, result_name string, start_x double, start_y double, end_x double, end_y double, "
    "season string, provider string"
)


def actions(spark, rows, game=1):
    """rows: dicts with any of the columns; the row number is time and action id by default."""
    out = []
    for i, row in enumerate(rows):
        base = dict(
            game_id=game, period_id=1, time_seconds=float(i), team_id=1, player_id=10, action_id=i,
            type_name="pass", result_name="success", start_x=50.0, start_y=34.0, end_x=60.0,
            end_y=34.0, season="s", provider="p",
        )
        base.update(row)
        out.append(tuple(base[c.split()[0]] for c in ACTION_DDL.split(", ")))
    return spark.createDataFrame(out, ACTION_DDL)


KINDS = ["pass", "pass", "pass", "clearance", "tackle", "interception", "throw_in", "shot", "dribble"]


def random_rows(seed, n=60, teams=2, games=3):
    rng = random.Random(seed)
    rows, action = [], 0
    for game in range(games):
        team = 1
        for i in range(n):
            if rng.random() < 0.4:
                team = rng.randint(1, teams)
            rows.append(
                dict(
                    game_id=game, period_id=1 if i < n // 2 else 2, time_seconds=float(i * 20),
                    team_id=team, player_id=None if rng.random() < 0.05 else team * 10 + rng.randint(0, 4),
                    action_id=action, type_name=rng.choice(KINDS),
                    result_name=rng.choice(["success", "success", "fail"]),
                    start_x=rng.uniform(0, 105), start_y=rng.uniform(0, 68), end_x=rng.uniform(0, 105),
                    end_y=rng.uniform(0, 68), season="s", provider="p",
                )
            )
            action += 1
    return rows


def game_network(spark):
    """Six passes between three players of team 1 and one clearance of team 2."""
    xs, ys = [20, 40, 60, 25, 45, 65, 80], [30, 34, 40, 30, 34, 40, 20]
    players, times = [10, 20, 30, 10, 20, 30, 99], [0, 300, 600, 1800, 2100, 2400, 2500]
    rows = [
        dict(
            player_id=players[i], time_seconds=float(times[i]), start_x=float(xs[i]), start_y=float(ys[i]),
            end_x=float(xs[i] + 10), end_y=float(ys[i]),
        )
        for i in range(7)
    ]
    rows[6].update(team_id=2, type_name="clearance")
    return rows
