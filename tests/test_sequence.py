import pytest
from pyspark.sql import functions as F

import frames
from pitchloom import schema as S
from pitchloom.operators import sequence as Q
from pitchloom.operators.ordering import POSITION, block_neighbours, block_running, dense_position, prefix_totals


def receivers(spark, rows):
    out = Q.infer_recipients(frames.actions(spark, rows)).orderBy("action_id").collect()
    return [r["recipient_id"] for r in out]


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([dict(player_id=10), dict(player_id=20), dict(player_id=30)], [20, 30, None]),
        ([dict(player_id=10, result_name="fail"), dict(player_id=99, team_id=2)], [None, None]),
        ([dict(player_id=10)] + [dict(player_id=p, team_id=2) for p in (91, 92, 93)], [None, 92, 93, None]),
        ([dict(player_id=10), dict(player_id=91, team_id=2, type_name="interception"), dict(player_id=20)], [20, None, None]),
        ([dict(player_id=10)] + [dict(player_id=p, team_id=2) for p in (91, 92, 93)] + [dict(player_id=20)], [None, 92, 93, None, None]),
        ([dict(player_id=10), dict(player_id=20, period_id=2)], [None, None]),
        ([dict(player_id=10), dict(player_id=10, type_name="dribble"), dict(player_id=20)], [20, None, None]),
        ([dict(player_id=10, type_name="clearance"), dict(player_id=20)], [None, None]),
        ([dict(player_id=None), dict(player_id=20)], [20, None]),
    ],
)
def test_recipients(spark, rows, expected):
    assert receivers(spark, rows) == expected


def test_recipients_empty(spark):
    out = Q.infer_recipients(frames.actions(spark, []))
    assert {"recipient_id", "recipient_confident"} <= set(out.columns) and out.count() == 0


def fold_receivers(rows):
    """Row-by-row reading of the rule."""
    found = {}
    for i, row in enumerate(rows):
        if row["type_name"] in S.PASS_LIKE_TYPES and row["result_name"] == "success":
            for later in rows[i + 1 : i + 4]:
                if (
                    later["game_id"] == row["game_id"] and later["team_id"] == row["team_id"]
                    and later["period_id"] == row["period_id"] and later["player_id"] is not None
                    and later["player_id"] != row["player_id"]
                ):
                    found[row["action_id"]] = later["player_id"]
                    break
    return found


def fold_possessions(rows, min_hold):
    """Left-to-right reading of the segmentation of one game."""
    owner = [r["team_id"] for r in rows]
    for i in range(1, len(rows) - 1):
        if rows[i]["type_name"] in S.CONTEST_TYPES and owner[i - 1] == owner[i + 1] != owner[i]:
            owner[i] = owner[i - 1]
    cuts = [0] + [i for i in range(1, len(owner)) if owner[i] != owner[i - 1]] + [len(owner)]
    for a, b in zip(cuts, cuts[1:]):
        if b - a < min_hold and a > 0 and b < len(owner) and owner[a - 1] == owner[b]:
            owner[a:b] = [owner[a - 1]] * (b - a)
    out, chain = {}, -1
    for i, row in enumerate(rows):
        if i == 0 or owner[i] != owner[i - 1] or row["period_id"] != rows[i - 1]["period_id"] or row["type_name"] in S.POSSESSION_SET_PIECES:
            chain += 1
        out[row["action_id"]] = (chain, owner[i])
    return out


@pytest.mark.parametrize("limit, block", [(10**6, 10**6), (10, 7)])
@pytest.mark.parametrize("min_hold, teams", [(2, 2), (3, 3)])
def test_streams_against_fold(spark, limit, block, min_hold, teams):
    """Both the window plan and the block plan of oversized matches equal the plain reading."""
    rows = frames.random_rows(min_hold * 7 + teams, teams=teams)
    df = Q.annotate_actions(frames.actions(spark, rows), min_hold=min_hold, limit=limit, block=block)
    got = {r["action_id"]: r for r in df.collect()}
    assert len(got) == len(rows)
    wanted = fold_receivers(rows)
    assert {k: r["recipient_id"] for k, r in got.items() if r["recipient_id"] is not None} == wanted
    chains = {}
    for game in range(3):
        chains.update(fold_possessions([r for r in rows if r["game_id"] == game], min_hold))
    assert {k: (r["possession_id"], r["possession_team_id"]) for k, r in got.items()} == chains


def test_only_hot_matches_are_cut(spark):
    rows = frames.random_rows(3, n=20, games=2) + [
        dict(r, game_id=9, action_id=1000 + r["action_id"]) for r in frames.random_rows(5, n=90, games=1)
    ]
    mixed = Q.annotate_actions(frames.actions(spark, rows), limit=50, block=8)
    plain = Q.annotate_actions(frames.actions(spark, rows))
    columns = ["action_id", "recipient_id", "possession_id", "possession_team_id"]
    assert mixed.select(columns).exceptAll(plain.select(columns)).count() == 0
    assert mixed.count() == len(rows)


def test_possession_examples(spark):
    def ids(rows):
        out = Q.reconstruct_possessions(frames.actions(spark, rows)).orderBy("action_id").collect()
        return [r["possession_id"] for r in out]

    two = dict(team_id=2)
    assert ids([{}, {}, dict(type_name="throw_in"), two, two]) == [0, 0, 1, 2, 2]
    assert ids([{}, dict(team_id=2, type_name="clearance"), {}]) == [0, 0, 0]
    assert ids([{}, dict(period_id=2)]) == [0, 1]


def test_blocks_helpers(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"), (F.col("id") % 5).alias("v"))
    placed = dense_position(df, ["k"], ["o"])
    assert placed.where(F.col(POSITION) != F.floor(F.col("o") / 2)).isEmpty()
    near = block_neighbours(placed, ["k"], {"b": ("o", -1), "a": ("o", 2)}, block=7)
    assert near.count() == 100
    assert near.where((F.col("b") != F.col("o") - 2) | (F.col("a") != F.col("o") + 4)).isEmpty()
    run = block_running(placed, ["k"], {"s": (F.col("v"), "sum"), "m": (F.col("v"), "max")}, block=7)
    totals = {}
    for row in run.orderBy("o").collect():
        s, m = totals.get(row["k"], (0, 0))
        totals[row["k"]] = (s + row["v"], max(m, row["v"]))
        assert (row["s"], row["m"]) == totals[row["k"]]


def test_prefix_totals(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 1), ("a", 2, 2), ("a", 4, 9), ("b", 2, 3)], "k string, d int, v long")
    got = {(r["k"], r["d"]): r["t"] for r in prefix_totals(df, ["k"], "d", {"t": "v"}).collect()}
    assert got == {("a", 1): 0, ("a", 2): 6, ("a", 4): 8, ("b", 2): 0}


def test_goals(spark):
    rows = [
        dict(type_name="shot", result_name="success", time_seconds=600.0),
        dict(type_name="shot_penalty", result_name="success", time_seconds=300.0, period_id=2, team_id=2),
        dict(type_name="bad_touch", result_name="owngoal", time_seconds=900.0, period_id=2),
        dict(type_name="shot", result_name="fail"),
    ]
    got = sorted((r["scoring_team_id"], r["minute"]) for r in Q.derive_goals(frames.actions(spark, rows)).collect())
    assert got == [(1, 10.0), (2, 50.0), (2, 60.0)]


def test_own_goal_without_opponent_stays_unknown(spark):
    rows = [dict(type_name="bad_touch", result_name="owngoal")]
    assert Q.derive_goals(frames.actions(spark, rows)).first()["scoring_team_id"] is None


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (2, 6)], "a int, b int")
    assert Q.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(1.0)
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 1)], "a int, b int")
    assert Q.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(0.0)
