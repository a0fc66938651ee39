"""Queries over the action stream: expressions, recipients, possessions, networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom import schema as S
from pitchloom.functions import expressions as X
from pitchloom.operators import network as N, sequence as Q
from pitchloom.plans.book import Book
from pitchloom.plans.sqlkit import (
    COMPARABLE, CONTEST, DONE, LENGTH, MINUTE, NK, PASS, SET_PIECE, SHOT, WK, r, ratio, with_sql,
    zone,
)
from pitchloom.sources.event_actions import (
    read_actions, read_games, read_table, read_truth,
)

BOOK = Book()
q = BOOK.add


def passes(spark, sf):
    return Q.infer_recipients(read_actions(spark, sf))


def chained(spark, sf):
    return Q.annotate_actions(read_actions(spark, sf))


@q("top_receivers", with_sql("all_edges", """
SELECT target AS player_id, CAST(sum(weight) AS BIGINT) AS passes_received,
  count(*) AS lanes FROM all_edges GROUP BY target ORDER BY passes_received DESC, player_id LIMIT 10"""))
def top_receivers(spark, sf):
    lanes = N.edge_table(passes(spark, sf))
    return (
        lanes.groupBy(F.col("target").alias("player_id"))
        .agg(F.sum("weight").alias("passes_received"), F.count(F.lit(1)).alias("lanes"))
        .orderBy(F.desc("passes_received"), "player_id")
        .limit(10)
    )


@q("action_minute_b1", with_sql("actions", f"""
SELECT game_id, period_id, {r(f'min({MINUTE})', 'first_minute')}, {r(f'max({MINUTE})', 'last_minute')},
  {r(f'avg({MINUTE})', 'mean_minute')} FROM actions GROUP BY game_id, period_id"""))
def action_minute(spark, sf):
    return X.round_report(
        read_actions(spark, sf)
        .withColumn("m", X.action_minute())
        .groupBy("game_id", "period_id")
        .agg(
            F.min("m").alias("first_minute"), F.max("m").alias("last_minute"),
            F.avg("m").alias("mean_minute"),
        )
    )


@q("type_predicates_b2", with_sql("actions", f"""
SELECT season, team_id, count(*) FILTER ({PASS}) AS pass_like, count(*) FILTER ({COMPARABLE}) AS comparable,
  count(*) FILTER ({SET_PIECE}) AS set_piece, count(*) FILTER ({CONTEST}) AS contest,
  count(*) FILTER ({SHOT}) AS shots, count(*) FILTER ({DONE}) AS completed,
  count(*) FILTER ({DONE} AND end_x - start_x > 5) AS progressive
FROM actions GROUP BY season, team_id"""))
def type_predicates(spark, sf):
    return read_actions(spark, sf).groupBy("season", "team_id").agg(
        X.tally(X.is_pass_like()).alias("pass_like"),
        X.tally(X.is_comparable()).alias("comparable"),
        X.tally(X.is_set_piece()).alias("set_piece"),
        X.tally(X.is_contest()).alias("contest"),
        X.tally(X.is_shot()).alias("shots"),
        X.tally(X.is_completed_pass()).alias("completed"),
        X.tally(X.is_progressive()).alias("progressive"),
    )


@q("zone_of_b3", with_sql("actions", f"""
SELECT {zone('start_x')} AS start_zone, {zone('end_x')} AS end_zone, count(*) AS n
FROM actions GROUP BY 1, 2"""))
def zones(spark, sf):
    return (
        read_actions(spark, sf)
        .groupBy(X.zone_of("start_x").alias("start_zone"), X.zone_of("end_x").alias("end_zone"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@q("geometry_b4", with_sql("actions", f"""
SELECT game_id, team_id, {r(f'sum({LENGTH})', 'path_length')}, {r('sum(end_x - start_x)', 'net_dx')},
  {r('max(start_y) - min(start_y)', 'width')},
  {r(f'greatest(-1, least(1, {ratio("sum(end_x - start_x)", f"sum({LENGTH})")}))', 'directness')}
FROM actions GROUP BY game_id, team_id"""))
def geometry(spark, sf):
    net, path = F.sum(X.dx()), F.sum(X.step_length())
    return X.round_report(
        read_actions(spark, sf).groupBy("game_id", "team_id").agg(
            path.alias("path_length"), net.alias("net_dx"),
            (F.max("start_y") - F.min("start_y")).alias("width"),
            X.directness(net, path).alias("directness"),
        )
    )


@q("safe_ratio_b5", with_sql("actions", f"""
SELECT player_id, {r(ratio(f'count(*) FILTER ({SHOT} AND result_name = $$success$$)', f'count(*) FILTER ({SHOT})'), 'conversion')},
  {r(ratio(f'count(*) FILTER ({DONE})', f'count(*) FILTER ({PASS})'), 'completion')}
FROM actions GROUP BY player_id"""))
def safe_ratios(spark, sf):
    return X.round_report(
        read_actions(spark, sf).groupBy("player_id").agg(
            X.safe_ratio(X.tally(X.is_shot() & X.is_success()), X.tally(X.is_shot())).alias(
                "conversion"
            ),
            X.safe_ratio(X.tally(X.is_completed_pass()), X.tally(X.is_pass_like())).alias(
                "completion"
            ),
        )
    )


@q("infer_recipients_c1", with_sql("passes", """
SELECT game_id, action_id, team_id, player_id, recipient_id,
  recipient_id IS NOT NULL AS recipient_confident FROM passes"""))
def infer_recipients(spark, sf):
    return passes(spark, sf).select(
        "game_id", "action_id", "team_id", "player_id", "recipient_id", "recipient_confident"
    )


@q("next_speaker_c1", """
SELECT conv_id, turn, role, coalesce(
  CASE WHEN lead(role, 1) OVER w <> role THEN lead(role, 1) OVER w END,
  CASE WHEN lead(role, 2) OVER w <> role THEN lead(role, 2) OVER w END,
  CASE WHEN lead(role, 3) OVER w <> role THEN lead(role, 3) OVER w END) AS next_actor
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def next_speaker(spark, sf):
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return Q.next_other_speaker(turns, "conv_id", "turn", "role")


@q("role_runs_c3", """
SELECT conv_id, run_id, min(role) AS actor, count(*) AS n_turns, min(turn) AS first_turn FROM (
  SELECT *, CAST(sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run_id FROM (
    SELECT conv_id, turn, role, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role
      THEN 0 ELSE 1 END AS ch FROM conversations)) GROUP BY conv_id, run_id""")
def role_runs(spark, sf):
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return Q.role_runs(turns, "conv_id", "turn", "role")


_SCORED = f"FROM passes JOIN truth USING (original_event_id) WHERE {DONE} AND true_recipient_id IS NOT NULL"


@q("score_recipients_c2", with_sql(["passes", "truth"], f"""
SELECT count(*) AS n, {r('avg(CASE WHEN recipient_id = true_recipient_id THEN 1e0 ELSE 0 END)', 'accuracy')},
  {r('avg(CASE WHEN recipient_id <> true_recipient_id THEN 1e0 ELSE 0 END)', 'wrong')},
  {r('avg(CASE WHEN recipient_id IS NULL THEN 1e0 ELSE 0 END)', 'unresolved')} {_SCORED}"""))
def score_recipients(spark, sf):
    return X.round_report(Q.score_recipients(passes(spark, sf), read_truth(spark, sf)))


_THIN = with_sql(["passes", "truth"], f"""
SELECT count(*) AS n, {r('avg(CASE WHEN recipient_id = true_recipient_id THEN 1e0 ELSE 0 END)', 'accuracy')},
  {r('avg(CASE WHEN recipient_id <> true_recipient_id THEN 1e0 ELSE 0 END)', 'wrong')},
  {r('avg(CASE WHEN recipient_id IS NULL THEN 1e0 ELSE 0 END)', 'unresolved')},
  (SELECT {r('count(*) / count(DISTINCT game_id)', 'a')} FROM passes) AS actions_per_game {_SCORED}""").replace(
    "END AS recipient_id FROM actions", "END AS recipient_id FROM actions WHERE type_name <> 'dribble'"
)


@q("degraded_recipients_c6", _THIN)
def degraded_recipients(spark, sf):
    return X.round_report(
        Q.degraded_recipient_accuracy(read_actions(spark, sf), read_truth(spark, sf))
    )


@q("possessions_c3", with_sql("chained", """
SELECT game_id, action_id, possession_id, possession_team_id FROM chained"""))
def possessions(spark, sf):
    return Q.reconstruct_possessions(read_actions(spark, sf)).select(
        "game_id", "action_id", "possession_id", "possession_team_id"
    )


def _rand_sql(source, a, b, key):
    return f"""(WITH c AS (SELECT {key}, {a} AS a, {b} AS b, count(*) AS n FROM {source} GROUP BY 1, 2, 3),
  x AS (SELECT {key}, sum(n * (n - 1) / 2e0) AS both_, sum(n) AS size FROM c GROUP BY 1),
  p AS (SELECT {key}, sum(n * (n - 1) / 2e0) AS pa FROM (SELECT {key}, a, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
  s AS (SELECT {key}, sum(n * (n - 1) / 2e0) AS pb FROM (SELECT {key}, b, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
  SELECT {key}, coalesce((both_ - pa * pb / nullif(size * (size - 1) / 2e0, 0))
    / nullif((pa + pb) / 2 - pa * pb / nullif(size * (size - 1) / 2e0, 0), 0), 1) AS adjusted_rand
  FROM x JOIN p USING ({key}) JOIN s USING ({key}))"""


def _agreement_sql(source):
    return f"""
SELECT m.game_id, m.n, m.n_chains_ours, m.n_chains_truth, {r('m.j', 'boundary_jaccard')},
  {r('a.adjusted_rand', 'adjusted_rand')}
FROM (SELECT game_id, count(*) AS n, count(*) FILTER (o) AS n_chains_ours, count(*) FILTER (t) AS n_chains_truth,
    count(*) FILTER (o AND t) / count(*) FILTER (o OR t) AS j
  FROM (SELECT game_id, coalesce(lag(possession_id) OVER w <> possession_id, TRUE) AS o,
      coalesce(lag(statsbomb_possession) OVER w <> statsbomb_possession, TRUE) AS t
    FROM {source} WINDOW w AS (PARTITION BY game_id ORDER BY period_id, time_seconds, action_id)) GROUP BY game_id) m
JOIN {_rand_sql(source, 'statsbomb_possession', 'possession_id', 'game_id')} a USING (game_id)"""


@q("score_possessions_c4", with_sql(["chained", "truth"], _agreement_sql(
    "(SELECT * FROM chained JOIN truth USING (original_event_id) WHERE statsbomb_possession IS NOT NULL)")))
def score_possessions(spark, sf):
    rows = chained(spark, sf).join(
        read_truth(spark, sf).where(F.col("statsbomb_possession").isNotNull()),
        "original_event_id",
    )
    return X.round_report(Q.score_possessions(rows))


_REBUILT = with_sql(["truth", "chained"], _agreement_sql(
    "(SELECT * FROM chained JOIN truth USING (original_event_id))")).replace(
    "END AS recipient_id FROM actions",
    "END AS recipient_id FROM (SELECT a.* FROM actions a JOIN truth t USING (original_event_id) "
    "WHERE t.statsbomb_possession IS NOT NULL) actions",
)


@q("possession_agreement_c5", _REBUILT)
def possession_agreement(spark, sf):
    return X.round_report(
        Q.possession_agreement(read_actions(spark, sf), read_truth(spark, sf))
    )


@q("player_minutes_c7", with_sql("actions", f"""
SELECT game_id, team_id, player_id, {r(f'min({MINUTE})', 'first_minute')}, {r(f'max({MINUTE})', 'last_minute')},
  {r(f'max({MINUTE}) - min({MINUTE})', 'minutes_played')} FROM actions WHERE player_id IS NOT NULL GROUP BY 1, 2, 3"""))
def player_minutes(spark, sf):
    return X.round_report(Q.player_minutes(read_actions(spark, sf)))


@q("derive_goals_c8", with_sql("goals", f"""
SELECT game_id, acting_team_id, scoring_team_id, {r('minute', 'minute')} FROM goals"""))
def derive_goals(spark, sf):
    return X.round_report(Q.derive_goals(read_actions(spark, sf)))


_CHECK = """(SELECT g.game_id, any_value(g.home_score) AS hs, any_value(g.away_score) AS as_,
  count(*) FILTER (s.scoring_team_id = g.home_team_id) AS dh, count(*) FILTER (s.scoring_team_id = g.away_team_id) AS da
  FROM outcomes g LEFT JOIN goals s USING (game_id) GROUP BY g.game_id)"""


@q("validate_goals_c9", with_sql(["goals", "outcomes"], f"""
SELECT count(*) AS checked, count(*) FILTER (hs = dh AND as_ = da) AS exact,
  {r('avg(CASE WHEN hs = dh AND as_ = da THEN 1e0 ELSE 0 END)', 'exact_rate')} FROM {_CHECK}"""))
def validate_goals(spark, sf):
    return X.round_report(Q.validate_goals(read_actions(spark, sf), read_games(spark, sf)))


@q("goal_mismatches_c9", with_sql(["goals", "outcomes"], f"""
SELECT game_id, hs AS home_score, as_ AS away_score, dh AS derived_home, da AS derived_away
FROM {_CHECK} WHERE NOT (hs = dh AND as_ = da)"""))
def goal_mismatches(spark, sf):
    return (
        Q.goal_check(read_actions(spark, sf), read_games(spark, sf))
        .where(~F.col("exact")).drop("exact")
    )


@q("shot_possessions_c10", with_sql("chained", f"""
SELECT DISTINCT game_id, possession_id FROM chained WHERE {SHOT}"""))
def shot_possessions(spark, sf):
    return Q.shot_possessions(Q.reconstruct_possessions(read_actions(spark, sf)))


_NODE_COLS = f"""{r('mean_x', 'mean_x')}, {r('mean_y', 'mean_y')}, {r('spread_x', 'spread_x')},
  {r('spread_y', 'spread_y')}, touches, actions_all_types, passes_attempted, passes_completed"""
_EDGE_COLS = f"source, target, weight, {r('mean_length', 'mean_length')}, {r('mean_dx', 'mean_dx')}"


@q("node_table_d1", with_sql("all_nodes", f"SELECT {NK}, player_id, {_NODE_COLS} FROM all_nodes"))
def node_table(spark, sf):
    return X.round_report(N.node_table(read_actions(spark, sf)))


@q("edge_table_d2", with_sql("all_edges", f"SELECT {NK}, {_EDGE_COLS} FROM all_edges"))
def edge_table(spark, sf):
    return X.round_report(N.edge_table(passes(spark, sf)))


@q("eligible_players_d3", with_sql("eligible", "SELECT * FROM eligible"))
def eligible(spark, sf):
    return N.eligible_players(read_actions(spark, sf))


@q("match_network_nodes_d4", with_sql("nodes", f"SELECT {NK}, player_id, {_NODE_COLS} FROM nodes"))
def match_nodes(spark, sf):
    return X.round_report(N.match_networks(passes(spark, sf))[0])


@q("match_network_edges_d4", with_sql("edges", f"SELECT {NK}, {_EDGE_COLS} FROM edges"))
def match_edges(spark, sf):
    return X.round_report(N.match_networks(passes(spark, sf))[1])


@q("windowed_nodes_d5", with_sql("wnodes", f"SELECT {WK}, player_id, {_NODE_COLS} FROM wnodes"))
def windowed_nodes(spark, sf):
    return X.round_report(N.windowed_networks(passes(spark, sf))[0])


@q("windowed_edges_d5", with_sql("wedges", f"SELECT {WK}, {_EDGE_COLS} FROM wedges"))
def windowed_edges(spark, sf):
    return X.round_report(N.windowed_networks(passes(spark, sf))[1])


@q("flattened_networks_d6", with_sql(["nodes", "edges", "wnodes", "wedges"], """
SELECT season, 'full_nodes' AS table_name, count(*) AS n_rows FROM nodes GROUP BY season
UNION ALL SELECT season, 'full_edges', count(*) FROM edges GROUP BY season
UNION ALL SELECT season, 'windowed_nodes', count(*) FROM wnodes GROUP BY season
UNION ALL SELECT season, 'windowed_edges', count(*) FROM wedges GROUP BY season"""))
def flattened_networks(spark, sf):
    rows = passes(spark, sf)
    full, windowed = N.match_networks(rows), N.windowed_networks(rows)
    tables = {
        "full_nodes": full[0], "full_edges": full[1],
        "windowed_nodes": windowed[0], "windowed_edges": windowed[1],
    }
    parts = [
        df.groupBy("season").agg(F.count(F.lit(1)).alias("n_rows")).select(
            "season", F.lit(name).alias("table_name"), "n_rows"
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@q("season_network_nodes_d7", with_sql("nodes", f"""
SELECT season, provider, team_id, player_id, {r('avg(mean_x)', 'mean_x')}, {r('avg(mean_y)', 'mean_y')},
  {r('avg(spread_x)', 'spread_x')}, {r('avg(spread_y)', 'spread_y')}, CAST(sum(touches) AS BIGINT) AS touches,
  CAST(sum(actions_all_types) AS BIGINT) AS actions_all_types, CAST(sum(passes_attempted) AS BIGINT) AS passes_attempted,
  CAST(sum(passes_completed) AS BIGINT) AS passes_completed FROM nodes GROUP BY 1, 2, 3, 4"""))
def season_nodes(spark, sf):
    return X.round_report(N.season_network(*N.match_networks(passes(spark, sf)))[0])


@q("season_network_edges_d7", with_sql("edges", f"""
SELECT season, provider, team_id, source, target, CAST(sum(weight) AS BIGINT) AS weight,
  {r('avg(mean_length)', 'mean_length')}, {r('avg(mean_dx)', 'mean_dx')} FROM edges GROUP BY 1, 2, 3, 4, 5"""))
def season_edges(spark, sf):
    return X.round_report(N.season_network(*N.match_networks(passes(spark, sf)))[1])


@q("network_size_summary_d8", with_sql(["nodes", "edges"], f"""
SELECT season, count(*) AS networks, CAST(sum(n) AS BIGINT) AS node_rows, CAST(sum(coalesce(m, 0)) AS BIGINT) AS edge_rows,
  {r('avg(n)', 'mean_nodes')}, {r('avg(coalesce(m, 0))', 'mean_edges')}
FROM (SELECT {NK}, count(*) AS n FROM nodes GROUP BY {NK})
LEFT JOIN (SELECT {NK}, count(*) AS m FROM edges GROUP BY {NK}) USING ({NK}) GROUP BY season"""))
def size_summary(spark, sf):
    return X.round_report(N.network_size_summary(*N.match_networks(passes(spark, sf))))


@q("window_bounds_d5", with_sql(["windows", "actions"], f"""
SELECT window_index, {r('low', 'low')}, {r('high', 'high')}, count(action_id) AS n_actions
FROM windows LEFT JOIN actions ON {MINUTE} >= low AND {MINUTE} < high GROUP BY 1, 2, 3"""))
def window_counts(spark, sf):
    counts = (
        N.assign_windows(read_actions(spark, sf))
        .groupBy("window_index").agg(F.count(F.lit(1)).alias("n_actions"))
    )
    return N.window_bounds(spark).join(counts, "window_index", "left").fillna(0, ["n_actions"])
