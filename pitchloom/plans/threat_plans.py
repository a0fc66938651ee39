"""Queries on expected threat, chains, node features, match state, folds and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom import schema as S
from pitchloom.functions import expressions as X
from pitchloom.functions.hashing import mix, mix_sql
from pitchloom.operators import (
    chains as C, features as FE, graph as G, identity as I, network as N, sequence as Q,
    splits as SP, state as ST, threat as TH,
)
from pitchloom.plans.book import Book
from pitchloom.plans.graph_plans import directory, teams_of
from pitchloom.plans.sqlkit import (
    CTES, DONE, MINUTE, NK, OK, SHOT, WK, quoted, r, ratio, with_sql, zone,
)
from pitchloom.plans.stream_plans import chained, passes
from pitchloom.runtime import staged
from pitchloom.sources.event_actions import read_actions, read_games, read_lineup, read_table

BOOK = Book()
q = BOOK.add


def split(spark, sf):
    return SP.temporal_split(read_games(spark, sf), "matchweek")


def train_games(spark, sf):
    return split(spark, sf).where(F.col("fold") == "train")


def rated(spark, sf):
    """Chained actions rated by a surface fitted on the training fold."""
    actions = chained(spark, sf)
    train = read_actions(spark, sf).join(train_games(spark, sf), "game_id", "left_semi")
    # The surface needs no recipients or chains, so it is fitted on the plain actions.
    return TH.rate_actions(actions, TH.fit_surface(train))


@q("threat_surface_f1", with_sql("surface", f"SELECT cell, {r('xt', 'xt')} FROM surface"))
def surface(spark, sf):
    train = read_actions(spark, sf).join(train_games(spark, sf), "game_id", "left_semi")
    return X.round_report(TH.fit_surface(train))


@q("fit_xthreat_f1", with_sql("rated", f"SELECT game_id, action_id, {r('xt_value', 'xt_value')} FROM rated"))
def fit_xthreat(spark, sf):
    table = TH.fit_xthreat(read_actions(spark, sf), train_games(spark, sf))
    return X.round_report(table.select("game_id", "action_id", "xt_value"))


CTES["player_xt"] = (("rated",), f"""
SELECT {NK}, player_id, sum(greatest(coalesce(xt_value, 0), 0)) AS x FROM rated
WHERE player_id IS NOT NULL GROUP BY {NK}, player_id""")
CTES["xt_generated"] = (("player_xt",), f"""
SELECT {NK}, player_id, {ratio('x', f'sum(x) OVER (PARTITION BY {NK})')} AS xt_generated FROM player_xt""")


@q("player_threat_f2", with_sql("xt_generated", f"SELECT {NK}, player_id, {r('xt_generated', 'xt_generated')} FROM xt_generated"))
def player_threat(spark, sf):
    return X.round_report(TH.player_threat(rated(spark, sf)))


def _lanes(source, keys):
    return f"""
SELECT {keys}, player_id AS source, recipient_id AS target, sum(greatest(coalesce(xt_value, 0), 0)) AS xt_weight,
  count(*) AS weight FROM {source} WHERE {DONE} AND recipient_id IS NOT NULL AND player_id IS NOT NULL
  AND player_id <> recipient_id GROUP BY {keys}, player_id, recipient_id"""


CTES["lanes"] = (("rated",), _lanes("rated", NK))
CTES["wlanes"] = (("placed_rated",), _lanes("placed_rated", WK))


@q("threat_lanes_f3", with_sql("lanes", f"SELECT {NK}, source, target, {r('xt_weight', 'xt_weight')}, weight FROM lanes"))
def threat_lanes(spark, sf):
    return X.round_report(TH.threat_lanes(rated(spark, sf)))


@q("windowed_threat_lanes_f3", with_sql("wlanes", f"SELECT {WK}, source, target, {r('xt_weight', 'xt_weight')}, weight FROM wlanes"))
def windowed_lanes(spark, sf):
    return X.round_report(TH.threat_lanes(N.assign_windows(rated(spark, sf)), S.WINDOW_KEYS))


CTES["xt_edges"] = (("edges", "lanes"), f"""
SELECT e.*, l.xt_weight FROM edges e JOIN lanes l USING ({NK}, source, target)""")


@q("attach_threat_f4", with_sql("xt_edges", f"""
SELECT {NK}, source, target, weight, {r('mean_length', 'mean_length')}, {r('mean_dx', 'mean_dx')},
  {r('xt_weight', 'xt_weight')} FROM xt_edges"""))
def attach_threat(spark, sf):
    rows = staged(rated(spark, sf))
    return X.round_report(TH.attach_threat(N.match_networks(rows)[1], rows))


CTES["involved"] = (("rated",), f"""
SELECT {NK}, player_id, {ratio('s', 'g')} AS shot_involvement, {ratio('s', 't')} AS shot_conversion FROM (
  SELECT {NK}, player_id, count(*) AS t, count(*) FILTER (shot) AS s FROM (
    SELECT DISTINCT {NK}, possession_id, player_id, coalesce(shot, FALSE) AS shot FROM rated
    LEFT JOIN (SELECT DISTINCT game_id, possession_id, TRUE AS shot FROM rated WHERE {SHOT}) USING (game_id, possession_id)
    WHERE player_id IS NOT NULL) GROUP BY {NK}, player_id)
LEFT JOIN (SELECT {NK}, count(*) AS g FROM (SELECT DISTINCT {NK}, possession_id FROM rated
  SEMI JOIN (SELECT DISTINCT game_id, possession_id FROM rated WHERE {SHOT}) USING (game_id, possession_id)
  WHERE player_id IS NOT NULL) GROUP BY {NK}) USING ({NK})""")


@q("shot_involvement_f5", with_sql("involved", f"SELECT {NK}, player_id, {r('shot_involvement', 'shot_involvement')} FROM involved"))
def shot_involvement(spark, sf):
    return X.round_report(C.shot_chain_involvement(chained(spark, sf)).drop("shot_conversion"))


@q("shot_conversion_f6", with_sql("involved", f"SELECT {NK}, player_id, {r('shot_conversion', 'shot_conversion')} FROM involved"))
def shot_conversion(spark, sf):
    return X.round_report(C.shot_chain_involvement(chained(spark, sf)).drop("shot_involvement"))


_FEATURE_SQL = ", ".join(
    "n_actions" if c == "n_actions" else r(c, c) for c in S.CHAIN_FEATURES
)


@q("chain_table_f7", with_sql("chains", f"""
SELECT game_id, possession_id, season, provider, team_id, period_id, {r('start_minute', 'start_minute')},
  {r('end_minute', 'end_minute')}, {_FEATURE_SQL}, coalesce(shot, FALSE) AS ends_in_shot,
  {zone('start_x')} AS start_zone, {zone('end_x')} AS end_zone FROM chains"""))
def chain_table(spark, sf):
    return X.round_report(C.chain_table(rated(spark, sf)))


_TOKEN = "list_concat([" + ", ".join(
    f"CASE WHEN type_name = '{t}' THEN 1e0 ELSE 0e0 END" for t in C.TOKEN_VOCABULARY
) + "], [start_x / 105e0, start_y / 68e0, (end_x - start_x) / 105e0, (end_y - start_y) / 68e0, " + (
    f"CASE WHEN {OK} THEN 1e0 ELSE 0e0 END])"
)


@q("chain_sequences_f8", with_sql("chains", f"""
SELECT game_id, possession_id, length, token_sum, first_type FROM (
  SELECT game_id, possession_id, count(*) AS length, round(sum(list_sum({_TOKEN}) * n), 4) + 0 AS token_sum,
    arg_min(list_position([{quoted(C.TOKEN_VOCABULARY)}], type_name), n) AS first_type
  FROM (SELECT a.*, row_number() OVER (PARTITION BY game_id, possession_id ORDER BY period_id, time_seconds, action_id) AS n
    FROM rated a SEMI JOIN chains USING (game_id, possession_id)
    WHERE type_name IN ({quoted(S.PROVIDER_COMPARABLE_TYPES)})) WHERE n <= 12 GROUP BY 1, 2)"""))
def chain_sequences(spark, sf):
    actions = chained(spark, sf)
    table = C.chain_sequences(actions, C.chain_table(actions))
    width = C.TOKEN_WIDTH
    steps = F.sequence(F.lit(1), F.lit(S.CHAIN_TOKENS))
    weighted = F.transform(
        steps,
        lambda n: n * F.aggregate(
            F.slice("tokens", (n - 1) * width + 1, width), F.lit(0.0), lambda a, v: a + v.cast("double")
        ),
    )
    return table.select(
        "game_id", "possession_id", "length",
        (F.round(F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v), 4) + 0.0).alias("token_sum"),
        F.array_position(F.slice("tokens", 1, len(C.TOKEN_VOCABULARY)), F.lit(1.0).cast("float")).alias("first_type"),
    )


def labelled_chains(spark, sf):
    """Chains with a fixed, checkable label in place of a fitted cluster."""
    table = C.chain_table(rated(spark, sf))
    return table.withColumn(
        "cluster", (mix("game_id", "possession_id", seed=5) % 3 * 2 + F.floor(F.col("start_x") / 60.0)).cast("long")
    )


CTES["labelled"] = (("chains",), f"""
SELECT *, coalesce(shot, FALSE) AS ends_in_shot,
  CAST({mix_sql('game_id', 'possession_id', seed=5)} % 3 * 2 + floor(start_x / 60e0) AS BIGINT) AS cluster FROM chains""")
CTES["profile"] = (("labelled",), "SELECT cluster, count(*) AS n_chains, " + ", ".join(
    f"avg(CAST({c} AS DOUBLE)) AS {name}" for name, c in C.PROFILE_MEANS.items()) + " FROM labelled GROUP BY cluster")


def _pct(column):
    return f"((rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2e0) / count(*) OVER ())"


CTES["named"] = (("profile",), f"""
SELECT *, (CASE WHEN stem = '' THEN 'mixed' ELSE stem END) || ' from ' || {zone('start_x')} || ' third'
  || CASE WHEN px >= 0.85 THEN ', high threat' ELSE '' END AS label FROM (
  SELECT *, concat_ws(' ', CASE WHEN set_piece > 0.6 THEN 'set-piece' WHEN set_piece < 0.2 THEN 'open-play' END,
    CASE WHEN pl >= 0.75 THEN 'long' WHEN pl <= 0.25 THEN 'brief' END,
    CASE WHEN pd >= 0.75 THEN 'direct' WHEN pd <= 0.25 THEN 'lateral' END) AS stem FROM (
    SELECT *, {_pct('n_actions')} AS pl, {_pct('directness')} AS pd, {_pct('xt_gain')} AS px FROM profile))""")


@q("cluster_profiles_f9", with_sql("named", "SELECT cluster, n_chains, " + ", ".join(
    r(n, n, 8) for n in C.PROFILE_MEANS) + ", " + r("n_chains / sum(n_chains) OVER ()", "share_of_chains", 8) + " FROM named"))
def cluster_profiles(spark, sf):
    return C.cluster_profiles(labelled_chains(spark, sf), digits=8).drop("label")


@q("name_clusters_f10", with_sql("named", "SELECT cluster, label FROM named"))
def name_clusters(spark, sf):
    return C.cluster_profiles(labelled_chains(spark, sf)).select("cluster", "label")


# --- node features -----------------------------------------------------------------------


def _shares(source, keys):
    over = f"OVER (PARTITION BY {keys})"
    return f"""
SELECT {keys}, player_id, mean_x, mean_y, spread_x, spread_y, passes_attempted, passes_completed,
  {ratio('degree_out', f'greatest(count(*) {over} - 1, 1)')} AS degree_out_norm,
  {ratio('degree_in', f'greatest(count(*) {over} - 1, 1)')} AS degree_in_norm,
  {ratio('strength_out', f'sum(strength_out) {over}')} AS strength_out_norm,
  {ratio('strength_in', f'sum(strength_in) {over}')} AS strength_in_norm,
  {ratio('degree_out', f'sum(degree_out) {over}')} AS edge_share_out,
  {ratio('degree_in', f'sum(degree_in) {over}')} AS edge_share_in,
  {ratio('passes_completed', 'passes_attempted')} AS pass_completion_rate,
  {ratio('touches', f'sum(touches) {over}')} AS touches,
  progression_made, progression_received, pass_length_made, progressive_share FROM {source}"""


CTES["shares"] = (("features",), _shares("features", NK))
CTES["wshares"] = (("wfeatures",), _shares("wfeatures", WK))
_VOLUME = [c for c in S.TOPOLOGY_FEATURES if not c.startswith("passes_")]


@q("node_volume_shares_f11", with_sql("shares", f"SELECT {NK}, player_id, {', '.join(r(c, c) for c in _VOLUME)} FROM shares"))
def volume_shares(spark, sf):
    frame = FE.node_features(*N.match_networks(passes(spark, sf)))
    return X.round_report(frame.select(*S.NETWORK_KEYS, "player_id", *_VOLUME))


@q("direction_features_f12", with_sql("shares", f"SELECT {NK}, player_id, {', '.join(r(c, c) for c in S.DIRECTION_FEATURES)} FROM shares"))
def direction(spark, sf):
    frame = FE.node_features(*N.match_networks(passes(spark, sf)))
    return X.round_report(frame.select(*S.NETWORK_KEYS, "player_id", *S.DIRECTION_FEATURES))


CTES["node_threat"] = (("xt_generated", "involved"), f"""
SELECT {NK}, player_id, coalesce(xt_generated, 0) AS xt_generated, coalesce(shot_involvement, 0) AS shot_involvement,
  coalesce(shot_conversion, 0) AS shot_conversion FROM xt_generated FULL JOIN involved USING ({NK}, player_id)""")
CTES["threat_shares"] = (("nodes", "xt_edges", "node_threat"), f"""
SELECT n.{NK.replace(', ', ', n.')}, n.player_id, coalesce(t.xt_generated, 0) AS xt_generated,
  coalesce(t.shot_involvement, 0) AS shot_involvement, coalesce(t.shot_conversion, 0) AS shot_conversion,
  {ratio('coalesce(i.x, 0)', f'sum(i.x) OVER (PARTITION BY {NK})')} AS xt_strength_in_norm,
  {ratio('coalesce(o.x, 0)', f'sum(o.x) OVER (PARTITION BY {NK})')} AS xt_strength_out_norm
FROM nodes n LEFT JOIN node_threat t USING ({NK}, player_id)
LEFT JOIN (SELECT {NK}, target AS player_id, sum(xt_weight) AS x FROM xt_edges GROUP BY {NK}, target) i USING ({NK}, player_id)
LEFT JOIN (SELECT {NK}, source AS player_id, sum(xt_weight) AS x FROM xt_edges GROUP BY {NK}, source) o USING ({NK}, player_id)""")
_THREAT = (*S.THREAT_FEATURES, *S.CONVERSION_FEATURES)


def full_network(spark, sf):
    """(node features with threat, edges with threat) of every network; the edges are worked out once."""
    rows = staged(rated(spark, sf))
    nodes, edges = N.match_networks(rows)
    edges = staged(TH.attach_threat(edges, rows, check=False))
    threat = C.node_threat_table(TH.player_threat(rows), C.shot_chain_involvement(rows))
    return FE.node_features(nodes, edges, node_threat=threat, check=False), edges


def full_features(spark, sf):
    return full_network(spark, sf)[0]


@q("threat_features_f13", with_sql("threat_shares", f"SELECT {NK}, player_id, {', '.join(r(c, c) for c in _THREAT)} FROM threat_shares"))
def threat_features(spark, sf):
    return X.round_report(full_features(spark, sf).select(*S.NETWORK_KEYS, "player_id", *_THREAT))


@q("window_features_f14", with_sql("wshares", f"""
SELECT {WK}, player_id, {', '.join(r(c, c) for c in (*_VOLUME, *S.DIRECTION_FEATURES))} FROM wshares"""))
def window_features(spark, sf):
    frame = FE.window_features(*N.windowed_networks(passes(spark, sf)))
    return X.round_report(frame.select(*S.WINDOW_KEYS, "player_id", *_VOLUME, *S.DIRECTION_FEATURES))


_HOP = ("strength_out_norm", "progression_made")
CTES["hop1"] = (("shares", "edges"), f"""
SELECT s.{NK.replace(', ', ', s.')}, s.player_id, {', '.join('s.' + c for c in _HOP)},
  {', '.join(f'coalesce(avg(p.{c}), 0) AS {c}_hop1' for c in _HOP)}
FROM shares s LEFT JOIN edges e ON e.game_id = s.game_id AND e.team_id = s.team_id AND e.target = s.player_id
LEFT JOIN shares p ON p.game_id = s.game_id AND p.team_id = s.team_id AND p.player_id = e.source
GROUP BY ALL""")
CTES["hop2"] = (("hop1", "edges"), f"""
SELECT s.{NK.replace(', ', ', s.')}, s.player_id, {', '.join('s.' + c for c in _HOP)},
  {', '.join(f's.{c}_hop1' for c in _HOP)}, {', '.join(f'coalesce(avg(p.{c}_hop1), 0) AS {c}_hop2' for c in _HOP)}
FROM hop1 s LEFT JOIN edges e ON e.game_id = s.game_id AND e.team_id = s.team_id AND e.target = s.player_id
LEFT JOIN hop1 p ON p.game_id = s.game_id AND p.team_id = s.team_id AND p.player_id = e.source
GROUP BY ALL""")


@q("neighbour_mean_f15", with_sql("hop2", f"""
SELECT {NK}, player_id, {', '.join(r(c + h, c + h, 9) for h in ('', '_hop1', '_hop2') for c in _HOP)} FROM hop2"""))
def neighbour_mean(spark, sf):
    nodes, edges = N.match_networks(passes(spark, sf))
    frame = FE.node_features(nodes, edges, check=False)
    return X.round_report(FE.neighbour_means(frame, edges, _HOP), 9)


CTES["pooled"] = (("wshares",), f"SELECT {WK}, {', '.join(f'avg({c}) AS {c}' for c in _HOP)} FROM wshares GROUP BY {WK}")


@q("network_pool_f15", with_sql("pooled", f"SELECT {WK}, {', '.join(r(c, c) for c in _HOP)} FROM pooled"))
def network_pool(spark, sf):
    frame = FE.window_features(*N.windowed_networks(passes(spark, sf)), check=False)
    return X.round_report(FE.pooled_networks(frame, _HOP))


def states(spark, sf):
    rows = staged(rated(spark, sf))
    outcomes = ST.match_outcomes(read_games(spark, sf))
    return ST.state_table(rows, outcomes, *N.windowed_networks(rows))


@q("match_sequence_f16", with_sql(["pooled", "outcomes", "windows"], f"""
SELECT game_id, outcome_index, count(*) AS n_steps, {r('sum(coalesce(h.strength_out_norm, 0) * (window_index + 1))', 'home_sum')},
  {r('sum(coalesce(a.progression_made, 0) * (window_index + 1))', 'away_sum')}
FROM outcomes o CROSS JOIN windows w
LEFT JOIN (SELECT game_id, team_id AS home_team_id, window_index, strength_out_norm FROM pooled) h USING (game_id, home_team_id, window_index)
LEFT JOIN (SELECT game_id, team_id AS away_team_id, window_index, progression_made FROM pooled) a USING (game_id, away_team_id, window_index)
GROUP BY 1, 2"""))
def match_sequence(spark, sf):
    rows = passes(spark, sf)
    outcomes = ST.match_outcomes(read_games(spark, sf))
    nodes, edges = N.windowed_networks(rows)
    pooled = FE.pooled_networks(FE.window_features(nodes, edges, check=False), _HOP)
    steps = FE.match_sequences(ST.state_table(rows, outcomes, nodes, edges), pooled, outcomes, _HOP)

    def total(field, at):
        return F.aggregate(
            "steps", F.lit(0.0), lambda acc, s: acc + s[field][at] * (s["window_index"] + 1)
        )

    return X.round_report(
        steps.select(
            "game_id", "outcome_index", F.size("steps").cast("long").alias("n_steps"),
            total("home", 0).alias("home_sum"), total("away", 1).alias("away_sum"),
        )
    )


@q("node_threat_f17", with_sql("node_threat", f"""
SELECT {NK}, player_id, {r('xt_generated', 'xt_generated')}, {r('shot_involvement', 'shot_involvement')},
  {r('shot_conversion', 'shot_conversion')} FROM node_threat"""))
def node_threat(spark, sf):
    rows = staged(rated(spark, sf))
    return X.round_report(
        C.node_threat_table(TH.player_threat(rows), C.shot_chain_involvement(rows))
    )


_ROLE_INDEX = "CAST(list_position(['GK', 'DEF', 'MID', 'FWD'], coarse_role) - 1 AS BIGINT) AS role_index"


@q("role_features_f18", with_sql(["shares", "threat_shares", "lineup"], f"""
SELECT {NK}, player_id, coarse_role, {_ROLE_INDEX}, {r('mean_x', 'mean_x')}, {r('strength_in_norm', 'strength_in_norm')},
  {r('progressive_share', 'progressive_share')}, {r('t.xt_generated', 'xt_generated')}
FROM shares JOIN threat_shares t USING ({NK}, player_id) JOIN lineup USING (season, provider, player_id)"""))
def role_features(spark, sf):
    frame = FE.role_features(full_features(spark, sf), directory(spark, sf))
    return X.round_report(
        frame.select(
            *S.NETWORK_KEYS, "player_id", "coarse_role", "role_index", "mean_x", "strength_in_norm",
            "progressive_share", "xt_generated",
        )
    )


# --- match state -------------------------------------------------------------------------

CTES["grid"] = ((), "SELECT CAST(i AS BIGINT) AS window_index, i * 5e0 + 15 AS t FROM range(16) x(i)")
CTES["upto"] = (("rated", "grid"), f"""
SELECT game_id, team_id, window_index, count(*) FILTER ({SHOT}) AS shots,
  count(*) FILTER (type_name IN ({quoted(S.PASS_LIKE_TYPES)})) AS passes,
  {ratio(f'count(*) FILTER ({DONE})', f'count(*) FILTER (type_name IN ({quoted(S.PASS_LIKE_TYPES)}))')} AS pass_completion,
  count(*) FILTER (type_name IN ({quoted(S.PROVIDER_COMPARABLE_TYPES)})) AS comparable_actions,
  avg(start_x) AS mean_x, sum(coalesce(xt_value, 0)) AS xt
FROM rated JOIN grid ON {MINUTE} <= t GROUP BY 1, 2, 3""")


@q("checkpoints_g1", with_sql(["grid", "actions"], f"""
SELECT window_index, {r('t', 'checkpoint_minute')}, count(action_id) AS actions_so_far
FROM grid LEFT JOIN actions ON {MINUTE} <= t GROUP BY 1, 2"""))
def checkpoints(spark, sf):
    per = (
        read_actions(spark, sf).where(X.action_minute() <= S.MATCH_MINUTES)
        .groupBy(X.first_checkpoint(X.action_minute()).cast("long").alias("window_index"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Sixteen rows: the running window is over a fixed-size table.
    w = ST.Window.partitionBy().orderBy("window_index").rowsBetween(ST.Window.unboundedPreceding, 0)
    return ST.checkpoints(spark).join(per, "window_index", "left").select(
        "window_index", "checkpoint_minute", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("actions_so_far")
    )


@q("cumulative_stats_g2", with_sql("upto", f"""
SELECT game_id, team_id, window_index, shots, passes, comparable_actions, {r('pass_completion', 'pass_completion', 8)},
  {r('mean_x', 'mean_x', 8)}, {r('xt', 'xt', 8)} FROM upto"""))
def cumulative_stats(spark, sf):
    return X.round_report(ST.cumulative_stats(rated(spark, sf)), 8)


CTES["score"] = (("goals", "outcomes", "grid"), """
SELECT o.game_id, g.window_index, g.t, count(*) FILTER (s.scoring_team_id = o.home_team_id) AS gh,
  count(*) FILTER (s.scoring_team_id = o.away_team_id) AS ga
FROM outcomes o CROSS JOIN grid g LEFT JOIN goals s ON s.game_id = o.game_id AND s.minute <= g.t GROUP BY 1, 2, 3""")


@q("running_score_g3", with_sql("score", """
SELECT game_id, window_index, CAST(gh AS DOUBLE) AS goals_home, CAST(ga AS DOUBLE) AS goals_away, CAST(gh - ga AS DOUBLE) AS goal_diff,
  (gh - ga) * (90e0 - t) + 0 AS goal_diff_x_minutes_remaining FROM score"""))
def running_score(spark, sf):
    table = ST.state_table(read_actions(spark, sf), ST.match_outcomes(read_games(spark, sf)))
    return X.round_report(
        table.select(
            "game_id", "window_index", "goals_home", "goals_away", "goal_diff",
            "goal_diff_x_minutes_remaining",
        )
    )


CTES["closing"] = (("wnodes", "wedges"), f"""
SELECT game_id, team_id, window_index, {ratio('coalesce(m, 0)', 'n * (n - 1)')} AS network_density,
  {ratio('top - mean', 'top')} AS network_centralization
FROM (SELECT game_id, team_id, window_index, count(*) AS n FROM wnodes GROUP BY 1, 2, 3)
FULL JOIN (SELECT game_id, team_id, window_index, sum(k) AS m, max(k) AS top, avg(k) AS mean FROM (
  SELECT game_id, team_id, window_index, source, count(*) AS k FROM wedges GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
  USING (game_id, team_id, window_index)""")


@q("closing_window_g4", with_sql("closing", f"""
SELECT game_id, team_id, window_index, {r('network_density', 'network_density')},
  {r('network_centralization', 'network_centralization')} FROM closing"""))
def closing_window(spark, sf):
    return X.round_report(ST.closing_window_network(*N.windowed_networks(passes(spark, sf))))


CTES["form"] = (("outcomes",), """
SELECT *, coalesce(avg(pts) OVER w, 1) AS form_ppg, coalesce(avg(gd) OVER w, 0) AS form_gd FROM (
  SELECT game_id, season, provider, game_day, home_team_id AS team_id, TRUE AS is_home, home_score - away_score AS gd,
    CASE WHEN home_score > away_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END AS pts FROM outcomes
  UNION ALL SELECT game_id, season, provider, game_day, away_team_id, FALSE, away_score - home_score,
    CASE WHEN home_score < away_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END FROM outcomes)
WINDOW w AS (PARTITION BY season, provider, team_id ORDER BY game_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")


@q("rolling_form_g5", with_sql("form", f"""
SELECT game_id, season, provider, team_id, is_home, {r('form_ppg', 'form_ppg')}, {r('form_gd', 'form_gd')} FROM form"""))
def rolling_form(spark, sf):
    return X.round_report(ST.rolling_form(ST.match_outcomes(read_games(spark, sf))))


@q("customer_form_g5", """
SELECT o_orderkey, o_custkey, coalesce(s / n, 0) AS earlier_mean_cents FROM (
  SELECT o_orderkey, o_custkey, sum(cents) OVER w AS s, count(*) OVER w AS n
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate
    RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))""")
def customer_form(spark, sf):
    orders = read_table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate",
        F.round(F.col("o_totalprice") * 100).cast("long").alias("_cents"), F.lit(1).alias("_one"),
    )
    before = ST.prefix_totals(orders, ["o_custkey"], "o_orderdate", {"s": "_cents", "n": "_one"})
    return orders.join(before, ["o_custkey", "o_orderdate"]).select(
        "o_orderkey", "o_custkey", X.safe_ratio("s", "n").alias("earlier_mean_cents")
    )


_HOME = ("shots", "passes", "pass_completion", "xt")
CTES["state"] = (("score", "upto", "closing", "form", "outcomes"), f"""
SELECT game_id, o.season, o.provider, window_index, t AS checkpoint_minute, o.outcome_index, gh AS goals_home, ga AS goals_away,
  gh - ga AS goal_diff, 90 - t AS minutes_remaining, (gh - ga) * (90 - t) AS goal_diff_x_minutes_remaining,
  {', '.join(f'coalesce({s}.{c}, 0) AS {c}_{n}' for c in _HOME for s, n in (('h', 'home'), ('a', 'away')))},
  coalesce(coalesce(h.comparable_actions, 0) / nullif(CAST(coalesce(h.comparable_actions, 0) + coalesce(a.comparable_actions, 0) AS DOUBLE), 0), 0.5) AS possession_share_home,
  coalesce(h.xt, 0) - coalesce(a.xt, 0) AS xt_diff, coalesce(h.mean_x, 52.5) AS mean_x_home, coalesce(a.mean_x, 52.5) AS mean_x_away,
  fh.form_ppg AS form_ppg_home, fa.form_ppg AS form_ppg_away, fh.form_gd AS form_gd_home, fa.form_gd AS form_gd_away,
  coalesce(nh.network_density, 0) AS network_density_home, coalesce(na.network_density, 0) AS network_density_away,
  coalesce(nh.network_centralization, 0) AS network_centralization_home,
  coalesce(na.network_centralization, 0) AS network_centralization_away
FROM score JOIN outcomes o USING (game_id)
LEFT JOIN (SELECT team_id AS home_team_id, * EXCLUDE (team_id) FROM upto) h USING (game_id, home_team_id, window_index)
LEFT JOIN (SELECT team_id AS away_team_id, * EXCLUDE (team_id) FROM upto) a USING (game_id, away_team_id, window_index)
LEFT JOIN (SELECT team_id AS home_team_id, * EXCLUDE (team_id) FROM closing) nh USING (game_id, home_team_id, window_index)
LEFT JOIN (SELECT team_id AS away_team_id, * EXCLUDE (team_id) FROM closing) na USING (game_id, away_team_id, window_index)
JOIN (SELECT game_id, form_ppg, form_gd FROM form WHERE is_home) fh USING (game_id)
JOIN (SELECT game_id, form_ppg, form_gd FROM form WHERE NOT is_home) fa USING (game_id)""")
_STATE = ", ".join(r(c, c, 8) for c in ("checkpoint_minute", "goals_home", "goals_away", *S.B2_FEATURES))


@q("state_table_g6", with_sql("state", f"SELECT game_id, season, provider, window_index, outcome_index, {_STATE} FROM state"))
def state_table(spark, sf):
    return X.round_report(states(spark, sf), 8)


@q("outcome_balance_g7", with_sql("outcomes", f"""
SELECT season, count(*) AS matches, {', '.join(r(f"avg(CASE WHEN outcome = '{o}' THEN 1e0 ELSE 0 END)", f'share_{o}') for o in S.OUTCOMES)}
FROM outcomes GROUP BY season"""))
def outcome_balance(spark, sf):
    return X.round_report(ST.outcome_balance(ST.match_outcomes(read_games(spark, sf))))


def scored_states(spark, sf):
    """State rows with a fixed probability rule in place of a fitted model."""
    table = ST.state_table(read_actions(spark, sf), ST.match_outcomes(read_games(spark, sf)))
    lean = F.least(F.lit(0.3), F.greatest(F.lit(-0.3), F.col("goal_diff") / F.lit(10.0)))
    return table.select(
        "game_id", "season", "window_index", "checkpoint_minute", "outcome_index",
        F.array(F.lit(0.4) + lean, F.lit(0.25), F.lit(0.35) - lean).alias("probabilities"),
    )


CTES["scored"] = (("score", "outcomes"), """
SELECT game_id, season, window_index, t AS checkpoint_minute, outcome_index,
  4e-1 + least(3e-1, greatest(-3e-1, (gh - ga) / 10e0)) AS p0, 25e-2 AS p1,
  35e-2 - least(3e-1, greatest(-3e-1, (gh - ga) / 10e0)) AS p2 FROM score JOIN outcomes USING (game_id)""")


@q("match_timeline_g8", with_sql("scored", f"""
SELECT game_id, {r('checkpoint_minute', 'checkpoint_minute')}, outcome, {r('p', 'probability')} FROM (
  SELECT game_id, checkpoint_minute, unnest(['home_win', 'draw', 'away_win']) AS outcome, unnest([p0, p1, p2]) AS p
  FROM scored WHERE game_id = 7) ORDER BY checkpoint_minute, outcome"""))
def match_timeline(spark, sf):
    return X.round_report(ST.match_timeline(scored_states(spark, sf), 7))


# --- folds and identity ------------------------------------------------------------------


@q("match_outcome_b11", with_sql("outcomes", "SELECT game_id, outcome, outcome_index FROM outcomes"))
def match_outcome(spark, sf):
    return ST.match_outcomes(read_games(spark, sf)).select("game_id", "outcome", "outcome_index")


@q("temporal_split_h1", with_sql("games", """
SELECT game_id, CASE WHEN game_day <= 26 THEN 'train' WHEN game_day <= 33 THEN 'val' ELSE 'test' END AS fold FROM games"""))
def temporal_split(spark, sf):
    return split(spark, sf)


@q("within_season_split_h1", with_sql("games", """
SELECT game_id, CASE WHEN game_day <= 26 THEN 'train' WHEN game_day <= 32 THEN 'val' ELSE 'test' END AS fold FROM games"""))
def within_season_split(spark, sf):
    return SP.temporal_split(read_games(spark, sf), "within_season")


@q("cross_season_split_h1", with_sql("games", """
SELECT game_id, CASE WHEN season = '2001' THEN 'test' WHEN game_day <= 30 THEN 'train' ELSE 'val' END AS fold
FROM games WHERE season IN ('2000', '2001')"""))
def cross_season_split(spark, sf):
    return SP.temporal_split(read_games(spark, sf), "cross_season", season="2000", test_season="2001")


@q("order_month_split_h1", """
SELECT o_orderkey AS game_id, CASE WHEN month(o_orderdate) <= 26 THEN 'train' ELSE 'test' END AS fold FROM orders""")
def order_split(spark, sf):
    orders = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("game_id"), F.month("o_orderdate").cast("string").alias("matchweek")
    )
    return SP.temporal_split(orders, "matchweek")


@q("assign_fold_h2", with_sql(["actions", "folds"], "SELECT action_id, fold FROM actions JOIN folds USING (game_id)"))
def assign_fold(spark, sf):
    return SP.assign_fold(read_actions(spark, sf), split(spark, sf)).select("action_id", "fold")


@q("fold_conflicts_h3", with_sql(["actions"], """
SELECT game_id, min(f) AS first_fold, max(f) AS last_fold FROM (
  SELECT game_id, CASE action_id % 40 WHEN 0 THEN 'unused' WHEN 1 THEN CASE WHEN game_id % 2 = 0 THEN 'test' ELSE 'train' END ELSE 'train' END AS f FROM actions)
WHERE f <> 'unused' GROUP BY 1 HAVING count(DISTINCT f) > 1"""))
def fold_conflicts(spark, sf):
    rows = read_actions(spark, sf).withColumn(
        "fold",
        F.when(F.col("action_id") % 40 == 0, "unused")
        .when((F.col("action_id") % 40 == 1) & (F.col("game_id") % 2 == 0), "test").otherwise("train"),
    )
    return SP.fold_conflicts(rows)


@q("row_split_conflicts_h4", with_sql(["actions"], """
SELECT game_id, 'test' AS first_fold, 'train' AS last_fold FROM actions GROUP BY 1
HAVING count(DISTINCT CASE WHEN action_id % 5 = 0 THEN 'test' ELSE 'train' END) > 1"""))
def row_split_conflicts(spark, sf):
    rows = read_actions(spark, sf).withColumn(
        "fold", F.when(F.col("action_id") % 5 == 0, "test").otherwise("train")
    )
    return SP.fold_conflicts(rows)


_ROLE_PCT = ", ".join(
    r(f"100e0 * count(*) FILTER (coarse_role = '{c}') / nullif(count(coarse_role), 0)", f"pct_{c}") for c in S.COARSE_ROLES
)


@q("fold_report_h5", with_sql(["nodes", "folds", "lineup"], f"""
SELECT fold, count(*) AS rows, count(DISTINCT game_id) AS games, {_ROLE_PCT}
FROM nodes JOIN folds USING (game_id) LEFT JOIN lineup USING (season, provider, player_id) GROUP BY fold"""))
def fold_report(spark, sf):
    nodes = N.match_networks(passes(spark, sf))[0].join(
        directory(spark, sf).select("season", "provider", "player_id", "coarse_role"),
        ["season", "provider", "player_id"], "left",
    )
    return X.round_report(SP.fold_report(SP.assign_fold(nodes, split(spark, sf))))


_CODE = "translate(CAST({k} AS VARCHAR), '0123456789', 'abcdefghij')"


def _code(column):
    return F.translate(F.col(column).cast("string"), "0123456789", "abcdefghij")


def left_names(spark, sf):
    return read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("player_id"), F.concat(F.lit("Name "), _code("c_custkey")).alias("player_name")
    )


def right_names(spark, sf):
    prefix = F.when(F.col("s_suppkey") % 2 == 0, "Näme ").otherwise("N. ")
    return read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("player_id"), F.concat(prefix, _code("s_suppkey")).alias("player_name")
    )


@q("normalise_name_b9", f"""
SELECT s_suppkey AS player_id, CASE WHEN s_suppkey % 2 = 0 THEN 'name ' ELSE 'n ' END || {_CODE.format(k='s_suppkey')} AS normalised,
  {_CODE.format(k='s_suppkey')} AS surname FROM supplier""")
def normalise_names(spark, sf):
    from pitchloom.functions.text import normalise_name, surname

    full = right_names(spark, sf).select("player_id", normalise_name(F.col("player_name")).alias("normalised"))
    return full.withColumn("surname", surname(F.col("normalised")))


@q("unescape_name_b10", """
SELECT s_suppkey AS player_id, 'N' || chr(233) || chr(263) || ' "' || s_name || '"' AS player_name FROM supplier""")
def unescape_names(spark, sf):
    from pitchloom.functions.text import unescape_name

    raw = F.concat(F.lit('N\\u00e9\\u0107 "'), F.col("s_name"), F.lit('"'))
    return read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("player_id"), unescape_name(raw).alias("player_name")
    )


@q("match_players_i1", f"""
WITH l AS (SELECT c_custkey AS k, {_CODE.format(k='c_custkey')} AS code FROM customer),
  s AS (SELECT s_suppkey AS k, {_CODE.format(k='s_suppkey')} AS code FROM supplier)
SELECT l.k AS player_id_left, s.k AS player_id_right, CASE WHEN s.k % 2 = 0 THEN 'full_name' ELSE 'surname' END AS match_rule
FROM l JOIN s USING (code)""")
def match_players(spark, sf):
    return I.match_players(left_names(spark, sf), right_names(spark, sf))


def lineup_spells(spark, sf):
    """One spell per player, match and half, with the minutes between first and last action."""
    rows = read_actions(spark, sf).where(F.col("player_id").isNotNull())
    zone_name = F.when(F.col("start_x") < 35, "Center Back").when(F.col("start_x") < 70, "Center Midfield").otherwise("Center Forward")
    spans = rows.groupBy("game_id", "player_id", zone_name.alias("position")).agg(
        (F.max("time_seconds") - F.min("time_seconds")).alias("minutes_played")
    )
    return spans.withColumn("player_name", F.concat(F.lit("player "), F.col("player_id").cast("string")))


CTES["spells"] = (("actions",), """
SELECT game_id, player_id, CASE WHEN start_x < 35 THEN 'Center Back' WHEN start_x < 70 THEN 'Center Midfield'
    ELSE 'Center Forward' END AS position, max(time_seconds) - min(time_seconds) AS m FROM actions
  WHERE player_id IS NOT NULL GROUP BY 1, 2, 3""")
CTES["tops"] = (("spells",), """
SELECT player_id, position FROM (SELECT player_id, position, row_number() OVER (PARTITION BY player_id ORDER BY sum(m) DESC, position) AS n
    FROM spells GROUP BY 1, 2) WHERE n = 1""")


@q("nominal_position_i2", with_sql("tops", """
SELECT player_id, 'player ' || player_id AS player_name, sum(m) AS minutes_total, count(DISTINCT game_id) AS matches, any_value(t.position) AS position
FROM spells s JOIN tops t USING (player_id) GROUP BY 1, 2"""))
def nominal_position(spark, sf):
    return I.nominal_positions(lineup_spells(spark, sf))


@q("static_directory_i3", """
SELECT c_custkey AS player_id, 'P. ' || chr(263) || c_name AS player_name,
  CASE c_nationkey % 5 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' WHEN 3 THEN 'FWD' END AS coarse_role,
  CAST(NULL AS VARCHAR) AS fine_position FROM customer""")
def static_directory(spark, sf):
    code = F.element_at(F.array(*[F.lit(c) for c in ("GK", "DF", "MD", "FW", "XX")]), F.col("c_nationkey") % 5 + 1)
    raw = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("wyId"), F.concat(F.lit("P. \\u0107"), F.col("c_name")).alias("shortName"),
        F.struct(code.alias("code2")).alias("role"),
    )
    return I.static_directory(raw)


@q("player_directory_i4", with_sql("lineup", "SELECT season, provider, player_id, coarse_role FROM lineup"))
def player_directory(spark, sf):
    return I.player_directory(read_lineup(spark, sf), read_actions(spark, sf)).drop("fine_position")


def aliases_of(spark, sf):
    base = read_table(spark, sf, "nation")
    alpha = base.select(
        F.lower("n_name").alias("club_key"), F.initcap(F.lower("n_name")).alias("display_name"),
        F.lit("alpha").alias("provider"), F.col("n_nationkey").cast("long").alias("team_id"),
    )
    beta = base.where(F.col("n_regionkey") < 3).select(
        F.lower("n_name").alias("club_key"), F.initcap(F.lower("n_name")).alias("display_name"),
        F.lit("beta").alias("provider"), (F.col("n_nationkey") + 100).cast("long").alias("team_id"),
    )
    return alpha.unionByName(beta)


@q("club_bridge_i5", """
SELECT lower(n_name) AS club_key, CAST(n_nationkey AS BIGINT) AS team_id_alpha, CAST(n_nationkey + 100 AS BIGINT) AS team_id_beta
FROM nation WHERE n_regionkey < 3""")
def club_bridge(spark, sf):
    return I.club_bridge(aliases_of(spark, sf), "alpha", "beta")


@q("club_label_b12", with_sql(["nodes", "clubs"], """
SELECT DISTINCT provider, season, team_id, coalesce(team_name, 'team ' || team_id) AS club
FROM nodes LEFT JOIN clubs USING (provider, team_id)"""))
def club_label(spark, sf):
    rows = N.match_networks(passes(spark, sf))[0].select("provider", "season", "team_id").distinct()
    return I.club_labels(rows, teams_of(spark, sf))


@q("coarse_role_b6", with_sql("lineup", f"SELECT season, provider, player_id, coarse_role, {_ROLE_INDEX} FROM lineup"))
def coarse_roles(spark, sf):
    table = directory(spark, sf).withColumn("role_index", I.role_index())
    return table.drop("fine_position")


@q("role_index_b7", with_sql("lineup", f"""
SELECT season, role_index, count(*) AS players FROM (SELECT season, {_ROLE_INDEX} FROM lineup) GROUP BY 1, 2"""))
def role_indexes(spark, sf):
    return (
        directory(spark, sf).groupBy("season", I.role_index().alias("role_index"))
        .agg(F.count(F.lit(1)).alias("players"))
    )


@q("mapping_coverage_b8", """
SELECT DISTINCT p_type AS label FROM part WHERE p_type NOT IN ('GK', 'DF', 'MD', 'FW')""")
def mapping_coverage(spark, sf):
    return I.unmapped_labels(read_table(spark, sf, "part"), "p_type", "code")
