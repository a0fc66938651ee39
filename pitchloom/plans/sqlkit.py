"""SQL text of the shared building blocks, for the side-by-side checks.

Each entry is one CTE body; ``with_sql`` adds the ones a query needs, in order.
"""

from __future__ import annotations

from pitchloom import schema as S
from pitchloom.sources import event_actions as E


def quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def r(expression: str, name: str, digits: int = 6) -> str:
    """Rounded column with a name; adding zero removes negative zero."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0 AS {name}"


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


def _band_case() -> str:
    parts = []
    for event_type, bands in E.TYPE_BANDS.items():
        inner = " ".join(f"WHEN k < {bound} THEN '{name}'" for bound, name in bands)
        parts.append(f"WHEN event_type = '{event_type}' THEN CASE {inner} ELSE 'non_action' END")
    return "CASE " + " ".join(parts) + " ELSE 'non_action' END"


def season_cols(game: str) -> str:
    season = f"({game} // {E.SEASON_MATCHES})"
    cohort = f"({season} // {E.COHORT_SEASONS})"
    home = f"({game} % {E.CLUBS})"
    away = f"(({home} + 1 + ({game} // {E.CLUBS}) % {E.CLUBS - 1}) % {E.CLUBS})"
    return (
        f"CAST(2000 + {season} AS VARCHAR) AS season, "
        f"CASE WHEN {season} % 2 = 0 THEN 'alpha' ELSE 'beta' END AS provider, "
        f"CAST({game} % {E.SEASON_MATCHES} + 1 AS INTEGER) AS game_day, "
        f"CAST({cohort} * 10 + {home} + 1 AS BIGINT) AS home_team_id, "
        f"CAST({cohort} * 10 + {away} + 1 AS BIGINT) AS away_team_id"
    )


PASS = f"type_name IN ({quoted(S.PASS_LIKE_TYPES)})"
COMPARABLE = f"type_name IN ({quoted(S.PROVIDER_COMPARABLE_TYPES)})"
CONTEST = f"type_name IN ({quoted(S.CONTEST_TYPES)})"
SET_PIECE = f"type_name IN ({quoted(S.POSSESSION_SET_PIECES)})"
CHAIN_SET_PIECE = f"type_name IN ({quoted(S.CHAIN_SET_PIECES)})"
SHOT = "starts_with(type_name, 'shot')"
OK = "result_name = 'success'"
DONE = f"({PASS} AND {OK})"
MINUTE = (
    "((CASE period_id WHEN 1 THEN 0e0 WHEN 2 THEN 45e0 WHEN 3 THEN 90e0 WHEN 4 THEN 105e0 "
    "WHEN 5 THEN 120e0 ELSE 0e0 END) + time_seconds / 60e0)"
)
LENGTH = "sqrt((end_x - start_x) * (end_x - start_x) + (end_y - start_y) * (end_y - start_y))"
ORDER = "period_id, time_seconds, action_id"
NK = "game_id, team_id, season, provider"
WK = NK + ", window_index"
_W = f"(PARTITION BY game_id ORDER BY {ORDER})"
_TYPES = "[" + quoted(S.ACTION_TYPES) + "]"
_RESULTS = "[" + quoted(S.RESULT_TYPES) + "]"


def zone(x: str) -> str:
    return (
        f"CASE WHEN {x} < 35 THEN 'defensive' WHEN {x} < 70 THEN 'middle' "
        f"WHEN {x} IS NOT NULL THEN 'final' END"
    )


def _node_select(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, player_id, avg(start_x) AS mean_x, avg(start_y) AS mean_y,
  coalesce(stddev_samp(start_x), 0) AS spread_x, coalesce(stddev_samp(start_y), 0) AS spread_y,
  count(*) FILTER ({COMPARABLE}) AS touches, count(action_id) AS actions_all_types,
  count(*) FILTER ({PASS}) AS passes_attempted, count(*) FILTER ({DONE}) AS passes_completed
FROM {source} WHERE player_id IS NOT NULL GROUP BY {keys}, player_id"""


def _edge_select(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, player_id AS source, recipient_id AS target, count(action_id) AS weight,
  avg({LENGTH}) AS mean_length, avg(end_x - start_x) AS mean_dx
FROM {source} WHERE {DONE} AND recipient_id IS NOT NULL AND player_id IS NOT NULL
  AND player_id <> recipient_id GROUP BY {keys}, player_id, recipient_id"""


def feature_select(nodes: str, edges: str, keys: str) -> str:
    using = f"{keys}, player_id"
    return f"""
SELECT n.*, coalesce(o.so, 0) AS strength_out, coalesce(o.dg, 0) AS degree_out,
  coalesce(i.si, 0) AS strength_in, coalesce(i.dg, 0) AS degree_in,
  coalesce(o.wdx / o.so, 0) AS progression_made, coalesce(o.wlen / o.so, 0) AS pass_length_made,
  coalesce(o.wprog / o.so, 0) AS progressive_share,
  coalesce(i.wdx / i.si, 0) AS progression_received
FROM {nodes} n
LEFT JOIN (SELECT {keys}, source AS player_id, CAST(sum(weight) AS DOUBLE) AS so, count(*) AS dg,
    sum(weight * mean_dx) AS wdx, sum(weight * mean_length) AS wlen,
    CAST(sum(CASE WHEN mean_dx > 5 THEN weight ELSE 0 END) AS DOUBLE) AS wprog
  FROM {edges} GROUP BY {keys}, source) o USING ({using})
LEFT JOIN (SELECT {keys}, target AS player_id, CAST(sum(weight) AS DOUBLE) AS si, count(*) AS dg,
    sum(weight * mean_dx) AS wdx
  FROM {edges} GROUP BY {keys}, target) i USING ({using})"""


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, "
               f"event_id // {E.MATCH_EVENTS} AS game_id, event_id % {E.MATCH_EVENTS} AS pos FROM events"),
    "ev2": (("ev",), f"SELECT *, {season_cols('game_id')}, (user_id // 2) % {E.SQUAD} AS slot, "
            "(pos // 5 + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) % 2 AS side, "
            f"{_band_case()} AS type_name FROM ev"),
    "actions": (("ev2",), f"""
SELECT game_id, 'e' || CAST(event_id AS VARCHAR) AS original_event_id,
  CAST(CASE WHEN pos < 100 THEN 1 ELSE 2 END AS BIGINT) AS period_id,
  (pos % 100) * 30e0 AS time_seconds,
  CASE WHEN side = 0 THEN home_team_id ELSE away_team_id END AS team_id,
  CASE WHEN event_id % 97 <> 0 THEN
    (CASE WHEN side = 0 THEN home_team_id ELSE away_team_id END) * 100 + slot END AS player_id,
  slot * 7e0 + (event_id * 37 % 350) / 10e0 AS start_x, k * 68e-2 AS start_y,
  greatest(0e0, least(105e0, slot * 7e0 + (event_id * 37 % 350) / 10e0
    + ((event_id * 53 + 17) % 400) / 10e0 - 15e0)) AS end_x,
  ((k * 7 + 13) % 100) * 68e-2 AS end_y,
  event_id AS action_id, type_name, season, provider,
  CAST(event_id % 3 AS INTEGER) AS bodypart_id,
  CASE WHEN starts_with(type_name, 'shot') THEN CASE WHEN value < 10 THEN 'success' ELSE 'fail' END
    WHEN type_name = 'bad_touch' AND value >= 80 THEN 'owngoal'
    WHEN value < 80 THEN 'success' ELSE 'fail' END AS result_name
FROM ev2"""),
    "games": ((), f"""
SELECT game_id, min(ts) AS game_date, {season_cols('game_id')},
  CASE WHEN game_id % 11 <> 0 THEN CAST(game_id * 7 % 4 AS INTEGER) END AS home_score,
  CASE WHEN game_id % 11 <> 0 THEN CAST(game_id * 5 % 3 AS INTEGER) END AS away_score
FROM (SELECT event_id // {E.MATCH_EVENTS} AS game_id, ts FROM events) GROUP BY game_id"""),
    "truth": (("ev2",), f"""
SELECT 'e' || CAST(event_id AS VARCHAR) AS original_event_id,
  CASE WHEN event_id % 3 <> 0 THEN
    (CASE WHEN k % 2 = 0 THEN home_team_id ELSE away_team_id END) * 100 + k % {E.SQUAD} END
    AS true_recipient_id,
  CASE WHEN event_id % 19 <> 0 THEN event_id // 4 END AS statsbomb_possession FROM ev2"""),
    "passes": (("actions",), "SELECT *, CASE WHEN " + DONE + " THEN coalesce(" + ", ".join(
        f"CASE WHEN lead(team_id, {n}) OVER w = team_id AND lead(period_id, {n}) OVER w = period_id "
        f"AND lead(player_id, {n}) OVER w IS DISTINCT FROM player_id "
        f"THEN lead(player_id, {n}) OVER w END" for n in (1, 2, 3)
    ) + f") END AS recipient_id FROM actions WINDOW w AS {_W}"),
    "touch": (("passes",), f"""
SELECT *, CASE WHEN cand AND (pos - coalesce(plain, 0)) % 2 = 1 THEN bef ELSE team_id END AS touch
FROM (SELECT *, max(CASE WHEN NOT cand THEN pos END) OVER (PARTITION BY game_id ORDER BY pos) AS plain
  FROM (SELECT *, row_number() OVER w AS pos, lag(team_id) OVER w AS bef,
      coalesce({CONTEST} AND lag(team_id) OVER w = lead(team_id) OVER w
        AND lead(team_id) OVER w <> team_id, FALSE) AS cand
    FROM passes WINDOW w AS {_W}))"""),
    "runs": (("touch",), """
SELECT *, lag(touch) OVER (PARTITION BY game_id ORDER BY run) AS rb,
  lead(touch) OVER (PARTITION BY game_id ORDER BY run) AS ra
FROM (SELECT game_id, run, min(touch) AS touch, count(*) AS len FROM (
  SELECT game_id, touch, sum(ch) OVER (PARTITION BY game_id ORDER BY pos) AS run FROM (
    SELECT game_id, touch, pos, CASE WHEN lag(touch) OVER (PARTITION BY game_id ORDER BY pos) = touch
      THEN 0 ELSE 1 END AS ch FROM touch)) GROUP BY game_id, run)"""),
    "owners": (("runs",), """
SELECT game_id, run, CASE WHEN short AND (run - coalesce(plain, 0)) % 2 = 1 THEN rb ELSE touch END AS owner
FROM (SELECT *, max(CASE WHEN NOT short THEN run END) OVER (PARTITION BY game_id ORDER BY run) AS plain
  FROM (SELECT *, coalesce(len < 2 AND rb = ra, FALSE) AS short FROM runs))"""),
    "chained": (("touch", "owners"), f"""
SELECT * EXCLUDE (beg, owner), owner AS possession_team_id,
  CAST(sum(beg) OVER (PARTITION BY game_id ORDER BY pos) - 1 AS BIGINT) AS possession_id
FROM (SELECT *, CASE WHEN pos > 1 AND lag(owner) OVER w = owner AND lag(period_id) OVER w = period_id
    AND NOT {SET_PIECE} THEN 0 ELSE 1 END AS beg
  FROM (SELECT t.*, o.owner FROM (
      SELECT *, sum(ch) OVER (PARTITION BY game_id ORDER BY pos) AS run FROM (
        SELECT *, CASE WHEN lag(touch) OVER (PARTITION BY game_id ORDER BY pos) = touch
          THEN 0 ELSE 1 END AS ch FROM touch)) t
    JOIN owners o USING (game_id, run))
  WINDOW w AS (PARTITION BY game_id ORDER BY pos))"""),
    "eligible": (("passes",), f"""
SELECT {NK}, player_id FROM passes WHERE player_id IS NOT NULL GROUP BY {NK}, player_id
HAVING max({MINUTE}) - min({MINUTE}) >= 20"""),
    "all_nodes": (("passes",), _node_select("passes", NK)),
    "all_edges": (("passes",), _edge_select("passes", NK)),
    "nodes": (("all_nodes", "eligible"),
              f"SELECT n.* FROM all_nodes n SEMI JOIN eligible USING ({NK}, player_id)"),
    "edges": (("all_edges", "eligible"), f"""
SELECT e.* FROM all_edges e
SEMI JOIN (SELECT {NK}, player_id AS source FROM eligible) s USING ({NK}, source)
SEMI JOIN (SELECT {NK}, player_id AS target FROM eligible) t USING ({NK}, target)"""),
    "windows": ((), "SELECT CAST(i AS BIGINT) AS window_index, i * 5e0 AS low, i * 5e0 + 15 AS high "
                    "FROM range(16) t(i)"),
    "placed": (("passes", "windows"), f"""
SELECT p.*, w.window_index FROM passes p JOIN windows w ON {MINUTE} >= w.low AND {MINUTE} < w.high"""),
    "wnodes": (("placed",), _node_select("placed", WK)),
    "wedges": (("placed",), _edge_select("placed", WK)),
    "folds": (("games",), """
SELECT game_id, CASE WHEN game_day <= 26 THEN 'train' WHEN game_day BETWEEN 27 AND 33 THEN 'val'
  WHEN game_day >= 34 THEN 'test' ELSE 'unused' END AS fold FROM games"""),
    # Expected threat on the training fold, iterated until no cell moves by more than 1e-5.
    "cells": (("chained",), """
SELECT *, CAST(greatest(0, least(15, floor(start_x / 105e0 * 16))) AS BIGINT)
    + 16 * CAST(greatest(0, least(11, floor(start_y / 68e0 * 12))) AS BIGINT) AS cell_from,
  CAST(greatest(0, least(15, floor(end_x / 105e0 * 16))) AS BIGINT)
    + 16 * CAST(greatest(0, least(11, floor(end_y / 68e0 * 12))) AS BIGINT) AS cell_to,
  type_name IN ('pass', 'dribble', 'cross') AS is_move FROM chained"""),
    "fit_rows": (("cells", "folds"),
                 "SELECT c.* FROM cells c JOIN folds f USING (game_id) WHERE f.fold = 'train'"),
    "cell_stats": (("fit_rows",), f"""
SELECT cell_from AS cell, CAST(count(*) FILTER (is_move) AS DOUBLE) AS moves,
  CAST(count(*) FILTER (type_name = 'shot') AS DOUBLE) AS shots,
  CAST(count(*) FILTER (type_name = 'shot' AND {OK}) AS DOUBLE) AS goals
FROM fit_rows GROUP BY cell_from"""),
    "cell_moves": (("fit_rows", "cell_stats"), f"""
SELECT f.cell_from AS a, f.cell_to AS b, count(*) / any_value(s.moves) AS p FROM fit_rows f
JOIN cell_stats s ON s.cell = f.cell_from WHERE is_move AND {OK} GROUP BY 1, 2"""),
    "payoff": (("cell_stats",), """
SELECT g.cell, coalesce(s.goals / nullif(s.shots, 0), 0) * coalesce(s.shots / nullif(s.shots + s.moves, 0), 0) AS gs,
  coalesce(s.moves / nullif(s.shots + s.moves, 0), 0) AS pm
FROM (SELECT CAST(i AS BIGINT) AS cell FROM range(192) t(i)) g LEFT JOIN cell_stats s USING (cell)"""),
    "surfaces": (("payoff", "cell_moves"), """
SELECT 0 AS step, cell, 0e0 AS xt, 1e0 AS moved FROM payoff
UNION ALL
SELECT p.step + 1, y.cell, y.gs + y.pm * coalesce(p.total, 0), abs(y.gs + y.pm * coalesce(p.total, 0) - p.xt)
FROM (SELECT step, s.cell, any_value(s.xt) AS xt, sum(m.p * t.xt) AS total
  FROM surfaces s LEFT JOIN cell_moves m ON m.a = s.cell
  LEFT JOIN (SELECT cell, xt FROM surfaces) t ON t.cell = m.b GROUP BY step, s.cell) p
JOIN payoff y USING (cell) WHERE p.step < 60"""),
    "surface": (("surfaces",), """
SELECT cell, xt FROM surfaces WHERE step = (SELECT min(step) FROM (
  SELECT step, max(moved) AS m FROM surfaces GROUP BY step) WHERE m <= 1e-5)"""),
    "rated": (("cells", "surface"), f"""
SELECT c.*, CASE WHEN is_move AND {OK} THEN b.xt - a.xt END AS xt_value FROM cells c
LEFT JOIN surface a ON a.cell = c.cell_from LEFT JOIN surface b ON b.cell = c.cell_to"""),
    "placed_rated": (("rated", "windows"), f"""
SELECT p.*, w.window_index FROM rated p JOIN windows w ON {MINUTE} >= w.low AND {MINUTE} < w.high"""),
    "features": (("nodes", "edges"), feature_select("nodes", "edges", NK)),
    "wfeatures": (("wnodes", "wedges"), feature_select("wnodes", "wedges", WK)),
    "outcomes": (("games",), """
SELECT *, CASE WHEN home_score > away_score THEN 'home_win' WHEN home_score < away_score
  THEN 'away_win' ELSE 'draw' END AS outcome,
  CAST(CASE WHEN home_score > away_score THEN 0 WHEN home_score < away_score THEN 2 ELSE 1 END AS BIGINT)
    AS outcome_index
FROM games WHERE home_score IS NOT NULL AND away_score IS NOT NULL"""),
    "goals": (("actions",), f"""
SELECT game_id, team_id AS acting_team_id, team_id AS scoring_team_id, {MINUTE} AS minute
FROM actions WHERE {SHOT} AND {OK}
UNION ALL
SELECT a.game_id, a.team_id, CASE WHEN a.team_id = t.lo THEN t.hi ELSE t.lo END, {MINUTE}
FROM actions a JOIN (SELECT game_id, min(team_id) AS lo, max(team_id) AS hi FROM actions GROUP BY 1) t
  USING (game_id) WHERE result_name = 'owngoal'"""),
    "chains": (("rated",), f"""
SELECT * FROM (SELECT game_id, possession_id, arg_min(season, pos) AS season,
  arg_min(provider, pos) AS provider, arg_min(team_id, pos) AS team_id, arg_min(period_id, pos) AS period_id,
  min({MINUTE}) AS start_minute, max({MINUTE}) AS end_minute, count(*) AS n_actions,
  arg_min(start_x, pos) AS start_x, arg_min(start_y, pos) AS start_y, arg_max(end_x, pos) AS end_x,
  arg_max(end_y, pos) AS end_y, sum({LENGTH}) AS path_length, avg({LENGTH}) AS mean_pass_length,
  sum(coalesce(xt_value, 0)) AS xt_gain, avg(CASE WHEN start_x >= 70 THEN 1e0 ELSE 0e0 END) AS share_final_third,
  max(start_y) - min(start_y) AS width_used,
  (max({MINUTE}) - min({MINUTE})) * 60 AS duration_seconds,
  arg_max(end_x, pos) - arg_min(start_x, pos) AS net_dx,
  greatest(-1, least(1, coalesce((arg_max(end_x, pos) - arg_min(start_x, pos)) / nullif(sum({LENGTH}), 0), 0))) AS directness,
  CASE WHEN arg_min(type_name, pos) IN ({quoted(S.CHAIN_SET_PIECES)}) THEN 1e0 ELSE 0e0 END AS started_with_set_piece
FROM rated WHERE {COMPARABLE} GROUP BY game_id, possession_id HAVING count(*) >= 3)
LEFT JOIN (SELECT DISTINCT game_id, possession_id, TRUE AS shot FROM rated WHERE {SHOT}) USING (game_id, possession_id)"""),
}


def with_sql(names, final: str) -> str:
    """Final SELECT with the CTEs it needs, dependencies first."""
    order: list[str] = []

    def visit(name):
        for needed in CTES[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in [names] if isinstance(names, str) else names:
        visit(name)
    body = ",\n".join(f"{name} AS ({CTES[name][1].strip()})" for name in order)
    return f"WITH RECURSIVE {body}\n{final.strip()}"
