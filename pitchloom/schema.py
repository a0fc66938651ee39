"""Canonical schemas and vocabularies.

Every list below is a fixed value: the results of the operators depend on it.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: action vocabulary (public action schema, position = type_id) ----------
ACTION_TYPES = (
    "pass", "cross", "throw_in", "freekick_crossed", "freekick_short", "corner_crossed",
    "corner_short", "take_on", "foul", "tackle", "interception", "shot", "shot_penalty",
    "shot_freekick", "keeper_save", "keeper_claim", "keeper_punch", "keeper_pick_up",
    "clearance", "bad_touch", "non_action", "dribble", "goalkick",
)
RESULT_TYPES = ("fail", "success", "offside", "owngoal", "yellow_card", "red_card")
BODYPARTS = ("foot", "head", "other")

# --- fixed values: type families ---------------------------------------------------------
PASS_LIKE_TYPES = (
    "pass", "cross", "throw_in", "freekick_crossed", "freekick_short", "corner_crossed",
    "corner_short", "goalkick",
)
PROVIDER_COMPARABLE_TYPES = (
    "pass", "cross", "throw_in", "corner_crossed", "corner_short", "freekick_short",
    "goalkick", "shot", "shot_freekick", "shot_penalty", "take_on", "keeper_save", "foul",
)
POSSESSION_SET_PIECES = (
    "throw_in", "corner_crossed", "corner_short", "freekick_crossed", "freekick_short",
    "goalkick", "shot_penalty", "shot_freekick",
)
CHAIN_SET_PIECES = (
    "throw_in", "corner_crossed", "corner_short", "freekick_short", "freekick_crossed",
    "goalkick",
)
CONTEST_TYPES = (
    "clearance", "interception", "tackle", "keeper_save", "keeper_punch", "bad_touch",
)
THREAT_MOVE_TYPES = ("pass", "dribble", "cross")
DENSITY_ASYMMETRIC_TYPES = ("dribble",)

# --- fixed values: geometry and time -----------------------------------------------------
PITCH_LENGTH = 105.0
PITCH_WIDTH = 68.0
BOUNDS_SLACK = 2.0
ZONE_EDGES = (35.0, 70.0)
PERIOD_OFFSETS = {1: 0.0, 2: 45.0, 3: 90.0, 4: 105.0, 5: 120.0}
MATCH_MINUTES = 90.0
WINDOW_MINUTES = 15.0
STRIDE_MINUTES = 5.0
WINDOW_COUNT = 16
LOOKAHEAD = 3
MIN_HOLD = 2
MIN_MINUTES = 20.0
MIN_CHAIN_ACTIONS = 3
CHAIN_TOKENS = 12
PROGRESSIVE_DX = 5.0
GRID_LENGTH = 16
GRID_WIDTH = 12
ZERO_WEIGHT_DISTANCE = 1e12

# --- fixed values: roles -----------------------------------------------------------------
COARSE_ROLES = ("GK", "DEF", "MID", "FWD")
FINE_POSITION_ROLES = {
    "Goalkeeper": "GK",
    "Right Back": "DEF", "Right Center Back": "DEF", "Center Back": "DEF",
    "Left Center Back": "DEF", "Left Back": "DEF", "Right Wing Back": "DEF",
    "Left Wing Back": "DEF",
    "Right Defensive Midfield": "MID", "Center Defensive Midfield": "MID",
    "Left Defensive Midfield": "MID", "Right Midfield": "MID",
    "Right Center Midfield": "MID", "Center Midfield": "MID",
    "Left Center Midfield": "MID", "Left Midfield": "MID",
    "Right Attacking Midfield": "MID", "Center Attacking Midfield": "MID",
    "Left Attacking Midfield": "MID",
    "Right Wing": "FWD", "Left Wing": "FWD", "Right Center Forward": "FWD",
    "Center Forward": "FWD", "Left Center Forward": "FWD", "Secondary Striker": "FWD",
}
ROLE_CODE_ROLES = {"GK": "GK", "DF": "DEF", "MD": "MID", "FW": "FWD"}

# --- fixed values: outcome labels, metric and feature lists ------------------------------
OUTCOMES = ("home_win", "draw", "away_win")
PLAYER_METRICS = (
    "degree_in", "degree_out", "degree_total", "strength_in", "strength_out",
    "betweenness", "closeness", "eigenvector", "pagerank", "clustering",
)
WEIGHT_SENSITIVE_METRICS = PLAYER_METRICS[3:]
TEAM_METRICS = (
    "team_density", "team_centralization", "team_avg_path_length", "team_n_nodes",
    "team_n_edges", "team_total_passes",
)
CHAIN_FEATURES = (
    "n_actions", "duration_seconds", "start_x", "start_y", "end_x", "end_y", "net_dx",
    "path_length", "directness", "mean_pass_length", "xt_gain", "started_with_set_piece",
    "share_final_third", "width_used",
)
B0_FEATURES = ("goal_diff", "minutes_remaining", "goal_diff_x_minutes_remaining")
B1_FEATURES = B0_FEATURES + (
    "shots_home", "shots_away", "passes_home", "passes_away", "pass_completion_home",
    "pass_completion_away", "possession_share_home", "xt_home", "xt_away", "xt_diff",
)
B2_FEATURES = B1_FEATURES + (
    "mean_x_home", "mean_x_away", "form_ppg_home", "form_ppg_away", "form_gd_home",
    "form_gd_away", "network_density_home", "network_density_away",
    "network_centralization_home", "network_centralization_away",
)
FEATURE_LADDER = {"B0": B0_FEATURES, "B1": B1_FEATURES, "B2": B2_FEATURES}
POSITION_FEATURES = ("mean_x", "mean_y", "spread_x", "spread_y")
TOPOLOGY_FEATURES = (
    "touches", "passes_attempted", "passes_completed", "pass_completion_rate",
    "degree_in_norm", "degree_out_norm", "strength_in_norm", "strength_out_norm",
    "edge_share_in", "edge_share_out",
)
DIRECTION_FEATURES = (
    "progression_made", "progression_received", "pass_length_made", "progressive_share",
)
THREAT_FEATURES = (
    "xt_generated", "shot_involvement", "xt_strength_in_norm", "xt_strength_out_norm",
)
CONVERSION_FEATURES = ("shot_conversion",)
FEATURE_SETS = {
    "position": POSITION_FEATURES,
    "topology": TOPOLOGY_FEATURES,
    "both": POSITION_FEATURES + TOPOLOGY_FEATURES,
    "direction": DIRECTION_FEATURES,
    "topology+direction": TOPOLOGY_FEATURES + DIRECTION_FEATURES,
    "all": POSITION_FEATURES + TOPOLOGY_FEATURES + DIRECTION_FEATURES,
    "threat": THREAT_FEATURES,
    "all+threat": POSITION_FEATURES + TOPOLOGY_FEATURES + DIRECTION_FEATURES + THREAT_FEATURES,
    "all+threat+conv": (
        POSITION_FEATURES + TOPOLOGY_FEATURES + DIRECTION_FEATURES + THREAT_FEATURES + CONVERSION_FEATURES
    ),
}

# --- fixed values: validation-only columns that must never reach a model -----------------
ENRICHMENT_ONLY_COLUMNS = (
    "true_recipient_id", "statsbomb_xg", "statsbomb_possession", "position_name_24",
    "position_id_24", "under_pressure", "carry_end_x", "carry_end_y", "play_pattern",
)

GAME_KEYS = ("game_id",)
ACTION_ORDER = ("period_id", "time_seconds", "action_id")
NETWORK_KEYS = ("game_id", "team_id", "season", "provider")
WINDOW_KEYS = NETWORK_KEYS + ("window_index",)


def _schema(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_L, _I, _D, _S, _B = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType(),
)

ACTION_SCHEMA = _schema(
    ("game_id", _L), ("original_event_id", _S), ("period_id", _L), ("time_seconds", _D),
    ("team_id", _L), ("player_id", _L), ("start_x", _D), ("start_y", _D), ("end_x", _D),
    ("end_y", _D), ("type_id", _I), ("result_id", _I), ("bodypart_id", _I),
    ("action_id", _L), ("recipient_id", _L), ("recipient_confident", _B),
    ("possession_id", _L), ("possession_team_id", _L), ("type_name", _S),
    ("result_name", _S), ("season", _S), ("provider", _S),
)
# The owning team is written but not demanded of a reader.
CANONICAL_COLUMNS = tuple(f.name for f in ACTION_SCHEMA if f.name != "possession_team_id")
