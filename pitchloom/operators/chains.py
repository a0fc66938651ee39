"""Possession chains: features, shot involvement, tokens, cluster profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitchloom import schema as S
from pitchloom.functions import expressions as X
from pitchloom.operators.sequence import shot_possessions
from pitchloom.runtime import attach_row

CHAIN_KEYS = ("game_id", "possession_id")


def _place() -> Column:
    return F.struct("period_id", "time_seconds", "action_id")


def chain_table(rated: DataFrame, min_actions: int = S.MIN_CHAIN_ACTIONS) -> DataFrame:
    """One row per chain of comparable actions, with the fourteen features.

    One aggregation over all actions: the shot flag sees every action, everything else only
    the comparable ones. First and last values come from an ordered min/max aggregate, so no
    chain is collected or sorted.
    """
    keys = list(CHAIN_KEYS)
    threat = F.col("xt_value") if "xt_value" in rated.columns else F.lit(0.0)
    kept = F.col("_kept")
    rows = rated.withColumns(
        {
            "_kept": X.is_comparable(), "_m": X.action_minute(), "_step": X.step_length(),
            "_at": _place(),
        }
    )

    def first(column):
        return F.min_by(column, F.when(kept & F.col(column).isNotNull(), F.col("_at")))

    def last(column):
        return F.max_by(column, F.when(kept & F.col(column).isNotNull(), F.col("_at")))

    def only(column):
        return F.when(kept, column)

    table = rows.groupBy(*keys).agg(
        *[first(c).alias(c) for c in ("season", "provider", "team_id", "period_id")],
        F.min(only(F.col("_m"))).alias("start_minute"), F.max(only(F.col("_m"))).alias("end_minute"),
        F.count_if(kept).alias("n_actions"),
        first("start_x").alias("start_x"), first("start_y").alias("start_y"),
        last("end_x").alias("end_x"), last("end_y").alias("end_y"),
        F.sum(only(F.col("_step"))).alias("path_length"),
        F.avg(only(F.col("_step"))).alias("mean_pass_length"),
        F.sum(only(F.coalesce(threat, F.lit(0.0)))).alias("xt_gain"),
        first("type_name").alias("_first_type"),
        F.avg(only((F.col("start_x") >= S.ZONE_EDGES[1]).cast("double"))).alias("share_final_third"),
        (F.max(only(F.col("start_y"))) - F.min(only(F.col("start_y")))).alias("width_used"),
        F.bool_or(X.is_shot()).alias("ends_in_shot"),
    ).where(F.col("n_actions") >= min_actions)
    return table.withColumns(
        {
            "duration_seconds": (F.col("end_minute") - F.col("start_minute")) * 60.0,
            "net_dx": F.col("end_x") - F.col("start_x"),
            "started_with_set_piece": F.col("_first_type").isin(*S.CHAIN_SET_PIECES).cast("double"),
            "start_zone": X.zone_of("start_x"),
            "end_zone": X.zone_of("end_x"),
        }
    ).withColumn("directness", X.directness("net_dx", "path_length")).drop("_first_type")


def shot_chain_involvement(actions: DataFrame, keys=S.NETWORK_KEYS) -> DataFrame:
    """Share of the group's shot chains a player touched, and share of their chains with a shot.

    Two aggregation levels: touches collapse to distinct (player, chain) first.
    """
    keys = list(keys)
    chain = list(dict.fromkeys([*keys, *CHAIN_KEYS]))
    shots = shot_possessions(actions).withColumn("_shot", F.lit(1))
    touched = (
        actions.where(F.col("player_id").isNotNull())
        .select(*chain, "player_id").distinct()
        .join(shots, list(CHAIN_KEYS), "left")
    )
    own = touched.groupBy(*keys, "player_id").agg(
        F.count(F.lit(1)).alias("_touched"), F.count("_shot").alias("_shots")
    )
    group = (
        touched.where(F.col("_shot") == 1).select(*chain).distinct()
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("_group"))
    )
    any_shot = shots.limit(1).select(F.lit(True).alias("_any"))
    # No shot chain anywhere gives an empty table.
    return attach_row(own.join(group, keys, "left"), any_shot).select(
        *keys, "player_id",
        X.safe_ratio("_shots", "_group").alias("shot_involvement"),
        X.safe_ratio("_shots", "_touched").alias("shot_conversion"),
    )


def node_threat_table(threat: DataFrame, involvement: DataFrame, keys=S.NETWORK_KEYS) -> DataFrame:
    """Both per-player threat tables side by side; a missing side is zero."""
    names = ["xt_generated", "shot_involvement", "shot_conversion"]
    return threat.join(involvement, [*keys, "player_id"], "full_outer").fillna(0.0, names)


TOKEN_VOCABULARY = tuple(sorted(S.PROVIDER_COMPARABLE_TYPES))
TOKEN_WIDTH = len(TOKEN_VOCABULARY) + 5


def _token() -> Column:
    kind = [
        F.when(F.col("type_name") == name, 1.0).otherwise(0.0) for name in TOKEN_VOCABULARY
    ]
    geometry = [
        F.col("start_x") / S.PITCH_LENGTH, F.col("start_y") / S.PITCH_WIDTH,
        X.dx() / S.PITCH_LENGTH, X.dy() / S.PITCH_WIDTH,
        F.when(X.is_success(), 1.0).otherwise(0.0),
    ]
    return F.array(*[c.cast("float") for c in (*kind, *geometry)])


def chain_sequences(
    actions: DataFrame, chains: DataFrame, max_length: int = S.CHAIN_TOKENS
) -> DataFrame:
    """First tokens of each listed chain, padded to a fixed flat array, with the length.

    The rank filter is pushed below the shuffle as a group limit, so a very long chain sends
    at most ``max_length`` rows per task, and the collected list is never longer than that.
    """
    keys = list(CHAIN_KEYS)
    w = Window.partitionBy(*keys).orderBy(*S.ACTION_ORDER)
    tokens = (
        actions.where(X.is_comparable())
        .join(chains.select(*keys), keys, "left_semi")
        .withColumn("_n", F.row_number().over(w))
        .where(F.col("_n") <= max_length)
        .groupBy(*keys)
        .agg(
            F.sort_array(F.collect_list(F.struct("_n", _token().alias("t")))).alias("_rows"),
            F.count(F.lit(1)).alias("length"),
        )
    )
    filled = F.flatten(F.transform("_rows", lambda r: r["t"]))
    missing = (F.lit(max_length) - F.col("length")).cast("int") * TOKEN_WIDTH
    return tokens.select(
        *keys, "length",
        F.concat(filled, F.array_repeat(F.lit(0.0).cast("float"), missing)).alias("tokens"),
    )


PROFILE_MEANS = {
    "shot_rate": "ends_in_shot", "n_actions": "n_actions", "duration_s": "duration_seconds",
    "start_x": "start_x", "end_x": "end_x", "net_dx": "net_dx", "directness": "directness",
    "xt_gain": "xt_gain", "set_piece": "started_with_set_piece", "width": "width_used",
}


def cluster_profiles(labelled: DataFrame, digits: int = 4) -> DataFrame:
    """Size, shot rate, mean features and share of every cluster, with a readable name."""
    base = labelled.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_chains"),
        *[F.avg(F.col(c).cast("double")).alias(name) for name, c in PROFILE_MEANS.items()],
    )
    # One row per cluster from here on.
    total = F.sum("n_chains").over(Window.partitionBy())
    named = name_clusters(base.withColumn("share_of_chains", F.col("n_chains") / total))
    return X.round_report(named, digits)


def percent_rank_mean(column: str) -> Column:
    """Average rank divided by the number of rows (ties share their mean rank)."""
    everything = Window.partitionBy()
    ties = Window.partitionBy(column)
    ordered = Window.partitionBy().orderBy(column)
    tied = F.count(F.lit(1)).over(ties)
    return (F.rank().over(ordered) + (tied - 1) / 2.0) / F.count(F.lit(1)).over(everything)


def name_clusters(profile: DataFrame) -> DataFrame:
    """Names relative to the sibling clusters; the input has one row per cluster."""
    ranked = profile.withColumns(
        {
            "_length": percent_rank_mean("n_actions"),
            "_direct": percent_rank_mean("directness"),
            "_threat": percent_rank_mean("xt_gain"),
        }
    )
    words = [
        F.when(F.col("set_piece") > 0.6, "set-piece").when(F.col("set_piece") < 0.2, "open-play"),
        F.when(F.col("_length") >= 0.75, "long").when(F.col("_length") <= 0.25, "brief"),
        F.when(F.col("_direct") >= 0.75, "direct").when(F.col("_direct") <= 0.25, "lateral"),
    ]
    stem = F.concat_ws(" ", *words)
    return ranked.withColumn(
        "label",
        F.concat(
            F.when(stem == "", "mixed").otherwise(stem), F.lit(" from "), X.zone_of("start_x"),
            F.lit(" third"), F.when(F.col("_threat") >= 0.85, ", high threat").otherwise(""),
        ),
    ).drop("_length", "_direct", "_threat")
