"""Operators over the ordered action stream of a match (recipients, possessions, goals)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitchloom import schema as S
from pitchloom.functions import expressions as X
from pitchloom.operators.ordering import (
    POSITION, block_neighbours, block_running, dense_position,
)
from pitchloom.runtime import BLOCK_ROWS, GROUP_ROW_LIMIT, attach_row, split_by_size


def _by_size(df, keys, order, limit, small, large):
    """Run the window plan on bounded groups and the block plan on oversized ones."""
    bounded, huge = split_by_size(df, keys, limit)
    out = small(bounded)
    if huge is None:
        return out
    return out.unionByName(large(dense_position(huge, keys, order)).drop(POSITION))


# --- recipients --------------------------------------------------------------------------


def _pick_receiver(team, player, period, lookahead: int) -> Column:
    hits = [
        F.when(
            (F.col(f"_team{n}") == F.col(team))
            & F.col(f"_period{n}").eqNullSafe(F.col(period))
            & F.col(f"_player{n}").isNotNull()
            & ~F.col(f"_player{n}").eqNullSafe(F.col(player)),
            F.col(f"_player{n}"),
        )
        for n in range(1, lookahead + 1)
    ]
    return F.when(X.is_completed_pass(), F.coalesce(*hits))


def _receiver_specs(lookahead: int) -> dict:
    return {
        f"_{short}{n}": (column, n)
        for n in range(1, lookahead + 1)
        for short, column in (("team", "team_id"), ("player", "player_id"), ("period", "period_id"))
    }


def _with_receiver(df: DataFrame, lookahead: int) -> DataFrame:
    receiver = _pick_receiver("team_id", "player_id", "period_id", lookahead)
    return (
        df.withColumn("recipient_id", receiver)
        .withColumn("recipient_confident", F.col("recipient_id").isNotNull())
        .drop(*_receiver_specs(lookahead))
    )


def _recipients_small(df: DataFrame, keys, lookahead: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*S.ACTION_ORDER)
    specs = _receiver_specs(lookahead)
    ahead = df.withColumns({name: F.lead(c, n).over(window) for name, (c, n) in specs.items()})
    return _with_receiver(ahead, lookahead)


def _recipients_large(df: DataFrame, keys, lookahead: int, block: int) -> DataFrame:
    return _with_receiver(
        block_neighbours(df, keys, _receiver_specs(lookahead), block), lookahead
    )


def infer_recipients(
    actions: DataFrame, lookahead: int = S.LOOKAHEAD, limit: int = GROUP_ROW_LIMIT,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """First different team-mate among the next actions of the same period."""
    keys = ["game_id"]
    return _by_size(
        actions, keys, S.ACTION_ORDER, limit,
        lambda df: _recipients_small(df, keys, lookahead),
        lambda df: _recipients_large(df, keys, lookahead, block),
    )


def annotate_actions(
    actions: DataFrame, lookahead: int = S.LOOKAHEAD, min_hold: int = S.MIN_HOLD,
    limit: int = GROUP_ROW_LIMIT, block: int = BLOCK_ROWS,
) -> DataFrame:
    """Recipients and possessions together: one size check, one shuffle by match."""
    keys = ["game_id"]
    return _by_size(
        actions, keys, S.ACTION_ORDER, limit,
        lambda df: _possessions_small(_recipients_small(df, keys, lookahead), keys, min_hold),
        lambda df: _possessions_large(
            _recipients_large(df, keys, lookahead, block), keys, min_hold, block
        ),
    )


def next_other_speaker(
    turns: DataFrame, group: str, order: str, actor: str, lookahead: int = S.LOOKAHEAD,
    limit: int = GROUP_ROW_LIMIT,
) -> DataFrame:
    """The recipient rule on any ordered stream: the next different actor within reach."""
    specs = {f"_n{n}": (actor, n) for n in range(1, lookahead + 1)}

    def finish(df):
        hits = [F.when(F.col(c) != F.col(actor), F.col(c)) for c in specs]
        return df.withColumn("next_actor", F.coalesce(*hits)).drop(*specs)

    def small(df):
        window = Window.partitionBy(group).orderBy(order)
        return finish(
            df.withColumns({name: F.lead(c, n).over(window) for name, (c, n) in specs.items()})
        )

    return _by_size(
        turns, [group], [order], limit, small, lambda df: finish(block_neighbours(df, [group], specs))
    )


def score_recipients(inferred: DataFrame, truth: DataFrame) -> DataFrame:
    """n, accuracy, wrong and unresolved shares over eligible passes with a known receiver."""
    known = inferred.where(X.is_completed_pass()).join(
        truth.where(F.col("true_recipient_id").isNotNull()).select(
            "original_event_id", "true_recipient_id"
        ),
        "original_event_id",
    )
    right = F.col("recipient_id") == F.col("true_recipient_id")
    n = F.count(F.lit(1))
    return known.agg(
        n.alias("n"),
        (X.tally(right) / F.nullif(n, F.lit(0))).alias("accuracy"),
        (X.tally(~right) / F.nullif(n, F.lit(0))).alias("wrong"),
        (X.tally(F.col("recipient_id").isNull()) / F.nullif(n, F.lit(0))).alias("unresolved"),
    )


def degraded_recipient_accuracy(
    actions: DataFrame, truth: DataFrame, dropped=S.DENSITY_ASYMMETRIC_TYPES,
) -> DataFrame:
    """Thin the stream, infer again, score again; adds actions per game."""
    thin = actions.where(~F.col("type_name").isin(*dropped)).drop(
        "recipient_id", "recipient_confident"
    )
    density = thin.agg(
        (F.count(F.lit(1)) / F.nullif(F.count_distinct("game_id"), F.lit(0))).alias(
            "actions_per_game"
        )
    )
    return attach_row(score_recipients(infer_recipients(thin), truth), density)


# --- possessions -------------------------------------------------------------------------


def _contest(team, before, after) -> Column:
    """A reactive touch sandwiched between two touches of one other team."""
    return F.coalesce(
        X.is_contest() & (F.col(before) == F.col(after)) & (F.col(after) != F.col(team)),
        F.lit(False),
    )


def _flips(position, last_ordinary) -> Column:
    """Inside a block of consecutive candidates only the odd ones are absorbed."""
    return (F.col(position) - F.coalesce(F.col(last_ordinary), F.lit(-1))) % 2 == 1


def _starts_chain(controller, before, period, period_before) -> Column:
    return (
        F.col(period_before).isNull()
        | ~F.col(controller).eqNullSafe(F.col(before))
        | ~F.col(period).eqNullSafe(F.col(period_before))
        | X.is_set_piece()
    )


_SCRATCH = [
    "_before", "_after", "_candidate", "_ordinary", "_touch", "_touch_before", "_touch_after",
    "_run_start", "_run", "_run_before", "_run_after", "_run_length", "_short", "_plain_run",
    "_period_before", "_owner_before", "_chain_start", "_at", "_running",
]


def _possessions_small(df: DataFrame, keys, min_hold: int) -> DataFrame:
    """Every window shares the match partitioning: one shuffle."""
    w = Window.partitionBy(*keys).orderBy(*S.ACTION_ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns(
        {
            "_before": F.lag("team_id").over(w),
            "_after": F.lead("team_id").over(w),
            "_at": F.row_number().over(w).cast("long"),
        }
    )
    df = df.withColumn("_candidate", _contest("team_id", "_before", "_after"))
    df = df.withColumn("_ordinary", F.max(F.when(~F.col("_candidate"), F.col("_at"))).over(upto))
    df = df.withColumn(
        "_touch",
        F.when(F.col("_candidate") & _flips("_at", "_ordinary"), F.col("_before")).otherwise(
            F.col("team_id")
        ),
    )
    df = df.withColumns(
        {"_touch_before": F.lag("_touch").over(w), "_touch_after": F.lead("_touch").over(w)}
    )
    changed = (F.col("_at") == 1) | ~F.col("_touch").eqNullSafe(F.col("_touch_before"))
    df = df.withColumn("_run", F.sum(changed.cast("long")).over(upto))
    run = Window.partitionBy(*keys, "_run").orderBy(*S.ACTION_ORDER).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    df = df.withColumns(
        {
            "_run_length": F.count(F.lit(1)).over(run),
            "_run_before": F.first("_touch_before").over(run),
            "_run_after": F.last("_touch_after").over(run),
        }
    )
    df = df.withColumn(
        "_short",
        F.coalesce(
            (F.col("_run_length") < min_hold) & (F.col("_run_before") == F.col("_run_after")),
            F.lit(False),
        ),
    )
    df = df.withColumn("_plain_run", F.max(F.when(~F.col("_short"), F.col("_run"))).over(upto))
    df = df.withColumn(
        "possession_team_id",
        F.when(
            F.col("_short")
            & ((F.col("_run") - F.coalesce(F.col("_plain_run"), F.lit(0))) % 2 == 1),
            F.col("_run_before"),
        ).otherwise(F.col("_touch")),
    )
    df = df.withColumns(
        {
            "_owner_before": F.lag("possession_team_id").over(w),
            "_period_before": F.lag("period_id").over(w),
        }
    )
    begins = (F.col("_at") == 1) | _starts_chain(
        "possession_team_id", "_owner_before", "period_id", "_period_before"
    )
    df = df.withColumn("possession_id", F.sum(begins.cast("long")).over(upto) - 1)
    return df.drop(*_SCRATCH)


def _possessions_large(df: DataFrame, keys, min_hold: int, block: int) -> DataFrame:
    """The same rules on blocks; runs are reduced to their first rows."""
    keys = list(keys)
    df = block_neighbours(df, keys, {"_before": ("team_id", -1), "_after": ("team_id", 1)}, block)
    df = df.withColumn("_candidate", _contest("team_id", "_before", "_after"))
    df = block_running(
        df, keys, {"_ordinary": (F.when(~F.col("_candidate"), F.col(POSITION)), "max")}, block
    )
    df = df.withColumn(
        "_touch",
        F.when(F.col("_candidate") & _flips(POSITION, "_ordinary"), F.col("_before")).otherwise(
            F.col("team_id")
        ),
    )
    df = block_neighbours(
        df, keys, {"_touch_before": ("_touch", -1), "_period_before": ("period_id", -1)}, block
    )
    df = df.withColumn(
        "_run_start",
        (F.col(POSITION) == 0) | ~F.col("_touch").eqNullSafe(F.col("_touch_before")),
    )
    sizes = df.groupBy(*keys).agg((F.max(POSITION) + 1).alias("_size"))
    starts = df.where("_run_start").select(
        *keys, F.col(POSITION).alias("_first"), "_touch"
    )
    runs = dense_position(starts, keys, ["_first"]).join(sizes, keys)
    runs = block_neighbours(
        runs, keys,
        {"_run_before": ("_touch", -1), "_run_after": ("_touch", 1), "_next": ("_first", 1)},
        block,
    )
    length = F.coalesce(F.col("_next"), F.col("_size")) - F.col("_first")
    runs = runs.withColumn(
        "_short",
        F.coalesce(
            (length < min_hold) & (F.col("_run_before") == F.col("_run_after")), F.lit(False)
        ),
    )
    runs = block_running(
        runs, keys, {"_plain_run": (F.when(~F.col("_short"), F.col(POSITION)), "max")}, block
    )
    owner = F.when(
        F.col("_short") & _flips(POSITION, "_plain_run"), F.col("_run_before")
    ).otherwise(F.col("_touch"))
    runs = runs.select(*keys, F.col("_first").alias(POSITION), owner.alias("_owner"))
    df = df.join(runs, [*keys, POSITION], "left")
    # The owner found on a run's first row is carried to the rest of the run.
    df = block_running(
        df, keys,
        {"_running": (F.when(F.col("_run_start"), F.struct(POSITION, "_owner")), "max")}, block,
    )
    df = df.withColumn("possession_team_id", F.col("_running._owner"))
    df = block_neighbours(df, keys, {"_owner_before": ("possession_team_id", -1)}, block)
    begins = (F.col(POSITION) == 0) | _starts_chain(
        "possession_team_id", "_owner_before", "period_id", "_period_before"
    )
    df = block_running(df, keys, {"possession_id": (begins.cast("long"), "sum")}, block)
    return df.withColumn("possession_id", F.col("possession_id") - 1).drop(*_SCRATCH, "_owner")


def reconstruct_possessions(
    actions: DataFrame, min_hold: int = S.MIN_HOLD, limit: int = GROUP_ROW_LIMIT,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Possession chains: absorb contests, absorb flickers, break on owner, period, restart."""
    keys = ["game_id"]
    return _by_size(
        actions, keys, S.ACTION_ORDER, limit,
        lambda df: _possessions_small(df, keys, min_hold),
        lambda df: _possessions_large(df, keys, min_hold, block),
    )


def role_runs(turns: DataFrame, group: str, order: str, actor: str) -> DataFrame:
    """Runs of one actor in an ordered stream, one row per run."""
    keys = [group]
    bounded, huge = split_by_size(turns, keys)
    w = Window.partitionBy(*keys).orderBy(order)
    parts = [
        bounded.withColumn("_previous", F.lag(actor).over(w)).withColumn(
            "run_id",
            F.sum((~F.col(actor).eqNullSafe(F.col("_previous"))).cast("long")).over(
                w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
    ]
    if huge is not None:
        positioned = block_neighbours(
            dense_position(huge, keys, [order]), keys, {"_previous": (actor, -1)}
        )
        parts.append(
            block_running(
                positioned, keys,
                {"run_id": ((~F.col(actor).eqNullSafe(F.col("_previous"))).cast("long"), "sum")},
            ).drop(POSITION)
        )
    rows = parts[0] if huge is None else parts[0].unionByName(parts[1])
    return rows.groupBy(group, "run_id").agg(
        F.max(actor).alias("actor"), F.count(F.lit(1)).alias("n_turns"),
        F.min(order).alias("first_turn"),
    )


# --- agreement with a native possession counter ------------------------------------------


def _pairs(count) -> Column:
    return F.col(count) * (F.col(count) - 1) / 2.0


def adjusted_rand(df: DataFrame, left: str, right: str, keys=()) -> DataFrame:
    """Adjusted Rand index from the contingency table, per group of ``keys``."""
    keys = list(keys)
    cells = df.groupBy(*keys, left, right).agg(F.count(F.lit(1)).alias("_n"))

    def side(column, name):
        totals = cells.groupBy(*keys, column).agg(F.sum("_n").alias("_n"))
        return totals.groupBy(*keys).agg(F.sum(_pairs("_n")).alias(name))

    both = cells.groupBy(*keys).agg(
        F.sum(_pairs("_n")).alias("_both"), F.sum("_n").alias("_size")
    )
    if keys:
        joined = both.join(side(left, "_a"), keys).join(side(right, "_b"), keys)
    else:
        joined = attach_row(attach_row(both, side(left, "_a")), side(right, "_b"))
    every = _pairs("_size")
    expected = F.col("_a") * F.col("_b") / F.nullif(every, F.lit(0.0))
    ceiling = (F.col("_a") + F.col("_b")) / 2.0
    return joined.select(
        *keys,
        F.coalesce(
            (F.col("_both") - expected) / F.nullif(ceiling - expected, F.lit(0.0)), F.lit(1.0)
        ).alias("adjusted_rand"),
    )


def score_possessions(
    actions: DataFrame, truth_column: str = "statsbomb_possession",
    limit: int = GROUP_ROW_LIMIT, block: int = BLOCK_ROWS,
) -> DataFrame:
    """Chain counts, boundary Jaccard and adjusted Rand per match."""
    keys = ["game_id"]
    specs = {"_ours_before": ("possession_id", -1), "_theirs_before": (truth_column, -1)}

    def small(df):
        w = Window.partitionBy(*keys).orderBy(*S.ACTION_ORDER)
        return df.withColumns(
            {
                **{name: F.lag(c, -n).over(w) for name, (c, n) in specs.items()},
                "_first": F.row_number().over(w) == 1,
            }
        )

    def large(df):
        return block_neighbours(df, keys, specs, block).withColumn(
            "_first", F.col(POSITION) == 0
        )

    marked = _by_size(actions, keys, S.ACTION_ORDER, limit, small, large)
    ours = F.col("_first") | (F.col("possession_id") != F.col("_ours_before"))
    theirs = F.col("_first") | ~F.col(truth_column).eqNullSafe(F.col("_theirs_before"))
    counts = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        X.tally(ours).alias("n_chains_ours"),
        X.tally(theirs).alias("n_chains_truth"),
        (X.tally(ours & theirs) / F.nullif(X.tally(ours | theirs), F.lit(0))).alias(
            "boundary_jaccard"
        ),
    )
    return counts.join(adjusted_rand(actions, truth_column, "possession_id", keys), keys)


def possession_agreement(actions: DataFrame, truth: DataFrame) -> DataFrame:
    """Score freshly rebuilt chains on the rows that have a native possession number."""
    known = truth.where(F.col("statsbomb_possession").isNotNull()).select(
        "original_event_id", "statsbomb_possession"
    )
    rows = actions.drop("possession_id", "possession_team_id")
    return score_possessions(reconstruct_possessions(rows.join(known, "original_event_id")))


# --- minutes, goals, shots ---------------------------------------------------------------


def player_minutes(actions: DataFrame) -> DataFrame:
    """First and last minute a player acted in, and the time between."""
    return (
        actions.where(F.col("player_id").isNotNull())
        .withColumn("_minute", X.action_minute())
        .groupBy("game_id", "team_id", "player_id")
        .agg(F.min("_minute").alias("first_minute"), F.max("_minute").alias("last_minute"))
        .withColumn("minutes_played", F.col("last_minute") - F.col("first_minute"))
    )


def derive_goals(actions: DataFrame) -> DataFrame:
    """Successful shots for the acting team, own goals for the other team of the match.

    The other team is null when only one team acts in the match. Matches have two teams, so
    the set kept per match holds two ids.
    """
    rows = actions.select(
        "game_id", "team_id", X.action_minute().alias("minute"), "type_name", "result_name"
    )
    scored = rows.where(X.is_shot() & X.is_success()).withColumn(
        "scoring_team_id", F.col("team_id")
    )
    ends = actions.where(F.col("team_id").isNotNull()).groupBy("game_id").agg(
        F.min("team_id").alias("_low"), F.max("team_id").alias("_high")
    )
    other = F.when(F.col("team_id") != F.col("_low"), F.col("_low")).when(
        F.col("team_id") != F.col("_high"), F.col("_high")
    )
    own = (
        rows.where(F.col("result_name") == "owngoal")
        .join(ends, "game_id", "left")
        .withColumn("scoring_team_id", other)
        .drop("_low", "_high")
    )
    return scored.unionByName(own).select(
        "game_id", F.col("team_id").alias("acting_team_id"), "scoring_team_id", "minute"
    )


def goal_check(actions: DataFrame, games: DataFrame) -> DataFrame:
    """Derived and recorded final score per match with a recorded score."""
    goals = derive_goals(actions).groupBy("game_id", "scoring_team_id").agg(
        F.count(F.lit(1)).alias("_goals")
    )
    scored = games.where(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    by_side = (
        scored.select("game_id", "home_team_id", "away_team_id", "home_score", "away_score")
        .join(goals, "game_id", "left")
        .groupBy("game_id", "home_score", "away_score")
        .agg(
            *[
                F.coalesce(
                    F.sum(
                        F.when(F.col("scoring_team_id") == F.col(f"{side}_team_id"), F.col("_goals"))
                    ),
                    F.lit(0),
                ).alias(f"derived_{side}")
                for side in ("home", "away")
            ]
        )
    )
    return by_side.withColumn(
        "exact",
        (F.col("derived_home") == F.col("home_score"))
        & (F.col("derived_away") == F.col("away_score")),
    )


def validate_goals(actions: DataFrame, games: DataFrame) -> DataFrame:
    """How many recorded scores the derivation reproduces."""
    n = F.count(F.lit(1))
    return goal_check(actions, games).agg(
        n.alias("checked"),
        X.tally(F.col("exact")).alias("exact"),
        (X.tally(F.col("exact")) / F.nullif(n, F.lit(0))).alias("exact_rate"),
    )


def shot_possessions(actions: DataFrame) -> DataFrame:
    """Distinct (match, possession) pairs holding a shot."""
    return actions.where(X.is_shot()).select("game_id", "possession_id").distinct()
