"""Season averages, role-relative scores, position residuals and leaderboards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from pitchloom import schema as S
from pitchloom.functions import expressions as X
from pitchloom.operators.ordering import block_running, dense_position
from pitchloom.runtime import durable


# Decimals on which values are ranked.
RANK_DIGITS = 10


def _require(df: DataFrame, columns, what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{what} {missing} not in {df.columns}")


def player_season(
    players: DataFrame, min_matches: int = 5, metrics=S.PLAYER_METRICS
) -> DataFrame:
    """Mean metric per player and season; unknown values do not count."""
    _require(players, metrics, "metrics")
    return (
        players.groupBy("season", "provider", "player_id")
        .agg(
            *[F.avg(F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))).alias(m) for m in metrics],
            F.count(F.lit(1)).alias("n_matches"),
        )
        .where(F.col("n_matches") >= min_matches)
    )


def role_relative(
    df: DataFrame, role_column: str = "coarse_role", metrics=S.PLAYER_METRICS, suffix: str = "_z"
) -> DataFrame:
    """Population z-score inside each role; no spread or no role gives 0.

    Roles are few and large, so their moments are aggregated and joined back rather than
    gathered in a window.
    """
    _require(df, [role_column], "role column")
    present = [m for m in metrics if m in df.columns]
    moments = df.groupBy(role_column).agg(
        *[F.avg(m).alias(f"_mean_{m}") for m in present],
        *[F.stddev_pop(m).alias(f"_sd_{m}") for m in present],
    )
    out = df.join(moments, role_column, "left")
    return out.withColumns(
        {
            f"{m}{suffix}": X.safe_ratio(F.col(m) - F.col(f"_mean_{m}"), f"_sd_{m}")
            for m in present
        }
    ).drop(*[c for c in out.columns if c.startswith(("_mean_", "_sd_"))])


# --- position residual -------------------------------------------------------------------

_TERMS = ("one", "x", "y", "xx", "yy", "xy")


def _design(x, y):
    return {"one": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}


def position_residual(
    df: DataFrame, metrics=S.PLAYER_METRICS, position=("mean_x", "mean_y"),
    group=("season", "provider"), suffix: str = "_r",
):
    """(df with residual columns, R-squared table) of a quadratic fit on pitch position.

    One aggregation builds the moment sums of every (group, metric), a 6 x 6 solve turns each
    moment row into coefficients, and those join back to the players.
    """
    _require(df, position, "position columns")
    df = durable(df)  # read three times below
    group, present = list(group), [m for m in metrics if m in df.columns]

    def finite(column):
        c = F.col(column).cast("double")
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

    placed = finite(position[0]) & finite(position[1])
    centre = df.where(placed).groupBy(*group).agg(
        *[F.avg(p).alias(f"_m{i}") for i, p in enumerate(position)],
        *[F.stddev_pop(p).alias(f"_s{i}") for i, p in enumerate(position)],
    )

    def null_join(left, right, keys, how="left"):
        condition = F.lit(True)
        for k in keys:
            condition = condition & left[k].eqNullSafe(right[k])
        joined = left.join(right, condition, how)
        for k in keys:
            joined = joined.drop(right[k])
        return joined

    scaled = null_join(df, centre, group)
    for i, p in enumerate(position):
        spread = F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0)
        scaled = scaled.withColumn(f"_z{i}", (F.col(p) - F.col(f"_m{i}")) / spread)
    terms = _design(F.col("_z0"), F.col("_z1"))
    long = scaled.where(placed).select(
        *group, "_z0", "_z1",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in present])
        ).alias("_mv"),
    ).select(*group, "_z0", "_z1", "_mv.*").where(finite("v"))
    gram = [
        F.sum(terms[a] * terms[b]).alias(f"g_{a}_{b}")
        for i, a in enumerate(_TERMS) for b in _TERMS[i:]
    ]
    moments = long.groupBy(*group, "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"),
        F.max(F.abs("v")).alias("level"), (F.max("v") - F.min("v")).alias("range"),
        *gram, *[F.sum(terms[a] * F.col("v")).alias(f"c_{a}") for a in _TERMS],
    )

    def solve(batches):
        for pdf in batches:
            betas, r2s = [], []
            for row in pdf.to_dict("records"):
                flat = row["range"] <= 1e-12 * row["level"]
                if row["n"] < len(_TERMS) or flat:
                    betas.append(None)
                    r2s.append(0.0)
                    continue
                g = np.array(
                    [[row.get(f"g_{a}_{b}", row.get(f"g_{b}_{a}")) for b in _TERMS] for a in _TERMS]
                )
                c = np.array([row[f"c_{a}"] for a in _TERMS])
                # Centring the target keeps the explained sum well conditioned.
                shifted = c - row["mean"] * g[0]
                beta = np.linalg.lstsq(g, shifted, rcond=1e-12)[0]
                total = row["var"] * row["n"]
                left = total - 2 * beta @ shifted + beta @ g @ beta
                beta[0] += row["mean"]
                betas.append([float(b) for b in beta])
                r2s.append(float(1.0 - left / total))
            yield pdf[[*group, "metric", "n"]].assign(beta=betas, r2=r2s)

    out = T.StructType(
        [f for f in moments.schema if f.name in (*group, "metric", "n")]
        + [T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("r2", T.DoubleType())]
    )
    fits = moments.mapInPandas(solve, out)
    wide = fits.groupBy(*group).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("beta"))).alias(f"_b_{m}") for m in present]
    )
    frame = null_join(scaled, wide, group)
    fitted = {}
    for m in present:
        guess = sum(F.col(f"_b_{m}")[i] * terms[a] for i, a in enumerate(_TERMS))
        usable = placed & finite(m) & F.col(f"_b_{m}").isNotNull()
        fitted[f"{m}{suffix}"] = F.when(usable, F.col(m) - guess).otherwise(0.0)
    frame = frame.withColumns(fitted)
    frame = frame.drop(*[c for c in frame.columns if c.startswith("_")])
    return frame, fits.select(*group, "metric", "r2", "n")


# --- leaderboards ------------------------------------------------------------------------


def leaderboard(
    df: DataFrame, metric: str, k: int = 20, season: str | None = None,
    role: str | None = None, min_matches: int = 0, basis: str = "",
) -> DataFrame:
    """Top players by a metric in one of its bases ('', '_xt', '_z', '_r')."""
    column = f"{metric}{basis}"
    _require(df, [column], "metric")
    rows = df.where(F.col(column).isNotNull())
    if season is not None:
        rows = rows.where(F.col("season") == season)
    if role is not None:
        rows = rows.where(F.col("coarse_role") == role)
    if min_matches:
        rows = rows.where(F.col("n_matches") >= min_matches)
    return rows.orderBy(F.desc(column), "player_id").limit(k)


def leaderboards(df: DataFrame, metrics, k: int = 20, bases=("", "_xt", "_z", "_r")) -> DataFrame:
    """Top k players of every metric in every basis whose column is there, in one plan."""
    columns = [(m, basis) for basis in bases for m in metrics if f"{m}{basis}" in df.columns]
    rows = df.select(
        "season", "provider", "player_id", "coarse_role", "n_matches",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.lit(b).alias("basis"), F.col(f"{m}{b}").cast("double").alias("value"))
            for m, b in columns])).alias("_v"),
    ).select("*", "_v.*").drop("_v").where(F.col("value").isNotNull())
    w = Window.partitionBy("metric", "basis").orderBy(F.desc("value"), "player_id", "season", "provider")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_per_group(df: DataFrame, group, metric: str, tie: str, k: int) -> DataFrame:
    """Best k rows of each group. The rank filter runs before the shuffle as a group limit."""
    w = Window.partitionBy(*group).orderBy(F.desc(metric), tie)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _long_metrics(df: DataFrame, metrics, *keep) -> DataFrame:
    """One row per (row, metric), so that all metrics share one plan."""
    return df.select(
        *keep,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        ).alias("_m"),
    ).select(*keep, "_m.*").where(F.col("value").isNotNull())


def role_composition(df: DataFrame, metrics, top: int = 50) -> DataFrame:
    """Share of each role among the top players by every metric, beside the population."""
    long = _long_metrics(df, metrics, "player_id", "season", "provider", "coarse_role")
    w = Window.partitionBy("metric").orderBy(F.desc("value"), "player_id", "season", "provider")
    best = long.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= top)
    shares = [
        X.safe_ratio(100 * X.tally(F.col("coarse_role") == r), F.count("coarse_role")).alias(f"pct_{r}")
        for r in S.COARSE_ROLES
    ]
    everyone = df.agg(*shares).select(F.lit("population").alias("metric"), "*")
    return best.groupBy("metric").agg(*shares).unionByName(everyone)


def average_ranks(df: DataFrame, metrics) -> DataFrame:
    """(metric, value, rank) with ties on their mean rank.

    Values collapse to (metric, value, count); the running count comes from equal-sized
    blocks of that table, so no window spans a whole metric.
    """
    values = df.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("_n"))
    placed = dense_position(values, ["metric"], ["value"])
    running = block_running(placed, ["metric"], {"_upto": (F.col("_n"), "sum")})
    return running.select(
        "metric", "value", (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias("rank")
    )


def spearman_pairs(df: DataFrame, metrics, row_keys=("season", "provider", "player_id")) -> DataFrame:
    """Spearman correlation of every metric pair, as Pearson on average ranks."""
    metrics, keys = list(metrics), list(row_keys)
    # Means of the same numbers may differ in the last bits by the order of their sums: these are ties.
    long = durable(_long_metrics(df, metrics, *keys).withColumn("value", F.round("value", RANK_DIGITS)))
    ranks = long.join(average_ranks(long, metrics), ["metric", "value"])
    wide = ranks.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("rank"))).alias(m) for m in metrics]
    )
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    row = wide.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{i}").alias("spearman"))
                for i, (a, b) in enumerate(pairs)
            ])
        ).alias("_p")
    ).select("_p.*")


def mean_pairwise_spearman(df: DataFrame, metrics, row_keys=("season", "provider", "player_id")) -> DataFrame:
    """Mean off-diagonal Spearman correlation of a metric family."""
    return spearman_pairs(df, metrics, row_keys).agg(
        F.avg("spearman").alias("mean_spearman"), F.count(F.lit(1)).alias("pairs")
    )


def volume_proxy_report(df: DataFrame, r2: DataFrame, metrics, anchor: str = "degree_total", top: int = 50) -> DataFrame:
    """Role make-up of the top, correlation with degree and position share, per metric."""
    df = durable(df)
    shares = role_composition(df, metrics, top)
    others = [m for m in metrics if m != anchor]
    pairs = spearman_pairs(df, [anchor, *others]).where(F.col("left") == anchor).select(
        F.col("right").alias("metric"), F.col("spearman").alias("rho_volume")
    )
    mean_r2 = r2.groupBy("metric").agg(F.avg("r2").alias("mean_r2"))
    return shares.join(pairs, "metric", "left").join(mean_r2, "metric", "left")


def team_structure(teams: DataFrame, k: int = 12) -> DataFrame:
    """Mean team metrics per season and club, clubs with most passes first."""
    names = ("team_density", "team_centralization", "team_avg_path_length", "team_total_passes")
    return (
        teams.groupBy("season", "club").agg(*[F.avg(n).alias(n) for n in names])
        .orderBy(F.desc("team_total_passes"), "season", "club").limit(k)
    )
