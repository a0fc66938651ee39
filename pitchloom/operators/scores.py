"""Probability scores, calibration, match-level bootstrap, cluster agreement and lift.

A prediction table has one row per (model, match, checkpoint): the true class ``y`` and the
class ``probabilities`` as an array.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, functions as F

from pitchloom.functions import expressions as X
from pitchloom.functions.hashing import MODULUS, mix
from pitchloom.operators.sequence import adjusted_rand
from pitchloom.runtime import attach_row, durable

EPS = 1e-15
BINS = 10
DRAWS = 400
SUMS = ("loss", "brier", "hit", "confidence", "top_hit")


def clipped(probabilities="probabilities") -> Column:
    """Clip to [1e-15, 1] and renormalise."""
    return F.expr(
        f"transform(transform({probabilities}, p -> greatest({EPS}D, least(1D, p))), (p, i) -> p / "
        f"aggregate({probabilities}, 0D, (a, q) -> a + greatest({EPS}D, least(1D, q))))"
    )


def row_scores(predictions: DataFrame, y: str = "y", probabilities: str = "probabilities") -> DataFrame:
    """Log-loss, Brier, hit, confidence and calibration bin of every row."""
    bin_of = " + ".join(f"IF(confidence > {i} * 0.1D, 1, 0)" for i in range(1, BINS))
    return (
        predictions.withColumn("_p", clipped(probabilities))
        .selectExpr(
            "*",
            f"-ln(_p[{y}]) AS loss",
            f"aggregate(transform(_p, (p, i) -> pow(p - IF(i = {y}, 1D, 0D), 2)), 0D, (a, v) -> a + v) AS brier",
            f"IF(array_position({probabilities}, array_max({probabilities})) - 1 = {y}, 1D, 0D) AS hit",
            "array_max(_p) AS confidence",
            f"IF(array_position(_p, array_max(_p)) - 1 = {y}, 1D, 0D) AS top_hit",
        )
        .selectExpr("*", f"{bin_of} AS bin")
        .drop("_p")
    )


def _binned(scored: DataFrame, keys) -> DataFrame:
    """Sums per group and bin: the rows shrink to at most ten per group here."""
    return scored.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in SUMS]
    )


def score(predictions: DataFrame, keys=()) -> DataFrame:
    """n, log-loss, Brier, accuracy and expected calibration error per group."""
    keys = list(keys)
    total = F.sum("n")
    return _binned(row_scores(predictions), keys).groupBy(*keys).agg(
        total.alias("n"),
        (F.sum("loss") / total).alias("log_loss"), (F.sum("brier") / total).alias("brier"),
        (F.sum("hit") / total).alias("accuracy"),
        (F.sum(F.abs(F.col("top_hit") - F.col("confidence"))) / total).alias("ece"),
    )


def reliability_curve(predictions: DataFrame, keys=()) -> DataFrame:
    """The calibration bins as a table; empty bins have no row."""
    keys = list(keys)
    return _binned(row_scores(predictions), keys).select(
        *keys,
        (F.col("bin") / 10.0).alias("bin_low"), ((F.col("bin") + 1) / 10.0).alias("bin_high"), "n",
        (F.col("confidence") / F.col("n")).alias("mean_confidence"),
        (F.col("top_hit") / F.col("n")).alias("observed_accuracy"),
    )


def per_checkpoint(predictions: DataFrame) -> DataFrame:
    return score(predictions, ["checkpoint_minute"])


# --- bootstrap over whole matches --------------------------------------------------------


def poisson_bounds() -> list[int]:
    """Hash values from which a match is drawn once more: Poisson(1) shares of the hash range."""
    bounds, share, total, times = [], exp(-1.0), 0.0, 0
    while True:
        total += share
        bound = int(total * MODULUS)
        if bound >= MODULUS or (bounds and bound == bounds[-1]):
            return bounds
        bounds.append(bound)
        times += 1
        share /= times


def _draw_means(units: DataFrame, groups, draws: int, seed: int) -> DataFrame:
    """Resampled mean per (draw, group) from per-match sums.

    ``units`` holds one row per (match, group) with ``total`` and ``n``. How often a draw takes a match is a
    Poisson(1) number read off a hash of (draw, match): the bootstrap of data in many places, in which
    no draw has to know how many matches there are. Each task adds up its own matches for every
    draw, so draws x groups sums are all that leaves it; models share the draws of a match.
    """
    # No compiled chain of seventeen comparisons: the count of bounds at or below the hash.
    hashed = mix("draw", "game_id", seed=seed)
    times = F.size(F.filter(F.array(*map(F.lit, poisson_bounds())), lambda bound: bound <= F.col("_h")))
    drawn = (
        units.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("_h", hashed).where(F.col("_h") >= poisson_bounds()[0]).withColumn("_times", times)
    )
    return drawn.groupBy(*groups, "draw").agg(
        (F.sum(F.col("total") * F.col("_times")) / F.sum(F.col("n") * F.col("_times"))).alias("value")
    )


def _interval(values: DataFrame, groups) -> DataFrame:
    return values.groupBy(*groups).agg(
        F.expr("percentile(value, 0.025)").alias("ci_low"),
        F.expr("percentile(value, 0.975)").alias("ci_high"),
    )


def bootstrap_by_match(
    predictions: DataFrame, keys=(), draws: int = DRAWS, seed: int = 0, metric: str = "loss"
) -> DataFrame:
    """Point estimate and 95% interval, resampling matches rather than rows."""
    keys = list(keys)
    units = durable(
        row_scores(predictions).groupBy(*keys, "game_id").agg(
            F.sum(metric).alias("total"), F.count(F.lit(1)).alias("n")
        )
    )
    point = units.groupBy(*keys).agg(
        (F.sum("total") / F.sum("n")).alias("point"), F.count_distinct("game_id").alias("n_matches")
    )
    interval = _interval(_draw_means(units, keys, draws, seed), keys)
    return point.join(interval, keys) if keys else attach_row(point, interval)


def compare_models(predictions: DataFrame, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """One row per model: all scores with a match-level interval on the log-loss."""
    interval = bootstrap_by_match(predictions, ["model"], draws, seed).select(
        "model", F.col("ci_low").alias("log_loss_ci_low"), F.col("ci_high").alias("log_loss_ci_high"),
        "n_matches",
    )
    return score(predictions, ["model"]).withColumnRenamed("n", "n_rows").join(interval, "model")


def paired_difference(
    predictions: DataFrame, left: str, right: str, draws: int = DRAWS, seed: int = 0
) -> DataFrame:
    """Interval of the log-loss difference of two models on the same draws."""
    sign = F.when(F.col("model") == left, F.col("loss")).otherwise(-F.col("loss"))
    units = durable(
        row_scores(predictions.where(F.col("model").isin(left, right)))
        .groupBy("game_id")
        .agg(F.sum(sign).alias("total"), F.count_if(F.col("model") == left).alias("n"))
    )
    point = units.agg((F.sum("total") / F.sum("n")).alias("delta_log_loss"))
    interval = _interval(_draw_means(units, [], draws, seed), [])
    return attach_row(point, interval).withColumn(
        "significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    )


# --- cluster agreement -------------------------------------------------------------------


def normalized_mutual_info(df: DataFrame, left: str, right: str) -> DataFrame:
    """Mutual information over the mean of both entropies; 1 when both are constant."""
    cells = df.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))
    a = cells.groupBy(left).agg(F.sum("n").alias("na"))
    b = cells.groupBy(right).agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("_size"))
    p = F.col("n") / F.col("_size")
    mutual = attach_row(cells.join(a, left).join(b, right), total).agg(
        F.sum(p * F.log(F.col("n") * F.col("_size") / (F.col("na") * F.col("nb")))).alias("mi")
    )

    def entropy(table, column, name):
        q = F.col(column) / F.col("_size")
        return attach_row(table, total).agg((-F.sum(q * F.log(q))).alias(name))

    parts = attach_row(attach_row(mutual, entropy(a, "na", "ha")), entropy(b, "nb", "hb"))
    mean = (F.col("ha") + F.col("hb")) / 2
    return parts.select(
        F.when(mean > 0, F.col("mi") / F.nullif(mean, F.lit(0.0))).otherwise(1.0).alias("nmi")
    )


def agreement(df: DataFrame, left: str, right: str) -> DataFrame:
    """Adjusted Rand and NMI; rows with an unknown label do not count."""
    known = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return attach_row(adjusted_rand(known, left, right), normalized_mutual_info(known, left, right))


# --- shot lift ---------------------------------------------------------------------------


def wilson(successes, total, z: float = 1.96):
    """(low, high) of the Wilson score interval, null for an empty sample."""
    n = F.nullif(F.col(total).cast("double"), F.lit(0.0))
    p = F.col(successes) / n
    base = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / base
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    low, high = F.greatest(F.lit(0.0), centre - spread), F.least(F.lit(1.0), centre + spread)
    filled = F.col(total) > 0
    return F.when(filled, low), F.when(filled, high)


def shot_lift(labelled: DataFrame, keys=()) -> DataFrame:
    """Shot rate of each cluster with its interval, against the base rate of the same rows."""
    keys = list(keys)
    per = labelled.groupBy(*keys, "cluster").agg(
        F.count(F.lit(1)).alias("n_chains"), X.tally(F.col("ends_in_shot")).alias("_s")
    )
    base = per.groupBy(*keys).agg(F.sum("n_chains").alias("_n"), F.sum("_s").alias("_all"))
    joined = per.join(base, keys) if keys else attach_row(per, base)
    low, high = wilson("_s", "n_chains")
    joined = joined.withColumns(
        {
            "share": F.col("n_chains") / F.col("_n"), "shot_rate": F.col("_s") / F.col("n_chains"),
            "ci_low": low, "ci_high": high, "base_rate": F.col("_all") / F.col("_n"),
        }
    )
    return joined.withColumns(
        {
            "lift": F.col("shot_rate") / F.nullif(F.col("base_rate"), F.lit(0.0)),
            "differs_from_base": (F.col("ci_low") > F.col("base_rate")) | (F.col("ci_high") < F.col("base_rate")),
        }
    ).drop("_s", "_n", "_all")


def fold_stability(labelled: DataFrame) -> DataFrame:
    """Does a cluster keep its shot rate and share between the train and the test fold?"""
    lift = shot_lift(labelled.where(F.col("fold").isin("train", "test")), ["fold"])

    def side(fold):
        return lift.where(F.col("fold") == fold).select(
            "cluster",
            *[F.col(c).alias(f"{c}_{fold}") for c in ("n_chains", "shot_rate", "share", "ci_low", "ci_high")],
        )

    both = side("train").join(side("test"), "cluster", "full_outer")
    overlap = (F.col("ci_low_test") <= F.col("ci_high_train")) & (F.col("ci_low_train") <= F.col("ci_high_test"))
    return both.select(
        "cluster", "n_chains_train", "n_chains_test", "shot_rate_train", "shot_rate_test",
        (F.col("shot_rate_test") - F.col("shot_rate_train")).alias("shot_rate_delta"),
        "share_train", "share_test",
        (F.col("share_test") / F.nullif(F.col("share_train"), F.lit(0.0))).alias("share_ratio"),
        F.coalesce(overlap, F.lit(False)).alias("rate_stable"),
    )


# --- comparisons -------------------------------------------------------------------------


def over_seeds(results: DataFrame, keys, metrics) -> DataFrame:
    """Mean, spread and number of seeds per configuration."""
    return results.groupBy(*keys).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics],
        F.count_distinct("seed").alias("n_seeds"),
    )


def compare_representations(*tables: DataFrame) -> DataFrame:
    """Result tables of several representations stacked and sorted."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out.orderBy("k", "representation")


def paired_over_seeds(differences: DataFrame) -> DataFrame:
    """Mean difference, widest interval and number of significant seeds per model."""
    return differences.groupBy("model").agg(
        F.avg("delta_log_loss").alias("mean_delta"), F.min("ci_low").alias("ci_low"),
        F.max("ci_high").alias("ci_high"), X.tally(F.col("significant")).alias("n_significant"),
        F.count(F.lit(1)).alias("n_seeds"),
    )
